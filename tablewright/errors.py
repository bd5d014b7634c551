"""Typed errors of a migration."""

from __future__ import annotations

#: Name -> (code, message, retryable).
ERRORS = {
    "TABLE_NOT_EXIST": (100, "table {table} does not exist", False),
    "TABLE_ALREADY_EXIST": (101, "table {table} already exists", False),
    "NO_PK_EXIST": (102, "the new schema of {table} has no primary key", False),
    "NEW_PK": (103, "{table} has no key that identifies its rows", False),
    "PRI_COL_DROPPED": (104, "key column {column} would be dropped", False),
    "MISSING_COLUMN": (105, "column {column} would be dropped without permission", False),
    "NO_INDEX_COVERAGE": (106, "no key of the new schema covers {columns}", False),
    "UNSAFE_TS_BOOTSTRAP": (107, "column {column} would be filled with the current time", False),
    "IMPLICIT_CONVERSION_DETECTED": (108, "the created table differs: {difference}", False),
    "CHECKSUM_MISMATCH": (109, "old and new data differ: {difference}", False),
    "REPLAY_WRONG_AFFECTED": (110, "{count} changes fit no row", False),
    "UNKNOWN_REPLAY_TYPE": (111, "change type {dml_type} is not known", False),
    "REPLAY_TIMEOUT": (112, "replay took longer than {seconds} s", True),
    "MAX_ATTEMPT_EXCEEDED": (113, "not caught up after {attempts} rounds", True),
    "REPLAY_TOO_MANY_DELTAS": (114, "{count} changes are more than {limit}", True),
    "TABLE_TIMESTAMP_CHANGED_ERROR": (115, "the source changed under the migration", True),
    "INVALID_SYNTAX": (116, "cannot parse: {message}", False),
    "ASSERTION_ERROR": (117, "expected {expected}, got {got}", False),
    "FOREIGN_KEY_FOUND": (119, "{table} takes part in the foreign key {key}", False),
    "NOT_ENOUGH_SPACE": (120, "{needed} bytes are needed, {free} are free", False),
    "DB_NOT_EXIST": (121, "database {database} does not exist", False),
    "UNVERIFIED_SWAP": (122, "nothing is known that the new {table} could be compared with", False),
    "DUPLICATE_KEY": (123, "rows share the unique key {columns}: {value}", False),
    "NO_PARTITION": (124, "no partition takes {count} rows", False),
    "OUTSIDE_HOOK_ERROR": (118, "hook {hook} failed: {message}", False),
}


class MigrationError(Exception):
    def __init__(self, name: str, **values: object):
        self.code, text, self.retryable = ERRORS[name]
        self.name = name
        super().__init__(f"{self.code}: {name}: {text.format(**values)}")
