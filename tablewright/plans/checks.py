"""Checks before data moves: row identity, key coverage, dropped columns, conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablewright.errors import MigrationError
from tablewright.plans.diff import needs_current_time
from tablewright.plans.schema import KeySpec, TableSpec, normalized


def identity(table: TableSpec, allow_new_key: bool = False) -> tuple[list[str], bool]:
    """Columns that identify a row, and whether these are all columns for want of a key."""
    every = [c.name for c in table.columns]
    if table.primary:
        return (every, True) if any(size for _, size, _ in table.primary.columns) else (table.primary.names(), False)
    unique = next((k for k in table.keys if k.unique), None)
    if unique:
        return unique.names(), False
    if not allow_new_key:
        raise MigrationError("NEW_PK", table=table.name)
    return every, True


def _keys(table: TableSpec) -> list[KeySpec]:
    return ([table.primary] if table.primary else []) + list(table.keys)


def covered(table: TableSpec, names: list[str]) -> bool:
    """Whether a key's first columns are these, or a unique key's first columns are some of these."""
    for key in _keys(table):
        first = set(key.names()[: len(names)])
        if first == set(names) or key.unique and first < set(names):
            return True
    return False


def ordered_key(table: TableSpec, names: list[str]) -> KeySpec | None:
    """The first key that starts with these columns in this order, if it is unique: chunks may follow it."""
    found = next((k for k in _keys(table) if k.names()[: len(names)] == names), None)
    return found if found and found.unique else None


WHOLE_DUMP_BYTES = 500 << 20  # fixed value: tables under this may be moved without a key to cut them by


def require_migratable(old: TableSpec, new: TableSpec, allow_drop: bool = False, allow_new_key: bool = False, allow_current_time: bool = False, table_bytes: int | None = None) -> list[str]:
    """The identity columns, or the error that stands against the migration. table_bytes: of a table that, if it is small, may do without a key
    of the new schema that covers the identity: it is dumped and compared as a whole."""
    if not new.primary:
        raise MigrationError("NO_PK_EXIST", table=new.name)
    names, _ = identity(old, allow_new_key)
    dropped = [c.name for c in old.columns if new.column(c.name) is None]
    for name in dropped:
        if old.primary and name in old.primary.names():
            raise MigrationError("PRI_COL_DROPPED", column=name)
        if not allow_drop:
            raise MigrationError("MISSING_COLUMN", column=name)
    if not covered(new, names) and (table_bytes is None or table_bytes >= WHOLE_DUMP_BYTES):
        raise MigrationError("NO_INDEX_COVERAGE", columns=", ".join(names))
    if not allow_current_time and (risky := needs_current_time(old, new)):
        raise MigrationError("UNSAFE_TS_BOOTSTRAP", column=risky[0])
    return names


def dump_keys(old: TableSpec, new: TableSpec, names: list[str], table_bytes: int) -> list[str] | None:
    """What a dump is cut by: the identity columns where keys of both schemas follow them; None, the table as it lies, where not, if it is
    small, or where all columns are the identity."""
    if ordered_key(old, names) and covered(new, names):
        return names
    if table_bytes >= WHOLE_DUMP_BYTES and old.primary:
        raise MigrationError("NO_INDEX_COVERAGE", columns=", ".join(names))
    return None


def require_no_foreign_keys(found: DataFrame, table: str) -> None:
    """FOREIGN_KEY_FOUND if the table has one or is named by one (rows of sources.tables.foreign_keys)."""
    if first := found.orderBy("name").limit(1).collect():
        raise MigrationError("FOREIGN_KEY_FOUND", table=table, key=first[0]["name"])


def require_space(table_bytes: int, free_bytes: int, new_identity: bool = False, reserved: float = 0.01) -> None:
    """NOT_ENOUGH_SPACE unless the copy fits beside the table; without a key to cut by, its dump as well."""
    needed = 2 * table_bytes if new_identity else table_bytes * 11 // 10
    if needed > free_bytes * (1 - reserved):
        raise MigrationError("NOT_ENOUGH_SPACE", needed=needed, free=free_bytes)


def verification(old: TableSpec, new: TableSpec, keys: list[str], where: str | None = None, skip: bool = False) -> str:
    """How old and new can be compared: `none` (a filtered copy lacks rows), `whole` (rows cannot be numbered alike on both sides: no unique
    key of the new schema starts with the old one, or a key column's collation changes the order) or `chunks`."""
    if skip or where:
        return "none"
    old, new = normalized(old), normalized(new)
    collation = lambda t, name: (c := t.column(name)) and c.collate
    alike = ordered_key(new, keys) and all(collation(old, k) == collation(new, k) for k in keys)
    return "chunks" if alike else "whole"


def session_overrides(text: str) -> dict[str, str]:
    out = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, found, value = part.partition("=")
        if not found or not name.strip() or not value.strip():
            raise MigrationError("INVALID_SYNTAX", message=part)
        out[name.strip()] = value.strip()
    return out
