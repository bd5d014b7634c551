"""Schema differences: what changes, as rows and as ALTER TABLE text, and what a migration must know."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablewright.functions.columns import quoted
from tablewright.plans.partitions import Partitioning, _value, parse_partitions
from tablewright.plans.schema import ColumnSpec, KeySpec, TableSpec, normalized

#: Changes that need no copy of the data.
INSTANT = {"ADD_COL", "ADD_TIMESTAMP_COL", "ADD_SHARDING_KEY", "DROP_SHARDING_KEY", "CHANGE_SHARDING_KEY"}


@dataclass(frozen=True)
class Change:
    change: str  # add, drop, modify
    object: str  # column, key, option, partition, foreign key
    name: str
    old: str
    new: str
    alter_types: tuple[str, ...]


def key_types(old: KeySpec | None, new: KeySpec | None) -> list[str]:
    """What a changed key is, attribute by attribute."""
    kinds = {"DROP_INDEX": old is not None, "ADD_INDEX": new is not None}
    kinds["BECOME_UNIQUE_INDEX"] = bool(new and new.unique and not (old and old.unique))
    if old and new:
        changed = lambda *names: any(getattr(old, n) != getattr(new, n) for n in names)
        kinds |= {"CHANGE_UNIQUE_CONSTRAINT": changed("unique"), "CHANGE_INDEX_TYPE": changed("using"), "CHANGE_INDEX_KIND": changed("kind"), "CHANGE_INDEX_COMMENT": changed("comment"), "CHANGE_INDEX_BLOCK_SIZE": changed("block_size"), "CHANGE_INDEX_VISIBILITY": changed("visible"), "CHANGE_INDEX_COLUMNS": changed("columns")}
    return [k for k, v in kinds.items() if v]


def column_types(old: ColumnSpec, new: ColumnSpec) -> list[str]:
    kinds = {"CHANGE_COL_DATA_TYPE": (old.type, old.length, old.values if old.type not in ("ENUM", "SET") else ()) != (new.type, new.length, new.values if new.type not in ("ENUM", "SET") else ())}
    if not kinds["CHANGE_COL_DATA_TYPE"]:
        kinds |= {"CHANGE_COL_DEFAULT_VAL": (old.default, old.on_update_now, old.on_update_precision) != (new.default, new.on_update_now, new.on_update_precision), "CHANGE_NULL": old.nullable != new.nullable, "CHANGE_UNSIGNED": old.unsigned != new.unsigned}
    kinds |= {"CHANGE_ENUM": old.type == new.type == "ENUM" and old.values != new.values, "CHANGE_SET": old.type == new.type == "SET" and old.values != new.values, "CHANGE_AUTO_INC": old.auto_increment != new.auto_increment, "CHANGE_COL_CHARSET": old.charset != new.charset, "CHANGE_COL_COLLATE": old.collate != new.collate, "CHANGE_COL_COMMENT": old.comment != new.comment}
    return [k for k, v in kinds.items() if v]


def reorganized(old: Partitioning, new: Partitioning) -> tuple[str, str]:
    """One run of old partitions becomes one run of new ones. Of ranges the run's last bound must stay, unless it is the
    table's last and rises; of lists no value may be lost or taken from outside the run."""
    same = 0
    while same < min(len(old.parts), len(new.parts)) and old.parts[same] == new.parts[same]:
        same += 1
    tail = 0
    while tail < min(len(old.parts), len(new.parts)) - same and old.parts[-1 - tail] == new.parts[-1 - tail]:
        tail += 1
    if same + tail == len(old.parts) and tail:  # what was put in came out of the partition behind it
        tail -= 1
    gone, come = old.parts[same : len(old.parts) - tail], new.parts[same : len(new.parts) - tail]
    if old.kind.startswith("RANGE"):
        low, high = gone[-1].bounds, come[-1].bounds
        rank = lambda bounds: tuple(_value(b) or (1, b) for b in bounds)
        fits = low == high or not tail and rank(low) < rank(high)
    else:
        fits = {v for p in gone for v in p.bounds} <= {v for p in come for v in p.bounds}
    if not fits:
        return f"PARTITION BY {new.sql()}", "INVALID_PARTITIONING"
    return f"REORGANIZE PARTITION {', '.join(p.name for p in gone)} INTO ({', '.join(map(new.part_sql, come))})", "REORGANIZE_PARTITION"


def partition_change(old: str, new: str) -> tuple[str, str] | None:
    """ALTER text and type."""
    a, b = (parse_partitions(x) if x else None for x in (old, new))
    if a == b:
        return None
    if not b:
        return "REMOVE PARTITIONING", "REMOVE_PARTITIONING"
    if not a:
        return f"PARTITION BY {b.sql()}", "ADD_PARTITIONING"
    if (a.kind, a.expression) != (b.kind, b.expression):
        return f"PARTITION BY {b.sql()}", "CHANGE_PARTITIONING"
    if not a.parts:
        more = b.count - a.count
        return (f"ADD PARTITION PARTITIONS {more}", "ADD_PARTITION") if more > 0 else (f"COALESCE PARTITION {-more}", "COALESCE_PARTITION")
    if b.parts[: len(a.parts)] == a.parts or a.kind.startswith("LIST") and {*a.parts} < {*b.parts}:
        return f"ADD PARTITION ({', '.join(b.part_sql(p) for p in b.parts if p not in a.parts)})", "ADD_PARTITION"
    if [p for p in a.parts if p in b.parts] == list(b.parts):
        return f"DROP PARTITION {', '.join(p.name for p in a.parts if p not in b.parts)}", "DROP_PARTITION"
    return reorganized(a, b)


class SchemaDiff:
    """What turns one table into another."""

    def __init__(self, old: TableSpec, new: TableSpec, ignore_partition: bool = False):
        old, new = normalized(old), normalized(new)
        self.table, self.changes, self.segments = old.name, [], []
        names = [c.name for c in new.columns]
        left = [c.name for c in old.columns if c.name in names]
        for c in old.columns:
            if c.name not in names:
                self._add("drop", "column", c.name, c.sql(), "", ["DROP_COL"], f"DROP {quoted(c.name)}")
        for i, c in enumerate(new.columns):
            where = f"AFTER {quoted(names[i - 1])}" if i else "FIRST"
            was = old.column(c.name)
            if was is None:
                left.insert(i, c.name)
                kind = "ADD_TIMESTAMP_COL" if c.type == "TIMESTAMP" else "ADD_AUTO_INC_COL" if c.auto_increment else "ADD_COL"
                self._add("add", "column", c.name, "", c.sql(), [kind], f"ADD {c.sql()} {where}")
                continue
            kinds = column_types(was, c)
            moved = left[i] != c.name
            if moved:
                left.remove(c.name)
                left.insert(i, c.name)
                kinds.append("REORDER_COL")
            if kinds:
                self._add("modify", "column", c.name, was.sql(), c.sql(), kinds, f"MODIFY {c.sql()}" + f" {where}" * moved)
        if old.primary != new.primary:
            parts = ["DROP PRIMARY KEY"] * bool(old.primary) + ([f"ADD {new.primary.sql(True)}"] if new.primary else [])
            self._add("modify", "key", "PRIMARY", old.primary.sql(True) if old.primary else "", new.primary.sql(True) if new.primary else "", ["CHANGE_PK" if old.primary and new.primary else "ADD_PK" if new.primary else "DROP_PK"], *parts)
        a, b = {k.name: k for k in old.keys}, {k.name: k for k in new.keys}
        for name in sorted({*a, *b}):
            x, y = a.get(name), b.get(name)
            if x != y:
                self._add("modify" if x and y else "add" if y else "drop", "key", name, x.sql() if x else "", y.sql() if y else "", key_types(x, y), *([f"DROP KEY {quoted(name)}"] * (x is not None) + [f"ADD {y.sql()}" if y else ""]))
        for f in sorted({*old.foreign} - {*new.foreign}):
            self._add("drop", "foreign key", f[0], f[2], "", ["DROP_FOREIGN_KEY"], f"DROP FOREIGN KEY {quoted(f[0])}")
        if old.sharding_key != new.sharding_key:
            kind = "CHANGE_SHARDING_KEY" if old.sharding_key and new.sharding_key else "ADD_SHARDING_KEY" if new.sharding_key else "DROP_SHARDING_KEY"
            text = lambda key: f"SHARDING_KEY=({', '.join(map(quoted, key))})"
            self._add("modify", "option", "SHARDING_KEY", text(old.sharding_key), text(new.sharding_key), [kind], text(new.sharding_key))
        for option in sorted({*old.options, *new.options}):
            x, y = old.options.get(option, ""), new.options.get(option, "")
            if x != y:
                y = y or {"COMMENT": "''", "ROW_FORMAT": "default", "KEY_BLOCK_SIZE": "0"}.get(option, y)
                self._add("modify", "option", option, x, y, [f"CHANGE_{option}"], f"{option}={y}")
        if not ignore_partition and (found := partition_change(old.partition, new.partition)):
            self._add("modify", "partition", "", old.partition, new.partition, [found[1]], found[0])

    def _add(self, change: str, kind: str, name: str, old: str, new: str, types: list[str], *sql: str) -> None:
        self.changes.append(Change(change, kind, name, old, new, tuple(types)))
        self.segments += [s for s in sql if s]

    def alter_types(self) -> set[str]:
        return {t for c in self.changes for t in c.alter_types}

    def to_sql(self) -> str | None:
        return f"ALTER TABLE {quoted(self.table)} " + ", ".join(self.segments) if self.segments else None

    def rows(self, spark: SparkSession) -> DataFrame:
        rows = [(c.change, c.object, c.name, c.old, c.new, ",".join(c.alter_types), set(c.alter_types) <= INSTANT) for c in self.changes]
        return spark.createDataFrame(rows, "change string, object string, name string, old string, new string, alter_types string, instant boolean")


def converted_columns(old: TableSpec, new: TableSpec) -> list[str]:
    old, new = normalized(old), normalized(new)
    return [c.name for c in new.columns if (was := old.column(c.name)) and (was.type, was.length) != (c.type, c.length)]


def needs_current_time(old: TableSpec, new: TableSpec) -> list[str]:
    """Columns that a copy would fill with the current time."""
    old, new = normalized(old), normalized(new)
    now = lambda c: bool(c.default and c.default.upper().startswith("CURRENT_TIMESTAMP"))
    out = []
    for c in new.columns:
        was = old.column(c.name)
        if c.type in ("TIMESTAMP", "DATE", "DATETIME") and (now(c) and not (was and now(was)) or c.on_update_now and not (was and was.on_update_now)):
            out.append(c.name)
    return out
