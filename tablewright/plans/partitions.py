"""Typed partitioning of a table: a model of what a PARTITION BY says, the partition of a row as a column
expression, checks, and what aligns a copy with its source."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import MigrationError
from tablewright.functions.columns import days, quoted

MAXVALUE = "MAXVALUE"
_PIECE = re.compile(r"'(?:[^'\\]|\\.|'')*'|`(?:[^`]|``)+`|[(),=]|[^\s(),=]+")
KINDS = ("RANGE", "RANGE COLUMNS", "LIST", "LIST COLUMNS", "HASH", "LINEAR HASH", "KEY", "LINEAR KEY")


@dataclass(frozen=True)
class Part:
    name: str
    bounds: tuple[str, ...]  # upper bounds of a range, or the values of a list


@dataclass(frozen=True)
class Partitioning:
    kind: str  # one of KINDS
    expression: str
    count: int = 1  # of HASH and KEY
    parts: tuple[Part, ...] = ()

    def names(self) -> list[str]:
        return [p.name for p in self.parts]

    def part_sql(self, part: Part) -> str:
        if self.kind.startswith("RANGE"):
            bound = MAXVALUE if part.bounds == (MAXVALUE,) and self.kind == "RANGE" else f"({', '.join(part.bounds)})"
            return f"PARTITION {part.name} VALUES LESS THAN {bound}"
        return f"PARTITION {part.name} VALUES IN ({', '.join(part.bounds)})"

    def sql(self) -> str:
        head = f"{self.kind} ({self.expression})"
        return head + (f" ({', '.join(map(self.part_sql, self.parts))})" if self.parts else f" PARTITIONS {self.count}" if self.count > 1 else "")

    def check(self) -> None:
        """INVALID_SYNTAX where the definition cannot stand."""
        wrong = ""
        if len({n.lower() for n in self.names()}) < len(self.parts):
            wrong = "two partitions have one name"
        elif self.kind.startswith(("RANGE", "LIST")) and not self.parts:
            wrong = f"{self.kind} needs partitions"
        elif self.kind.startswith("RANGE"):
            bounds = [tuple(map(_value, p.bounds)) for p in self.parts]
            if any(MAXVALUE in p.bounds for p in self.parts[:-1] if self.kind == "RANGE"):
                wrong = "MAXVALUE must be the last bound"
            elif any(None not in a + b and a >= b for a, b in zip(bounds[:-1], bounds[1:], strict=True)):
                wrong = "bounds must rise"
        elif self.kind.startswith("LIST") and len(values := [v for p in self.parts for v in p.bounds]) > len(set(values)):
            wrong = "a value is in two partitions"
        elif self.count < 1:
            wrong = "at least one partition is needed"
        if wrong:
            raise MigrationError("INVALID_SYNTAX", message=wrong)

    def assign(self) -> Column:
        """The name of a row's partition (its number for HASH), null where no partition takes it. One column or expression, as Spark reads it."""
        if self.kind == "RANGE COLUMNS" and "," in self.expression:
            return self._assign_by_several([_expression(c) for c in self.expression.split(",")])
        by = _expression(self.expression)
        if self.kind.endswith("HASH"):
            return F.abs(by % self.count)
        if self.kind.endswith("KEY"):
            return F.pmod(F.crc32(by.cast("string").cast("binary")), F.lit(self.count))
        out = F.lit(None).cast("string")
        for part in reversed(self.parts):
            if self.kind.startswith("LIST"):
                inside = functools.reduce(lambda a, b: a | b, [by.eqNullSafe(_literal(v)) for v in part.bounds])
            else:
                inside = F.lit(True) if part.bounds == (MAXVALUE,) else by.isNull() | (by < _literal(part.bounds[0]))
            out = F.when(inside, part.name).otherwise(out)
        return out

    def _assign_by_several(self, by: list[Column]) -> Column:
        """Bounds of several columns are compared in order; null is below every value."""
        out = F.lit(None).cast("string")
        for part in reversed(self.parts):
            below = F.lit(False)
            for column, bound in reversed(list(zip(by, part.bounds, strict=True))):
                value = None if bound == MAXVALUE else _literal(bound)
                below = F.lit(True) if value is None else column.isNull() | (column < value) | ((column == value) & below)
            out = F.when(below, part.name).otherwise(out)
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, p.name, list(p.bounds)) for i, p in enumerate(self.parts)], "place int, name string, bounds array<string>")


def _value(bound: str) -> tuple[int, object] | None:
    """What orders bounds; None of what only a database can evaluate."""
    if bound == MAXVALUE:
        return 2, 0
    if re.fullmatch(r"-?\d+(\.\d+)?", bound):
        return 0, float(bound)
    if m := re.fullmatch(r"(?i)to_days\s*\(\s*'([^']*)'\s*\)", bound):
        return 1, m[1]
    return (1, bound[1:-1]) if bound[:1] == "'" else None


def _expression(text: str) -> Column:
    if m := re.fullmatch(r"(?i)to_days\s*\((.*)\)", text):
        return days(_expression(m[1]).cast("date"))
    name = text.strip().strip("`")
    return F.col(quoted(name)) if re.fullmatch(r"[\w$]+", name) else F.expr(text)


def _literal(bound: str) -> Column:
    if m := re.fullmatch(r"(?i)to_days\s*\((.*)\)", bound):
        return days(_literal(m[1]).cast("date"))
    return F.lit(None) if bound.upper() == "NULL" else F.expr(bound)


class _Pieces:
    def __init__(self, text: str):
        self.left = _PIECE.findall(text)[::-1]

    def at(self, *words: str) -> bool:
        return [p.upper() for p in self.left[-len(words) :][::-1]] == list(words)

    def take(self, *words: str) -> bool:
        if found := self.at(*words):
            del self.left[-len(words) :]
        return found

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise MigrationError("INVALID_SYNTAX", message=f"{' '.join(words)} expected at {' '.join(self.left[::-1][:4])!r}")

    def word(self) -> str:
        if not self.left:
            raise MigrationError("INVALID_SYNTAX", message="the partition text ends too early")
        return self.left.pop()

    def items(self) -> list[str]:
        """What stands in a bracket, cut at the commas outside of inner brackets."""
        self.need("(")
        depth, out, item = 1, [], []
        while depth:
            piece = self.word()
            depth += (piece == "(") - (piece == ")")
            if not depth or depth == 1 and piece == ",":
                out.append(" ".join(item).replace(" (", "(").replace("( ", "(").replace(" )", ")"))
                item = []
            else:
                item.append(piece)
        return out if out != [""] else []


def parse_partitions(text: str) -> Partitioning:
    """What follows PARTITION BY. Options of single partitions (ENGINE, COMMENT and the like) are read over."""
    p = _Pieces(text)
    kind = next((k for k in sorted(KINDS, key=len, reverse=True) if p.take(*k.split())), None)
    if not kind:
        raise MigrationError("INVALID_SYNTAX", message=f"PARTITION BY {text[:40]!r}")
    if p.take("ALGORITHM", "="):
        p.word()
    by, count, parts = ", ".join(i.strip("`") if kind.endswith(("KEY", "COLUMNS")) else i for i in p.items()), 0, []
    if p.take("PARTITIONS"):
        count = int(p.word())
    if p.at("("):
        p.take("(")
        while True:
            p.need("PARTITION")
            name, bounds = p.word().strip("`"), []
            if kind.startswith("RANGE"):
                p.need("VALUES", "LESS", "THAN")
                bounds = [MAXVALUE] if p.take(MAXVALUE) else [b.upper() if b.upper() == MAXVALUE else b for b in p.items()]
            elif kind.startswith("LIST"):
                p.need("VALUES", "IN")
                bounds = p.items()
            while p.left and not (p.at(",") or p.at(")")):
                p.word()
            parts.append(Part(name, tuple(bounds)))
            if not p.take(","):
                break
        p.need(")")
    hashed = kind.endswith(("HASH", "KEY"))
    if p.left or hashed and any(x.bounds for x in parts):
        raise MigrationError("INVALID_SYNTAX", message=f"PARTITION BY ends with {' '.join(p.left[::-1][:4])!r}")
    out = Partitioning(kind, by, (count or len(parts) or 1) if hashed else len(parts), () if hashed else tuple(parts))
    out.check()
    return out


def sync_actions(copy: DataFrame, source: DataFrame) -> DataFrame:
    """action (add, drop), part: what gives the copy the source's partitions; both frames have a column part."""
    both = copy.select("part").distinct().withColumn("__copy", F.lit(True)).join(source.select("part").distinct().withColumn("__source", F.lit(True)), "part", "full_outer")
    return both.where("__copy IS NULL OR __source IS NULL").select(F.when(F.col("__copy").isNull(), "add").otherwise("drop").alias("action"), "part")
