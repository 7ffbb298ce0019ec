"""Checks of user functions and of pipelines."""

from __future__ import annotations

import ast
import inspect
import textwrap
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import lanes
from .schema import POSITION, SAMPLE

# Modules and builtins whose results differ from run to run.
UNSTABLE = frozenset({"random", "time", "uuid", "secrets", "datetime.now", "os.urandom", "hash", "id"})


@dataclass(frozen=True)
class Issue:
    check: str
    detail: str


@dataclass
class Report:
    issues: list[Issue] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.issues

    def add(self, check: str, detail: str) -> None:
        self.issues.append(Issue(check, detail))

    def raise_if_any(self) -> None:
        if self.issues:
            raise ValidationError(self)


class ValidationError(ValueError):
    def __init__(self, report: Report):
        super().__init__("; ".join(f"{i.check}: {i.detail}" for i in report.issues))
        self.report = report


def lint(fn: Callable) -> list[Issue]:
    """Calls in a function's source whose results are not repeatable."""
    try:
        tree = ast.parse(textwrap.dedent(inspect.getsource(fn)))
    except (OSError, TypeError, SyntaxError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            name = ast.unparse(node.func)
            if name in UNSTABLE or name.split(".")[0] in UNSTABLE or any(name.endswith(u) for u in UNSTABLE if "." in u):
                out.append(Issue("repeatable", f"{name} at line {node.lineno}"))
    return out


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows, by two sums of row hashes and a count."""

    def digest(df: DataFrame):
        text = F.to_json(F.struct(*sorted(df.columns)))
        return df.select(F.xxhash64(text).alias("x"), F.crc32(text).alias("y")).agg(F.count(F.lit(1)), F.bit_xor("x"), F.sum((F.col("x") % 1_000_003).cast("long")), F.sum("y")).first()

    return digest(a) == digest(b)


def invariant(transform: Callable[[DataFrame], DataFrame], df: DataFrame, partitions: tuple[int, ...] = (1, 3, 8)) -> Report:
    """Whether results depend on how the input is split."""
    report = Report()
    first = transform(df.repartition(partitions[0]))
    for n in partitions[1:]:
        if not same_rows(first, transform(df.repartition(n))):
            report.add("partition invariance", f"{partitions[0]} and {n} partitions give different rows")
    return report


def conserved(plan: DataFrame, contributors: DataFrame) -> Report:
    """Every planned sample is closed at most once, and none is made up."""
    report = Report()
    many = lanes.exactly_once(plan, contributors).where("closed > 1").limit(1).count()
    if many:
        report.add("exactly once", "a sample is closed more than once")
    if contributors.join(plan.select(*POSITION, *SAMPLE), [*POSITION, *SAMPLE], "left_anti").limit(1).count():
        report.add("identity", "a record carries a sample that was not planned")
    return report


def lane_pure(batches: DataFrame, by: str = "batch_id") -> Report:
    report = Report()
    if "lane_id" in batches.columns and batches.groupBy(by, "lane_id").agg(F.max("slot").alias("m"), F.count(F.lit(1)).alias("n")).where("m + 1 <> n").limit(1).count():
        report.add("lane purity", "a batch has gaps")
    return report


def ordered(df: DataFrame) -> Report:
    report = Report()
    if lanes.out_of_order(df).limit(1).count():
        report.add("order", "cursors do not increase within a lane")
    return report


def preflight(encoders: Mapping[str, Callable[[str], list[int]]], probe: str = "one two") -> Report:
    """Whether each tokenizer loads and repeats itself."""
    report = Report()
    for name, encode in encoders.items():
        try:
            if encode(probe) != encode(probe):
                report.add("tokenizer", f"{name} gives different ids for the same text")
        except Exception as why:  # whatever a foreign tokenizer raises is the finding
            report.add("tokenizer", f"{name}: {why}")
    return report


def inspect_rows(df: DataFrame, n: int = 5) -> dict:
    """A few rows, the schema and the number of rows."""
    return {"schema": df.schema.simpleString(), "rows": df.count(), "head": [r.asDict(True) for r in df.limit(n).collect()]}
