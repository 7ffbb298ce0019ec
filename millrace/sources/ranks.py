"""Places of rows in the order of a column, without ordering a table at once.

The column's values are cut into stretches of about equally many rows. Rows
are ordered inside a stretch only; how many come before it is the sum of the
counts of earlier stretches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a stretch, about; and the cuts that one step of the lookup compares,
#: so that there are at most its square of stretches.
ROWS, SIDE = 4096, 64


def cuts(df: DataFrame, order: str, rows: int | None = None) -> list[int]:
    """Values that begin a stretch: approximate quantiles. Places are exact
    with any cuts. Other columns than whole numbers are left in one stretch."""
    if not isinstance(df.schema[order].dataType, T.IntegralType):
        return []
    n = min(SIDE * SIDE, -(-df.count() // (rows or ROWS)))
    if n < 2:
        return []
    shares = F.expr(f"array({', '.join(f'{i / n!r}D' for i in range(1, n))})")
    return sorted(set(df.agg(F.percentile_approx(order, shares, 10 * n)).first()[0] or ()))


def stretch(order: str, begins: Sequence[int]) -> Column:
    """Number of a value's stretch, looked up among every so many cuts, then
    among those between. Null comes first, as in an ascending order."""
    if not begins:
        return F.lit(0)
    parts = [begins[i : i + SIDE] for i in range(0, len(begins), SIDE)]
    listed = lambda values: f"array({', '.join(f'{v}BD' for v in values)})"
    whole = lambda text, kind: F.expr(text).cast(f"array<{kind}>")
    up_to = lambda values: F.size(F.filter(values, lambda b: b <= F.col(order)))
    step = up_to(whole(listed([p[0] for p in parts]), "bigint"))
    inside = up_to(F.element_at(whole(f"array({', '.join(map(listed, parts))})", "array<bigint>"), step))
    return F.when(step > 0, (step - 1) * SIDE + inside).otherwise(0)


def ranked(df: DataFrame, order: Sequence[str], by: Mapping[str, Sequence[str]], *, begins: Sequence[int] | None = None, few: bool = False) -> DataFrame:
    """Add the place (from 0) of each row among those of equal columns
    ``by[name]``, in the total ``order``. Wider groups go first, so that those
    within them need no exchange of their own. ``few``: there are few groups,
    so their counts by stretch are sent to all tasks."""
    begins = cuts(df, order[0]) if begins is None else begins
    out = df.withColumn("_stretch", stretch(order[0], begins))
    joined = out
    for name, columns in by.items():
        joined = joined.withColumn(name, (F.row_number().over(W.partitionBy("_stretch", *columns).orderBy(*order)) - 1).cast("long"))
    for name, columns in by.items():
        counts = out.groupBy("_stretch", *columns).agg(F.count(F.lit(1)).alias("_n"))
        earlier = F.coalesce(F.sum("_n").over(W.partitionBy(*columns).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        keys = ["_stretch", *columns]
        table = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], earlier.alias("_before"))
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
        joined = joined.join(F.broadcast(table) if few else table, condition).withColumn(name, F.col(name) + F.col("_before")).drop("_before", *[f"_k{i}" for i in range(len(keys))])
    return joined.drop("_stretch")
