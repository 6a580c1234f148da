"""Numbers of rows in groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, named, settled

#: Buckets that the rows' order is cut into: one for so many rows (as a power of two), at least and at most.
ROWS, LEAST, MOST = 16, 64, 1024
#: Copies that one row is multiplied into at once.
COPIES = 4096


def prefix(df: DataFrame, column: str) -> Column:
    """A whole number that never falls where the column rises: an integer itself, else the first bytes; nulls come first."""
    kind, c = dict(df.dtypes)[column], named(column)
    if kind in ("string", "binary"):
        c = F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    elif kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"rows cannot be ordered by {kind}")
    return F.coalesce(c.cast("long"), F.lit(-(1 << 63)))


def bucket(x: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds x reaches; looked up in two steps."""
    if not bounds:
        return F.lit(0)
    wide = max(1, round(len(bounds) ** 0.5))
    parts = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    reached = lambda some: F.size(F.filter(some, lambda b: b <= x))
    part = F.greatest(reached(F.lit([p[0] for p in parts])), F.lit(1))  # the last part whose first bound is reached
    return (part - 1) * wide + reached(F.element_at(F.lit(parts), part))


def ranked(df: DataFrame, group: list[str], order: list[str], name: str, weight: str | None = None) -> DataFrame:
    """df with `rank`, a row's number from 0 in its group in this order (nulls first), and `size`, the rows of its group.

    A row counts as often as its column `weight` says (once without); rank is the number of its first copy.  The order is cut into
    at most MOST buckets of about as many rows by quantiles of its first column's prefix() (a single row of numbers), so that a group
    that holds most of the rows lies in many cells of group and bucket; what a group has in the buckets before is summed up, a row
    a cell.  Group columns must not be null, the first column of the order must be an integer, a string or binary.  Rows that are
    equal in group and order are numbered in any order.
    """
    cell, n, before = fresh(df, "cell", "n", "before")
    rows = settled(df, name)
    parts = min(MOST, max(LEAST, rows.count() >> ROWS))
    x = prefix(df, order[0])
    bounds = rows.agg(F.percentile_approx(x, [k / parts for k in range(1, parts)], 4 * parts)).first()[0]  # numbers, at most MOST
    cells = [*group, cell]
    rows = rows.withColumn(cell, bucket(x, sorted(set(bounds or []))))
    one = named(weight) if weight else F.lit(1).cast("long")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    sums = rows.groupBy(*cells).agg(F.sum(one).alias(n))
    sums = sums.select(*cells, F.coalesce(F.sum(n).over(upto(whole.orderBy(cell))), F.lit(0)).alias(before), F.sum(n).over(whole).alias("size"))
    inside = F.coalesce(F.sum(one).over(upto(Window.partitionBy(*cells).orderBy(*order))), F.lit(0))
    return rows.join(sums, cells).select(*df.columns, (F.col(before) + inside).alias("rank"), "size")


def copied(df: DataFrame, times: str, number: str) -> DataFrame:
    """Every row of df as often as its column `times` says, with the copy's `number` from 0; in pieces, as a row may have any number."""
    (piece,) = fresh(df, "piece")
    df = df.filter(F.col(times) > 0).withColumn(piece, F.explode(F.expr(f"sequence(0L, ({times} - 1) div {COPIES})")))
    last = F.least(F.lit(COPIES).cast("long"), F.col(times) - F.col(piece) * COPIES) - 1
    return df.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(number, F.col(piece) * COPIES + F.col(number)).drop(piece)
