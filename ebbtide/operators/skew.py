"""Ordered scans over groups of any size.

A window clustered by a key puts the whole group in one task, and one entity
may hold a third of the table. Before an ordered scan, `split_hot` measures the
groups. Those of ordinary size stay whole, so the plan for them is the plain window. The
rows of the oversized ones are set aside in the shared folder and sorted into pieces by
range partitioning on (group, order): as many pieces as their rows need, for any number of groups.
A piece is a task, so a small `max_rows` makes at most `PIECES` of them; beyond that their number
follows the rows by `HOT_ROWS` alone.
The scan then runs per piece, and a row per piece carries state forward.

The input is read three times at most, whatever is scanned later: to measure, for the oversized
groups, and for the rest. What follows reads the pieces. Nothing about groups reaches the
driver but two numbers, and tables of pieces are joined on the keys by which the scans are partitioned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.session import cut_lineage

SEG = "_seg"
WHOLE = -1                    # SEG of a group that was not cut
HOT_ROWS = 2_000_000          # rows of a group that one task scans
PIECES = 256                  # pieces that a small `max_rows` may make; more are made only for HOT_ROWS each
FEW_GROUPS = 100_000          # oversized groups whose keys are sent to all tasks; beyond that they are joined
SMALL_BYTES = 256 << 20

_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def plan_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables `df` reads, by Catalyst's statistics; None where a source has none (a stream)."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    try:
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Py4JJavaError:
        return None


def is_small(df: DataFrame) -> bool:
    """True when the whole input would be one ordinary task's work: few bytes read, and no row made into many."""
    if re.search(r"^[\s:+|-]*(Generate|Expand|Range) ", df._jdf.queryExecution().analyzed().toString(), re.M):
        return False
    size = plan_bytes(df)
    return size is not None and size <= SMALL_BYTES


@dataclass(frozen=True)
class Grouped:
    """A table ready for ordered scans: rows, group columns, and whether any group is cut."""

    df: DataFrame
    by: tuple[str, ...]
    hot: bool

    @property
    def keys(self) -> list[str]:
        return [*self.by, SEG] if self.hot else list(self.by)

    def with_df(self, df: DataFrame) -> "Grouped":
        return Grouped(df, self.by, self.hot)

    def pieces(self) -> DataFrame:
        return self.df.filter(F.col(SEG) >= 0)

    def result(self) -> DataFrame:
        return self.df.drop(SEG) if self.hot else self.df

    def attach(self, table: DataFrame) -> DataFrame:
        """Left join of a table with a row per piece, on the keys that the scans are partitioned by."""
        return self.df.join(table, self.keys, "left")


def n_pieces(rows: int, max_rows: int) -> int:
    """Pieces for so many rows: each has about `max_rows`, or more if that made over `PIECES`, but never over HOT_ROWS."""
    return max(min(ceil(rows / max_rows), PIECES), ceil(rows / max(max_rows, HOT_ROWS)))


def split_hot(df: DataFrame, by: list[str], order: str, max_rows: int | None = None) -> Grouped:
    """Cut groups of more than `max_rows` rows along `order`.

    Rows equal in `order` stay in one piece; SEG rises with `order` inside a group. Without
    `max_rows`, inputs small enough for one task skip the measuring job. Groups with a null key stay whole.
    """
    if max_rows is None:
        if is_small(df):
            return Grouped(df, tuple(by), False)
        max_rows = HOT_ROWS
    sizes = cut_lineage(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows))
    groups, rows = sizes.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not groups:
        return Grouped(df, tuple(by), False)
    inside, outside = df, None
    if by:
        keys = sizes.select(*by)
        keys = F.broadcast(keys) if groups <= FEW_GROUPS else keys
        inside, outside = df.join(keys, list(by), "left_semi"), df.join(keys, list(by), "left_anti")
    inside = cut_lineage(inside)
    inside = cut_lineage(inside.repartitionByRange(n_pieces(rows, max_rows), *by, order).withColumn(SEG, F.spark_partition_id()))
    if outside is not None:
        inside = outside.withColumn(SEG, F.lit(WHOLE)).unionByName(inside)
    return Grouped(inside, tuple(by), True)


def running(g: Grouped, order: list, exprs: dict[str, tuple[str, Column | str]],
            inclusive: bool = True) -> Grouped:
    """Running sum/max/min per group over rows up to (or strictly before) each row."""
    w = (Window.partitionBy(*g.keys).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    cols = {name: (F.col(c) if isinstance(c, str) else c) for name, (_, c) in exprs.items()}
    out = g.df.select("*", *[_AGG[kind](cols[n]).over(w).alias(n) for n, (kind, _) in exprs.items()])
    if not g.hot:
        return g.with_df(out)
    part = g.pieces().groupBy(*g.keys).agg(
        *[_AGG[kind](cols[n]).alias(n) for n, (kind, _) in exprs.items()])
    wc = Window.partitionBy(*g.by).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = part.select(*g.keys, *[_AGG[kind](n).over(wc).alias(f"_c_{n}")
                                   for n, (kind, _) in exprs.items()])
    j = g.with_df(out).attach(carry)
    j = j.withColumns({n: _COMBINE[kind](F.col(n), F.col(f"_c_{n}")) for n, (kind, _) in exprs.items()})
    return g.with_df(j.drop(*[f"_c_{n}" for n in exprs]))


def previous(g: Grouped, order: str, cols: dict[str, str]) -> Grouped:
    """The row before, per group: `cols` maps new names to the columns to fetch."""
    w = Window.partitionBy(*g.keys).orderBy(order)
    if not g.hot:
        return g.with_df(g.df.select("*", *[F.lag(c).over(w).alias(n) for n, c in cols.items()]))
    packed = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    out = g.df.withColumn("_prev", F.lag(packed).over(w))
    part = g.pieces().groupBy(*g.keys).agg(F.max_by(packed, order).alias("_last"))
    carry = part.select(*g.keys, F.lag("_last").over(Window.partitionBy(*g.by).orderBy(SEG)).alias("_carry"))
    j = g.with_df(out).attach(carry).withColumn("_prev", F.coalesce("_prev", "_carry"))
    return g.with_df(j.select(*g.df.columns, *[F.col(f"_prev.{n}").alias(n) for n in cols]))


def group_total(g: Grouped, exprs: dict[str, tuple[str, Column | str]]) -> Grouped:
    """Whole-group sum/max/min on every row, in the partitioning the scans already use."""
    w = Window.partitionBy(*g.keys)
    cols = {name: (F.col(c) if isinstance(c, str) else c) for name, (_, c) in exprs.items()}
    out = g.df.select("*", *[_AGG[kind](cols[n]).over(w).alias(n) for n, (kind, _) in exprs.items()])
    if not g.hot:
        return g.with_df(out)
    part = g.pieces().groupBy(*g.keys).agg(*[_AGG[kind](cols[n]).alias(n) for n, (kind, _) in exprs.items()])
    total = part.select(*g.keys, *[_AGG[kind](n).over(Window.partitionBy(*g.by)).alias(f"_t_{n}") for n, (kind, _) in exprs.items()])
    j = g.with_df(out).attach(total)
    j = j.withColumns({n: F.coalesce(F.col(f"_t_{n}"), F.col(n)) for n in exprs})
    return g.with_df(j.drop(*[f"_t_{n}" for n in exprs]))


def followers(g: Grouped, order: str, value: str, k: int, name: str) -> Grouped:
    """The values of the next `k` rows per group, as an array (shorter near the end)."""
    w = Window.partitionBy(*g.keys).orderBy(order)
    near = F.array_compact(F.array(*[F.lead(value, i).over(w) for i in range(1, k + 1)]))
    out = g.df.withColumn(name, near)
    if not g.hot:
        return g.with_df(out)
    head = (g.pieces()
            .withColumn("_rn", F.row_number().over(Window.partitionBy(*g.keys).orderBy(order)))
            .filter(F.col("_rn") <= k)                    # prunes before the shuffle
            .select(*g.keys, F.col(order).alias("_at"), F.col(value).alias("_v"),
                    F.lit(False).alias("_end")))
    ends = g.pieces().groupBy(*g.keys).agg(F.max(order).alias("_at")).select(
        *g.keys, "_at", F.lit(None).cast(g.df.schema[value].dataType).alias("_v"),
        F.lit(True).alias("_end"))
    # Between a piece's end and the next k head rows lie at most k other ends.
    wh = Window.partitionBy(*g.by).orderBy("_at", "_end").rowsBetween(1, 2 * k)
    halo = (head.unionByName(ends).withColumn("_halo", F.slice(F.collect_list("_v").over(wh), 1, k))
            .filter("_end").select(*g.keys, "_halo"))
    j = g.with_df(out).attach(halo)
    full = F.slice(F.concat(F.col(name), F.coalesce("_halo", F.slice(name, 1, 0))), 1, k)
    return g.with_df(j.withColumn(name, full).drop("_halo"))


def exact_quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] = (),
                    name: str = "q", max_rows: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (array `name`) per group, exact at any size.

    Small inputs use the built-in exact percentile, whose buffer holds every
    distinct value of a group. Larger ones count equal values first and find the
    wanted ranks from a running total.
    """
    d = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if max_rows is None and is_small(d):
        return d.groupBy(*by).agg(F.percentile(value, [float(q) for q in qs]).alias(name))
    v = d.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    g = running(split_hot(v, list(by), "_v", max_rows), ["_v"], {"_cum": ("sum", "_c")})
    g = group_total(g, {"_n": ("sum", "_c")})
    picks = []
    for i, q in enumerate(qs):
        pos = (F.col("_n") - 1) * F.lit(float(q))
        for side, rank in (("l", F.floor(pos)), ("h", F.ceil(pos))):
            hit = (rank >= F.col("_cum") - F.col("_c")) & (rank < F.col("_cum"))
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
    out = g.df.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    parts = []
    for i, q in enumerate(qs):
        pos = (F.col("_n") - 1) * F.lit(float(q))
        parts.append(F.col(f"_l{i}") + (pos - F.floor(pos)) * (F.col(f"_h{i}") - F.col(f"_l{i}")))
    return out.select(*by, F.array(*parts).alias(name))


def column_medians(df: DataFrame, columns: dict[str, Column], by: list[str] = (), max_rows: int | None = None) -> DataFrame:
    """(by, feature, median) of several columns at once, exact at any size; columns without values have no row."""
    if max_rows is None and is_small(df):
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_m{i}").alias("median")) for i, n in enumerate(columns)])).alias("c")
        d = df.groupBy(*by).agg(*[F.percentile(x, 0.5).alias(f"_m{i}") for i, x in enumerate(columns.values())])
        return d.select(*by, cells).select(*by, "c.*").filter("median IS NOT NULL")
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), x.cast("double").alias("v")) for n, x in columns.items()])).alias("c")
    q = exact_quantiles(df.select(*by, cells).select(*by, "c.*"), "v", [0.5], [*by, "feature"], max_rows=max_rows or HOT_ROWS)
    return q.select(*by, "feature", F.col("q")[0].alias("median"))


def average_ranks(df: DataFrame, value: str, name: str, max_rows: int | None = None) -> DataFrame:
    """Ranks with ties averaged, as a table (value, name): one row per distinct value."""
    v = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    g = running(split_hot(v, [], value, max_rows), [value], {"_cum": ("sum", "_c")})
    return g.df.select(value, (F.col("_cum") - (F.col("_c") - 1) / 2.0).alias(name))
