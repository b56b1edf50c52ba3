"""Quantiles of large groups: mergeable sketches for windows, and exact ones by ever narrower ranges of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Size of a KLL sketch, and the error of a rank that it has with 99 % (each way, as a share of the rows): 1.33 % at 200, halved by twice the size.
SKETCH, RANK_ERROR = 400, 0.0067
#: A sketch is asked for its values at so many equal steps.
GRID = 200
#: Values of one group that a task may put in order.
SORTED = 1 << 18
#: Targets that are broadcast; more are joined by a shuffle.
FEW = 10_000


def windowed_sketches(events: DataFrame, ts: str, by: list[str], value: str, pane: str, panes: int, counts: dict[str, Column], k: int = SKETCH) -> DataFrame:
    """window_start, by, n, the given counts and `sketch` (KLL) of sliding windows of `panes` panes, one starting with each pane.

    Events are aggregated once, by pane; windows merge the panes' sketches and add their counts, so that a window's length costs nothing.
    """
    dealt = events.groupBy(F.window(ts, pane)["start"].alias("_pane"), *by)
    own = dealt.agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), *[F.sum(c.cast("long")).alias(name) for name, c in counts.items()])
    step = F.expr(f"interval {pane}")
    starts = F.array(*[F.col("_pane") - step * i for i in range(panes)])
    spread = own.withColumn("window_start", F.explode(starts))
    return spread.groupBy("window_start", *by).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in counts], F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def at_rank(sketch: Column | str, share: float) -> Column:
    """The value that a sketch has at this share of its rows."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def exact(df: DataFrame, by: list[str], value: str, shares: list[float], most: int = SORTED, k: int = SKETCH) -> DataFrame:
    """by, share, n and `value`: in each group the value at rank min(n - 1, floor(share * n)), from 0. Nulls are no values.

    A group of more than `most` values is never sorted: a sketch gives a range that the rank should lie in, one pass counts
    what is below and inside, and if too much is inside, a sketch of that gives a narrower range. A range that has missed the
    rank, which the counts show, is opened on that side for good. Only values inside are put in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    wide = 3 * RANK_ERROR * SKETCH / k
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("_s"))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * F.col("share")))
    wanted = groups.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).withColumn("_i", at)

    def ranged(t: DataFrame, size: str, place: Column) -> DataFrame:
        """Bounds around a place (a share of a sketch's rows); as before, for good (_done), where few enough values are left or none are nearer."""
        few, low, high = F.col(size) <= most, place - wide, place + wide
        grid = F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
        lo = F.when(low > 0, F.get(grid, F.floor(low * GRID).cast("int")))
        hi = F.when(high < 1, F.get(grid, F.ceil(high * GRID).cast("int")))
        new = t.withColumns({"_nlo": F.when(few, F.col("_lo")).otherwise(F.coalesce(lo, "_lo")), "_nhi": F.when(few, F.col("_hi")).otherwise(F.coalesce(hi, "_hi"))})
        new = new.withColumn("_done", F.col("_nlo").eqNullSafe(F.col("_lo")) & F.col("_nhi").eqNullSafe(F.col("_hi")))
        return new.drop("_lo", "_hi", "_s").withColumnsRenamed({"_nlo": "_lo", "_nhi": "_hi"})

    wanted = wanted.withColumns({"_lo": F.lit(None).cast("double"), "_hi": F.lit(None).cast("double")})
    targets = cut(ranged(wanted, "n", F.col("_i") / F.col("n")))
    keys = [*by, "share"]
    cols = [*keys, "n", "_i", "_lo", "_hi", "_done"]
    inside = (F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))

    def joined(t: DataFrame) -> DataFrame:
        few = F.broadcast(t) if t.count() <= FEW else t
        return rows.join(few, by) if by else rows.crossJoin(F.broadcast(t))  # as many rows as shares

    while True:
        met = joined(targets)
        seen = met.groupBy(*keys).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count_if(inside).alias("_in"), F.kll_sketch_agg_double(F.when(inside, F.col("_v")), F.lit(k)).alias("_s"))
        state = cut(targets.join(seen, keys))
        under, over = F.col("_i") < F.col("_below"), F.col("_i") >= F.col("_below") + F.col("_in")
        more = ~F.col("_done") & (F.col("_in") > most)
        if state.where(under | over | more).isEmpty():
            break
        missed = state.where(under | over).withColumns({"_lo": F.when(under, F.lit(None)).otherwise(F.col("_lo")), "_hi": F.when(over, F.lit(None)).otherwise(F.col("_hi")), "_done": F.lit(True)})
        narrow = ranged(state.where(~(under | over) & more).drop("_done"), "_in", (F.col("_i") - F.col("_below")) / F.col("_in"))
        kept = state.where(~(under | over) & ~more)
        targets = cut(missed.select(cols).unionByName(narrow.select(cols)).unionByName(kept.select(cols)))
    ready = state.select(*keys, "n", "_i", "_lo", "_hi", "_below")
    values = joined(ready).where(inside).groupBy(*keys, "n", "_i", "_below", "_v").agg(F.count("*").alias("_k"))
    upto = F.col("_below") + F.sum("_k").over(Window.partitionBy(*keys).orderBy("_v"))
    placed = values.withColumn("_to", upto)
    return placed.where((F.col("_i") < F.col("_to")) & (F.col("_i") >= F.col("_to") - F.col("_k"))).select(*by, "share", "n", F.col("_v").alias("value"))
