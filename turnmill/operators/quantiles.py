"""Exact quantiles with bounded memory: a sketch says where to look, counts make it exact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.staging import stage

#: A sketch is off by no more than this share of the rows, or nearly so; results are exact whatever it says.
ACCURACY = 10_000
MARGIN = 4 / ACCURACY
BROADCAST_GROUPS = 100_000
#: Where no group has more values, Spark's own exact quantile holds that many at most.
SMALL_GROUP = 100_000


def exact_quantiles(df: DataFrame, column: str, quantiles: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Interpolated quantiles of a column, one column for each name; a row for each group with values, or one row.

    Nulls do not count.  A sketch of each group gives two bounds around each quantile, which part its values in
    three.  The parts are counted, so that it is known in which of them the two
    rows next to the quantile lie and at what place; the values of that part alone, as a rule a
    few in ten thousand, are then counted one by one and summed up in order.  Groups
    that are all small, which is counted, need none of this.
    """
    keys = [f"_q_by{k}" for k in range(len(by or []))] or ["_q_by0"]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)] if by else [F.lit(0).alias("_q_by0")]
    values = stage(df.select(*named, F.col(column).cast("double").alias("_q_v")).where("_q_v is not null"), "values")
    names = list(quantiles)
    whole = values.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("groups")).first()
    if (whole["most"] or 0) <= SMALL_GROUP:
        exact = values.groupBy(*keys).agg(*[F.percentile("_q_v", F.lit(float(q))).alias(n) for n, q in quantiles.items()])
        return exact.select(*[F.col(k).alias(c) for c, k in zip(by or [], keys, strict=False)], *names)
    few = whole["groups"] <= BROADCAST_GROUPS
    shares = [s for q in quantiles.values() for s in (max(q - MARGIN, 0.0), min(q + MARGIN, 1.0))]
    sketch = F.percentile_approx("_q_v", shares, ACCURACY)
    groups = stage(values.groupBy(*keys).agg(F.count("*").alias("_q_n"), sketch.alias("_q_cuts")), "sketches")

    def part(k: int) -> Column:
        low, high = (F.get(F.col("_q_cuts"), F.lit(2 * k + side)) for side in (0, 1))
        return F.when(F.col("_q_v") < low, 0).when(F.col("_q_v") <= high, 1).otherwise(2)

    cut = _joined(values, groups, keys, few).withColumns({f"_q_p{k}": part(k) for k in range(len(names))})
    sizes = [F.count_if(F.col(f"_q_p{k}") == p).alias(f"_q_s{k}{p}") for k in range(len(names)) for p in (0, 1)]
    counted = cut.groupBy(*keys, "_q_n").agg(*sizes)

    def wanted(k: int, q: float) -> list[Column]:
        """The two rows next to a quantile: which, their part, and their place in it."""
        at = F.lit(float(q)) * (F.col("_q_n") - 1)
        below, inside = F.col(f"_q_s{k}0"), F.col(f"_q_s{k}1")

        def one(side: int, place: Column) -> Column:
            where = F.when(place < below, 0).when(place < below + inside, 1).otherwise(2)
            before = F.when(where == 0, F.lit(0)).when(where == 1, below).otherwise(below + inside)
            return F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), where.alias("part"), (place - before).alias("place"), (at - F.floor(at)).alias("share"))

        return [one(0, F.floor(at)), one(1, F.ceil(at))]

    targets = counted.select(*keys, F.explode(F.array(*[x for k, q in enumerate(quantiles.values()) for x in wanted(k, q)])).alias("t")).select(*keys, "t.*")
    targets = stage(targets, "targets")
    asked = targets.groupBy(*keys).agg(F.collect_set(F.struct("k", "part")).alias("_q_asked"))
    here = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_q_p{k}").alias("part")) for k in range(len(names))])
    close = _joined(cut.select(*keys, "_q_v", here.alias("_q_here")), asked, keys, few)
    close = close.select(*keys, "_q_v", F.explode(F.array_intersect("_q_here", "_q_asked")).alias("x")).select(*keys, "_q_v", "x.k", "x.part")
    each = close.groupBy(*keys, "k", "part", "_q_v").agg(F.count("*").alias("_q_m"))
    upto = F.sum("_q_m").over(Window.partitionBy(*keys, "k", "part").orderBy("_q_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = each.withColumn("_q_upto", upto)
    found = _joined(ranked, targets.withColumnsRenamed({"k": "_q_k", "part": "_q_part"}), keys, few, (F.col("k") == F.col("_q_k")) & (F.col("part") == F.col("_q_part")))
    found = found.where((F.col("place") < F.col("_q_upto")) & (F.col("place") >= F.col("_q_upto") - F.col("_q_m")))

    def value(k: int, side: int) -> Column:
        return F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("_q_v")))

    def share(k: int) -> Column:
        return F.max(F.when(F.col("k") == k, F.col("share")))

    made = [(value(k, 0) + (value(k, 1) - value(k, 0)) * share(k)).alias(n) for k, n in enumerate(names)]
    out = found.groupBy(*keys).agg(*made)
    return out.select(*[F.col(k).alias(c) for c, k in zip(by or [], keys, strict=False)], *names)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], few: bool, more: Column | None = None) -> DataFrame:
    """Rows with those of their group on the right, of which there are few for each group; null is a group."""
    others = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in keys])
    return left.join(F.broadcast(others) if few else others.hint("merge"), same if more is None else same & more).drop(*[f"{k}_r" for k in keys])
