"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a mergeable sketch first
brackets each wanted quantile; a second pass counts what lies below the bracket and shuffles only the values
inside it. The result is the exact, linearly interpolated order statistic.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecoframe.operators.skew import attach, whole

SKETCH_ACCURACY = 10_000


@dataclass(frozen=True)
class Quantile:
    """One output column: the ``p`` quantile of the non-NULL values of ``value``."""
    name: str
    value: Column
    p: float


def exact_quantiles(df: DataFrame, keys: Sequence[str], wanted: Sequence[Quantile],
                    accuracy: int = SKETCH_ACCURACY, others: Sequence[Column] = ()) -> DataFrame:
    """One row per key that has at least one non-NULL value; a column is NULL where its values all are.

    ``others`` are named aggregates that the first pass computes as well; with them every key has a row.
    """
    keys = list(keys)
    df = df.withColumns({f"_v{i}": q.value.cast("double") for i, q in enumerate(wanted)})
    values = df.select(*keys, *[f"_v{i}" for i in range(len(wanted))])

    # Pass 1: counts and brackets. The sketch errs by at most n/accuracy ranks (the bound that percentile_approx
    # states); three times that on either side holds the wanted order statistics. Groups of up to ``accuracy`` values keep all of them.
    slack = 3.0 / accuracy
    measures, brackets = [], []
    for i, q in enumerate(wanted):
        v = F.col(f"_v{i}")
        low, high = max(q.p - slack, 0.0), min(q.p + slack, 1.0)
        measures += [F.count(v).alias(f"_n{i}"),
                     F.percentile_approx(v, [low, high], accuracy).alias(f"_b{i}")]
        open_low = (F.col(f"_n{i}") <= accuracy) | F.lit(low == 0.0)
        open_high = (F.col(f"_n{i}") <= accuracy) | F.lit(high == 1.0)
        brackets += [F.when(open_low, F.lit(float("-inf"))).otherwise(F.col(f"_b{i}")[0]).alias(f"_lo{i}"),
                     F.when(open_high, F.lit(float("inf"))).otherwise(F.col(f"_b{i}")[1]).alias(f"_hi{i}")]
    sketch = whole((df if others else values).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *measures, *others))
    own = [c for c in sketch.columns if c not in keys][1 + 2 * len(wanted):]
    bounds = sketch.select(*keys, "_rows", *[f"_n{i}" for i in range(len(wanted))], *brackets)

    # Pass 2: each value is either below a bracket (only counted) or inside it (counted per value).
    placed = attach(values, bounds, keys, "_rows")
    below_or_inside = []
    for i in range(len(wanted)):
        v = F.col(f"_v{i}")
        slot = F.when(v < F.col(f"_lo{i}"), F.lit(None).cast("double")).otherwise(v)
        below_or_inside.append(F.when(v.isNotNull() & (v <= F.col(f"_hi{i}")), F.struct(
            F.lit(i).alias("target"), slot.alias("v"), F.col(f"_n{i}").alias("n"))))
    counted = (placed.select(*keys, F.explode(F.array_compact(F.array(*below_or_inside))).alias("_hit"))
               .groupBy(*keys, F.col("_hit.target").alias("_target"), F.col("_hit.v").alias("_v"),
                        F.col("_hit.n").alias("_n"))
               .agg(F.count(F.lit(1)).alias("_c")))

    # The NULL slot (everything below the bracket) sorts first, so the running count is the global rank.
    running = Window.partitionBy(*keys, "_target").orderBy(F.col("_v").asc_nulls_first())
    p = F.element_at(F.array(*[F.lit(float(q.p)) for q in wanted]), F.col("_target") + 1)
    position = p * (F.col("_n") - 1)
    ranked = (counted.withColumn("_to", F.sum("_c").over(running))
              .withColumn("_from", F.col("_to") - F.col("_c"))
              .withColumn("_pos", position))

    def at(rank: Column, i: int) -> Column:
        here = (F.col("_target") == i) & (F.col("_from") <= rank) & (rank < F.col("_to"))
        missed = F.raise_error(F.lit("quantile bracket missed its order statistic")).cast("double")
        found = F.max(F.when(here, F.coalesce(F.col("_v"), missed)))
        wanted_here = F.max(F.col("_target") == i)  # a miss above the bracket has no row at all
        return F.when(wanted_here & found.isNull(), missed).otherwise(found)

    picks = []
    for i, _ in enumerate(wanted):
        picks += [at(F.floor("_pos"), i).alias(f"_f{i}"), at(F.ceil("_pos"), i).alias(f"_c{i}"),
                  F.max(F.when(F.col("_target") == i, F.col("_pos") - F.floor("_pos"))).alias(f"_w{i}")]
    picked = ranked.groupBy(*keys).agg(*picks)
    found = picked.select(*keys, *[
        (F.col(f"_f{i}") + (F.col(f"_c{i}") - F.col(f"_f{i}")) * F.col(f"_w{i}")).alias(q.name)
        for i, q in enumerate(wanted)])
    return sketch.select(*keys, *own).join(found, keys, "left") if others else found
