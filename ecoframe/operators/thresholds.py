"""Precision and sensitivity of a recogniser at every threshold, from a stratified sample of checked clips.

A clip counts 1 / p, where p is the probability with which its stratum was drawn. Running sums over falling scores give all
thresholds at once. They are made in two steps, so that no key passes through one task: scores are cut into pieces of about equal
size, sums run within a piece, and the totals of the pieces before it are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecoframe.operators.skew import attach
from ecoframe.session import durable

PIECES = 64


def _running(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``sum_<column>`` over all rows of the key with a score at least as high; ``rows`` have one row per key and score."""
    keys = list(keys)
    ahead = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy(*keys, "_piece").agg(*[F.sum(c).alias(f"_{c}") for c in columns], F.count(F.lit(1)).alias("_rows"))
    offsets = pieces.select(*keys, "_piece", "_rows", *[F.coalesce(F.sum(f"_{c}").over(ahead), F.lit(0.0)).alias(f"_off_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_piece").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in columns])
    joined = summed.join(offsets.drop("_rows"), [*keys, "_piece"])
    return joined.select(*rows.columns, *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"sum_{c}") for c in columns])


def threshold_curve(clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and distinct score: precision, recall and their standard errors if clips from this score on are accepted.

    ``clips`` has keys, stratum, score, truth and p (selection probability of the stratum, > 0). The variance is that of a ratio in
    a stratified sample without replacement; a stratum of one clip adds none. Rows without a score, truth or probability were
    not checked and are left out.
    """
    keys = list(keys)
    checked = clips.where("score is not null and truth is not null and p > 0").select(
        *keys, "stratum", F.col("score").cast("double").alias("score"), F.col("truth").cast("int").alias("truth"), (1 / F.col("p")).alias("_w"))
    rows = durable(checked.groupBy(*keys, "stratum", "score").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("truth").cast("double").alias("tp"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("truth")).alias("wtp")))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("score", [i / PIECES for i in range(1, PIECES)], 10_000).alias("_cuts"), F.count(F.lit(1)).alias("_rows"))
    placed = attach(rows, cuts, keys, "_rows").withColumn(
        "_piece", F.size(F.filter("_cuts", lambda c: c > F.col("score")))).drop("_cuts", "_rows")

    # What a stratum adds to the variance: k · (Σe² − (Σe)² / size), with k = N² (1 − size / N) / (size (size − 1)).
    strata = rows.groupBy(*keys, "stratum").agg(
        F.sum("n").alias("size"), F.sum("w").alias("_population"), F.sum("tp").alias("pos"), F.count(F.lit(1)).alias("_rows"))
    k = F.when(F.col("size") > 1, F.col("_population") * F.greatest(F.col("_population") - F.col("size"), F.lit(0.0))
               / (F.col("size") * (F.col("size") - 1))).otherwise(0.0)
    running = _running(placed, [*keys, "stratum"], ["n", "tp"])
    met = attach(running, strata.select(*keys, "stratum", "size", "pos", k.alias("k"), "_rows"), [*keys, "stratum"], "_rows")

    # The sums over strata move only where a stratum has clips: each row adds the step of its own stratum.
    sel, tp = F.col("sum_n"), F.col("sum_tp")
    sel0, tp0 = sel - F.col("n"), tp - F.col("tp")
    step = lambda after, before: (F.col("k") * (after - before)) / F.col("size")
    moves: dict[str, Column] = {
        "w": F.col("w"), "wtp": F.col("wtp"), "ktp": F.col("k") * F.col("tp"), "kfp": F.col("k") * (F.col("n") - F.col("tp")),
        "tt": step(tp * tp, tp0 * tp0), "ts": step(tp * sel, tp0 * sel0), "ss": step(sel * sel, sel0 * sel0),
        "tpos": step(tp * F.col("pos"), tp0 * F.col("pos"))}
    steps = met.groupBy(*keys, "_piece", "score").agg(*[F.sum(c).alias(name) for name, c in moves.items()])
    curve = _running(steps, keys, list(moves))
    whole = strata.groupBy(*keys).agg(F.sum(k * F.col("pos")).alias("kpos"), F.sum(k * F.col("pos") * F.col("pos") / F.col("size")).alias("pp"))
    total = rows.groupBy(*keys).agg(F.sum("wtp").alias("all_wtp"), F.count(F.lit(1)).alias("_rows"))
    curve = attach(curve, total.join(whole, keys), keys, "_rows")

    s = {name: F.col(f"sum_{name}") for name in moves}
    p, r = F.try_divide(s["wtp"], s["w"]), F.try_divide(s["wtp"], F.col("all_wtp"))
    var_p = s["ktp"] * (1 - p) * (1 - p) + s["kfp"] * p * p - (s["tt"] - 2 * p * s["ts"] + p * p * s["ss"])
    var_r = s["ktp"] * (1 - r) * (1 - r) + (F.col("kpos") - s["ktp"]) * r * r - (s["tt"] - 2 * r * s["tpos"] + r * r * F.col("pp"))
    error = lambda v, of: F.try_divide(F.sqrt(F.greatest(v, F.lit(0.0))), of)
    return curve.select(*keys, F.col("score").alias("threshold"), s["w"].alias("accepted"), p.alias("precision"), r.alias("recall"),
                        error(var_p, s["w"]).alias("se_precision"), error(var_r, F.col("all_wtp")).alias("se_recall"))
