"""Intervals and tests for the gain of the larger model over the base model."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecoframe import constants as C
from ecoframe.functions.random import uniform
from ecoframe.functions.scalars import finite
from ecoframe.operators.ridge import (Problem, absolute_errors, coefficients, gain, held_out_errors, merged, moment_names,
                                      moments, without_each)
from ecoframe.operators.skew import rank_by_uniform

#: Replicates of a row that are drawn in one task.
CHUNK = 50


def _small(problem: Problem, df: DataFrame) -> DataFrame:
    """Marks a side that holds a few rows per problem: where problems are small, it is hashed instead of sorting
    the side that was expanded to one row per replicate."""
    return df if problem.skewed else df.hint("shuffle_hash")


def _replicates(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _key_columns(problem: Problem):
    return [F.col(k) for k in problem.keys]


def _indexed(df: DataFrame, problem: Problem, what: str, seed, portable: bool, buckets: int) -> DataFrame:
    """A dense index over ``what`` (group or row) per problem, with the number of them."""
    keys = list(problem.keys)
    drawn = df.withColumn("_u", uniform(seed, F.lit("index"), *_key_columns(problem), F.col(what), portable=portable))
    ranked = rank_by_uniform(drawn, keys, "_u", [what], "index", buckets).drop("_u")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    return problem.join(ranked, sizes, keys, weight="size")


def _draw_counts(indexed: DataFrame, problem: Problem, n_boot: int, seed, portable: bool) -> DataFrame:
    """How often each index is drawn in each resample of ``size`` draws with replacement: keys, b, index, c.

    Every indexed row stands for one draw of each replicate, so no list of draws is ever built in one place.
    """
    draws = indexed.select(*problem.keys, "index", "size", _replicates(n_boot).alias("b"))
    u = uniform(seed, F.lit("draw"), *_key_columns(problem), F.col("b"), F.col("index"), portable=portable)
    picked = draws.select(*problem.keys, "b", F.floor(u * F.col("size")).cast("bigint").alias("index"))
    return picked.groupBy(*problem.keys, "b", "index").agg(F.count(F.lit(1)).alias("c"))


def _tails(values, level: float):
    alpha = (1 - level) / 2
    return F.percentile(values, [alpha, 1 - alpha])


def fixed_error_interval(errors: DataFrame, problem: Problem, n_boot: int = 1000, level: float = C.LEVEL,
                         seed="fixed", portable: bool = False, buckets: int = 64) -> DataFrame:
    """Paired resampling of the held-out errors, taken as fixed and independent; kept for comparison."""
    keys = list(problem.keys)
    indexed = _indexed(errors, problem, "row_id", seed, portable, buckets)
    if problem.skewed:
        # rows are few beside their draws: replicates are dealt out in chunks first, and no draw is held to count it
        parts = int(errors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = indexed.select(*keys, "index", "size", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(CHUNK))).alias("_from"))
        dealt = dealt.repartition(parts, *keys, "index", "_from")
        last = F.least(F.col("_from") + CHUNK - 1, F.lit(n_boot - 1))
        draws = dealt.select(*keys, "index", "size", F.explode(F.sequence("_from", last)).alias("b"))
        u = uniform(seed, F.lit("draw"), *_key_columns(problem), F.col("b"), F.col("index"), portable=portable)
        picked = draws.select(*keys, "b", F.lit(1).alias("c"), F.floor(u * F.col("size")).cast("bigint").alias("index"))
        drawn = picked.join(indexed.select(*keys, "index", "error_base", "error_larger").hint("shuffle_hash"), [*keys, "index"])
    else:
        # few rows per problem: each draw reads its error from the problem's own list, nothing is shuffled
        listed = indexed.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("index", "error_base", "error_larger"))).alias("_errors"))
        draws = indexed.select(*keys, "index", "size").join(listed, keys).select("*", _replicates(n_boot).alias("b"))
        u = uniform(seed, F.lit("draw"), *_key_columns(problem), F.col("b"), F.col("index"), portable=portable)
        drawn = draws.select(*keys, "b", F.lit(1).alias("c"), F.element_at(
            "_errors", F.floor(u * F.col("size")).cast("int") + 1).alias("_e")).select(
            *keys, "b", "c", "_e.error_base", "_e.error_larger")
    boot = drawn.groupBy(*keys, "b").agg(
        gain(F.sum(F.col("c") * F.col("error_base")), F.sum(F.col("c") * F.col("error_larger"))).alias("g"))
    tails = boot.groupBy(*keys).agg(_tails("g", level).alias("_q"))
    observed = errors.groupBy(*keys).agg(gain(F.sum("error_base"), F.sum("error_larger")).alias("gain"))
    return observed.join(tails, keys).select(
        *keys, "gain", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"))


def refit_bootstrap_interval(problem: Problem, n_boot: int = 200, level: float = C.LEVEL, seed="refit",
                             portable: bool = False, buckets: int = 64, observed: DataFrame | None = None) -> DataFrame:
    """Resampling of whole groups that refits both models in every replicate.

    Copies of the held-out group leave the training together. Gives the percentile interval, the basic one
    (twice the gain minus the quantiles) and the mean of the replicates; a replicate that drew a single group
    is ignored. ``observed`` are held-out errors, if they are at hand.
    """
    keys, features, names = list(problem.keys), problem.features, moment_names(problem.features)
    stats = problem.group_stats()
    groups = stats.select(*keys, "group").distinct()
    indexed = _indexed(groups, problem, "group", seed, portable, buckets)
    counts = _draw_counts(indexed, problem, n_boot, seed, portable).join(
        _small(problem, indexed.select(*keys, "index", "group")), [*keys, "index"]).select(*keys, "b", "group", "c")

    weighted = counts.join(_small(problem, stats), [*keys, "group"])
    rest = without_each(weighted, [*keys, "b", "mask"], "group", features, problem.most_groups, weight="c")
    train = {n: F.col(f"t_{n}") for n in names}
    # a replicate that drew a single group leaves nothing to fit
    fits = problem.own(rest).where("t_s_w > 0").join(weighted.select(*keys, "b", "mask", "group", "c", "s_w"), [*keys, "b", "mask", "group"]).select(
        *keys, "mask", "group", "b", "c", "s_w", coefficients(train, features, problem.models, problem.penalty).alias("fit"))

    # one list of at most n_boot fits per group; rows meet it once and fan out before a map-side sum
    packed = fits.groupBy(*keys, "mask", "group").agg(
        F.max("s_w").alias("s_w"), F.collect_list(F.struct("b", "c", "fit")).alias("_fits"))
    scored = problem.join(problem.rows, packed, [*keys, "mask", "group"]).select(
        *keys, "y", *features, F.explode("_fits").alias("_f"))
    errors = absolute_errors(F.col("_f.fit"), problem.models)
    boot = scored.groupBy(*keys, F.col("_f.b").alias("b")).agg(
        gain(F.sum(F.col("_f.c") * errors["base"]), F.sum(F.col("_f.c") * errors["larger"])).alias("g"))
    replicates = boot.groupBy(*keys).agg(_tails("g", level).alias("_q"), F.avg("g").alias("replicate_mean"))

    errors_seen = held_out_errors(problem) if observed is None else observed
    seen = errors_seen.groupBy(*keys).agg(gain(F.sum("error_base"), F.sum("error_larger")).alias("gain"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    return seen.join(replicates, keys).select(
        *keys, "gain", low.alias("percentile_lower"), high.alias("percentile_upper"),
        (2 * F.col("gain") - high).alias("basic_lower"), (2 * F.col("gain") - low).alias("basic_upper"), "replicate_mean")


def fold_assignment(groups: DataFrame, keys, k: int, repetitions: int, seed, portable: bool = False,
                    buckets: int = 64) -> DataFrame:
    """keys, r, group, fold: in each repetition the groups in random order are dealt into k folds."""
    keys = list(keys)
    drawn = groups.select(*keys, "group", _replicates(repetitions).alias("r")).withColumn("_u", uniform(
        seed, F.lit("fold"), *[F.col(c) for c in keys], F.col("r"), F.col("group"), portable=portable))
    ranked = rank_by_uniform(drawn, [*keys, "r"], "_u", ["group"], "_rank", buckets)
    return ranked.select(*keys, "r", "group", (F.col("_rank") % k).cast("int").alias("fold"))


def corrected_cv_interval(problem: Problem, assignment: DataFrame, level: float = C.LEVEL) -> DataFrame:
    """Repeated k-fold validation over groups, with the variance corrected for overlapping training sets.

    ``assignment`` comes from :func:`fold_assignment`, with a ``mask`` column where responses vary. The gain is
    mean(D)/mean(B) over the folds, with D the difference and B the base MAE of a fold; its variance is the
    delta-method one times (1/J + mean(n_test/n_train)).
    """
    keys, features, names = list(problem.keys), problem.features, moment_names(problem.features)
    if "mask" not in assignment.columns:
        assignment = assignment.withColumn("mask", F.lit(0).cast("bigint"))
    stats = problem.group_stats()
    # The groups of a fold are merged under every response variant, then the other folds; the variant of the fold itself counts.
    members = assignment.select(*keys, "r", "group", "fold").distinct().join(stats, [*keys, "group"])
    folds = merged(members, [*keys, "r", "fold", "mask"], "group", features, problem.most_groups)
    rest = without_each(folds, [*keys, "r", "mask"], "fold", features, problem.most_groups)
    own = assignment.select(*keys, "r", "fold", "mask").distinct()
    tested = own.join(folds.select(*keys, "r", "fold", "mask", "s_w"), [*keys, "r", "fold", "mask"]).join(rest, [*keys, "r", "fold", "mask"])
    train = {n: F.col(f"t_{n}") for n in names}
    fits = tested.select(*keys, "r", "fold", "mask", F.col("s_w").alias("n_test"), (F.col("s_w") + F.col("t_s_w")).alias("n_all"),
                        coefficients(train, features, problem.models, problem.penalty).alias("fit"))

    # one list of at most `repetitions` fits per group and response variant
    packed = assignment.join(fits, [*keys, "r", "fold", "mask"]).groupBy(*keys, "mask", "group").agg(
        F.collect_list(F.struct("r", "fold", "n_test", "n_all", "fit")).alias("_fits")).join(
        stats.select(*keys, "mask", "group", "s_w"), [*keys, "mask", "group"])
    scored = problem.join(problem.rows, packed, [*keys, "mask", "group"]).select(
        *keys, "y", *features, F.explode("_fits").alias("_f"))
    errors = absolute_errors(F.col("_f.fit"), problem.models)
    per_fold = scored.groupBy(*keys, F.col("_f.r").alias("r"), F.col("_f.fold").alias("fold")).agg(
        F.avg(errors["base"]).alias("b"), F.avg(errors["base"] - errors["larger"]).alias("d"),
        F.max(F.try_divide(F.col("_f.n_test"), F.col("_f.n_all") - F.col("_f.n_test"))).alias("_ratio"))
    pooled = per_fold.groupBy(*keys).agg(
        F.avg("d").alias("_d"), F.avg("b").alias("_b"), F.var_samp("d").alias("_vd"), F.var_samp("b").alias("_vb"),
        F.covar_samp("d", "b").alias("_cov"), (1 / F.count(F.lit(1)) + F.avg("_ratio")).alias("_correction"))
    r = finite(F.try_divide(F.col("_d"), F.col("_b")))  # NULL where a fold leaves nothing to train on
    variance = F.try_divide(F.col("_vd") - 2 * F.col("_r") * F.col("_cov") + F.col("_r") * F.col("_r") * F.col("_vb"),
                            F.col("_b") * F.col("_b"))
    z = NormalDist().inv_cdf(1 - (1 - level) / 2)
    se = F.sqrt(F.col("_correction") * F.greatest(finite(variance), F.lit(0.0)))
    return pooled.withColumn("_r", r).select(
        *keys, F.col("_r").alias("gain"), (F.col("_r") - z * se).alias("lower"), (F.col("_r") + z * se).alias("upper"))


def permuted_groups(group_sizes: DataFrame, problem: Problem, n_perm: int, seed, portable: bool = False,
                    buckets: int = 64) -> DataFrame:
    """keys, i, group, source: in permutation i the group takes the values of ``source``, a group of equal size."""
    keys = list(problem.keys)
    fixed = group_sizes.withColumn("_u", uniform(seed, F.lit("place"), *_key_columns(problem), F.col("group"), portable=portable))
    places = rank_by_uniform(fixed, [*keys, "size"], "_u", ["group"], "place", buckets).select(*keys, "size", "group", "place")
    drawn = group_sizes.select(*keys, "size", F.col("group").alias("source"), _replicates(n_perm).alias("i")).withColumn(
        "_u", uniform(seed, F.lit("perm"), *_key_columns(problem), F.col("i"), F.col("source"), portable=portable))
    shuffled = rank_by_uniform(drawn, [*keys, "size", "i"], "_u", ["source"], "place", buckets)
    return shuffled.join(_small(problem, places), [*keys, "size", "place"]).select(*keys, "i", "group", "source")


def permutation_test(problem: Problem, feature: str, n_perm: int = 199, seed="permutation", portable: bool = False,
                     buckets: int = 64, observed: DataFrame | None = None) -> DataFrame:
    """One-sided p-value for "the larger model gains": ``feature`` is exchanged between groups of equal size.

    Whole groups exchange their values, row by row in a fixed order within the group. p = (1 + #{gain in a
    permutation ≥ observed gain}) / (1 + permutations).
    """
    keys, features, names = list(problem.keys), problem.features, moment_names(problem.features)
    larger = {"larger": problem.larger}
    one_variant = problem.rows.dropDuplicates([*keys, "row_id"]) if problem.hosted is not None else problem.rows
    placed = one_variant.select(*keys, "group", "row_id", F.col(feature).alias("_value")).withColumn(
        "_u", uniform(seed, F.lit("row"), *_key_columns(problem), F.col("row_id"), portable=portable))
    positions = rank_by_uniform(placed, [*keys, "group"], "_u", ["row_id"], "position", buckets).drop("_u")
    sizes = positions.groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("size"))
    swaps = permuted_groups(sizes, problem, n_perm, seed, portable, buckets)

    # the row at each position of the destination takes the value at that position of the source
    sources = positions.select(*keys, F.col("group").alias("source"), "position", "_value")
    moved = swaps.join(_small(problem, sources), [*keys, "source"])
    rest = [c for c in problem.rows.columns if c != feature]
    targets = positions.select(*keys, "row_id", "position").join(problem.rows.select(*rest), [*keys, "row_id"])
    permuted = moved.join(_small(problem, targets), [*keys, "group", "position"]).withColumnRenamed("_value", feature)

    by_group = permuted.groupBy(*keys, "i", "mask", "group").agg(*moments(features))
    rest = without_each(by_group, [*keys, "i", "mask"], "group", features, problem.most_groups)
    train = {n: F.col(f"t_{n}") for n in names}
    fits = problem.own(rest).where("t_s_w > 0").select(
        *keys, "i", "mask", "group", coefficients(train, features, larger, problem.penalty).alias("fit"))
    error = absolute_errors(F.col("fit"), larger)["larger"]
    permuted_error = permuted.join(fits, [*keys, "i", "mask", "group"]).groupBy(*keys, "i").agg(F.sum(error).alias("_e"))

    seen_errors = held_out_errors(problem) if observed is None else observed
    seen = seen_errors.groupBy(*keys).agg(F.sum("error_base").alias("_base"), F.sum("error_larger").alias("_larger"))
    # a permutation that changes nothing must count as equal, whatever the order of its sums
    at_least = F.col("_e") <= F.col("_larger") * (1 + 1e-12)
    tested = permuted_error.join(seen, keys).groupBy(*keys).agg(
        F.max(gain(F.col("_base"), F.col("_larger"))).alias("gain"),
        ((1 + F.count_if(at_least)) / (1 + F.count(F.lit(1)))).alias("p_value"))
    return tested.withColumn("p_value", F.when(F.col("gain").isNotNull(), F.col("p_value")))
