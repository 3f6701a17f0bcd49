"""Species sets in long form (one row per site and species) and their distance to a reference set.

Only counts travel: |a ∩ b| is a join, |a ∪ b| = |a| + |b| − |a ∩ b|; no set is collected in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, with their 1-based ``rank`` (pruned before the shuffle)."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def reference_union(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of several lists per key: the distinct species."""
    return lists.select(*keys, "species").distinct()


def _distance(common: Column, own: Column, reference: Column) -> Column:
    union = own + reference - common
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - common / union)


def jaccard_to_reference(lists: DataFrame, reference: DataFrame, keys: Sequence[str], site: Sequence[str]) -> DataFrame:
    """Distance of each site's species (distinct rows keys, site, species) to the reference (keys, species)."""
    keys, site = list(keys), list(site)
    sizes = reference.groupBy(*keys).agg(F.count(F.lit(1)).alias("_reference"))
    counted = lists.join(reference.withColumn("_in", F.lit(1)), [*keys, "species"], "left").groupBy(*keys, *site).agg(
        F.count(F.lit(1)).alias("_own"), F.count("_in").alias("_common"))
    return counted.join(sizes, keys, "left").select(*keys, *site, _distance(
        F.col("_common"), F.col("_own"), F.coalesce("_reference", F.lit(0))).alias("distance"))


def jaccard_without_hosted(lists: DataFrame, forests: DataFrame, folds: DataFrame, keys: Sequence[str],
                           site: Sequence[str]) -> DataFrame:
    """Distance of each site in each fold (keys, group), where the forests hosted by that group have left.

    ``forests`` has keys, forest, group (the host) and species. A species leaves the reference of a fold only if
    no other group hosts a forest with it; so per species the number of hosting groups, and the host if it is a
    single one, say everything. Folds that host no forest share one answer, computed once.
    """
    keys, site = list(keys), list(site)
    hosts = forests.groupBy(*keys, "species").agg(
        F.min("group").alias("_one"), F.max("group").alias("_other"))
    only = F.when(F.col("_one") == F.col("_other"), F.col("_one"))
    reference = hosts.select(*keys, "species", only.alias("_only"), F.lit(1).alias("_in"))
    full = reference.groupBy(*keys).agg(F.count(F.lit(1)).alias("_reference"))
    lost = reference.where(F.col("_only").isNotNull()).groupBy(*keys, F.col("_only").alias("group")).agg(
        F.count(F.lit(1)).alias("_reference_lost"))

    # species of each site by the only group that hosts them (NULL: several hosts, or not in the reference)
    by_host = lists.join(reference, [*keys, "species"], "left").groupBy(*keys, *site, "_only").agg(
        F.count(F.lit(1)).alias("_n"), F.count("_in").alias("_c"))
    totals = by_host.groupBy(*keys, *site).agg(F.sum("_n").alias("_own"), F.sum("_c").alias("_common"))
    common_lost = by_host.where(F.col("_only").isNotNull()).select(
        *keys, *site, F.col("_only").alias("group"), F.col("_c").alias("_common_lost"))
    every = folds.select(*keys, "group").join(totals, keys).join(full, keys, "left")
    joined = every.join(lost, [*keys, "group"], "left").join(common_lost, [*keys, *site, "group"], "left")
    zero = F.lit(0)
    return joined.select(*keys, "group", *site, _distance(
        F.col("_common") - F.coalesce("_common_lost", zero), F.col("_own"),
        F.coalesce("_reference", zero) - F.coalesce("_reference_lost", zero)).alias("distance"))


def beta_parts(lists: DataFrame, keys: Sequence[str], site: str) -> DataFrame:
    """Dissimilarity of many sites at once and its parts: turnover (Simpson) and nestedness, per key.

    ``lists`` has keys, site and species; repeated rows count once, rows without a site or species not at all. No pair of sites is
    listed. The species that two sites share, summed over all pairs, are Σ k(k−1)/2 over the number k of sites of each species; the
    smaller of the two richnesses, summed over all pairs, is Σ r·(how many richer sites follow), taken from the number of sites of
    each richness, so ties are one row. Where no species differs (or there is one site) the parts are 0.
    """
    keys = list(keys)
    known = lists.where(F.col(site).isNotNull() & F.col("species").isNotNull()).select(*keys, site, "species").distinct()
    half = lambda n: n * (n - 1) / 2
    species = known.groupBy(*keys, "species").agg(F.count(F.lit(1)).alias("_k")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("species"), F.sum("_k").alias("_records"), F.sum(half(F.col("_k").cast("double"))).alias("_shared"))
    richness = known.groupBy(*keys, site).agg(F.count(F.lit(1)).alias("_r")).groupBy(*keys, "_r").agg(F.count(F.lit(1)).alias("_n"))
    richer = Window.partitionBy(*keys).orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    n, r = F.col("_n").cast("double"), F.col("_r").cast("double")
    pairs = richness.withColumn("_above", F.coalesce(F.sum("_n").over(richer), F.lit(0)).cast("double")).groupBy(*keys).agg(
        F.sum("_n").alias("sites"), F.sum(r * (n * F.col("_above") + half(n))).alias("_least"))
    total = F.col("_records").cast("double")
    # Over all pairs the richnesses add up to (sites − 1) × records.
    least, most = F.col("_least") - F.col("_shared"), (F.col("sites") - 1) * total - F.col("_least") - F.col("_shared")
    common = total - F.col("species")
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    sorensen, turnover = ratio(least + most, 2 * common + least + most), ratio(least, common + least)
    joined = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    return pairs.alias("p").join(species.alias("s"), joined).select(
        *[F.col(f"p.{k}").alias(k) for k in keys], "sites", "species", sorensen.alias("dissimilarity"), turnover.alias("turnover"),
        (sorensen - turnover).alias("nestedness"))
