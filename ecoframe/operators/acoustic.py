"""Campaigns, assignment of recordings to campaigns, effort, richness and the analytical table."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecoframe.functions.scalars import campaign_id, rarefaction_term
from ecoframe.operators.skew import whole

CONTEXT = ["site", "validation_group", "latitude", "longitude", "recorder"]


def campaign_table(recordings: DataFrame) -> DataFrame:
    """One campaign per site, bounded by its own valid recordings; all uses in one plan read one grouping."""
    return whole(recordings.where(F.col("error").isNull() & F.col("site").isNotNull())
            .groupBy("site").agg(
                F.min("clock_start").alias("clock_start"), F.max("clock_start").alias("clock_end"),
                F.count(F.lit(1)).alias("n_recordings"),
                F.coalesce(F.sum("duration_s") / 60, F.lit(0.0)).alias("effort_min"))
            .select("site", campaign_id(F.col("site")).alias("campaign_id"), "clock_start", "clock_end",
                    "n_recordings", "effort_min"))


def _micros(clock: Column) -> Column:
    """Microseconds of a clock time without zone since 1970."""
    seconds = F.unix_date(F.to_date(clock)).cast("bigint") * 86400 + F.hour(clock) * 3600 + F.minute(clock) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), clock) * 1_000_000).cast("bigint")


def _part(micros: Column, days: int) -> Column:
    """Which span of ``days`` a time falls in, exactly."""
    size = F.lit(days * 86_400_000_000)
    return ((micros - F.pmod(micros, size)) / size).cast("bigint")


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Disjoint pieces of closed spans that come sorted by (_site, _span, _from), each with the span of highest rank over it.

    Only the spans open at one time are kept, in a heap with the highest rank on top.
    """
    key, open_, at, pieces = None, [], 0, []

    def until(limit):
        nonlocal at
        while open_ and at <= limit:
            _, end, campaign = open_[0]
            if end < at:
                heapq.heappop(open_)
                continue
            end = min(end, limit)
            pieces.append((key[0], at, end, campaign))
            at = end + 1

    def taken():
        out = pd.DataFrame(pieces, columns=["_site", "_from", "_to", "_campaign"])
        pieces.clear()
        return out

    for batch in batches:
        columns = (batch[c].tolist() for c in ("_site", "_span", "_from", "_to", "_rank", "_campaign"))
        for site, span, start, end, rank, campaign in zip(*columns):
            if (site, span) != key:
                until(math.inf)
                key, open_ = (site, span), []
            until(start - 1)
            at = start
            heapq.heappush(open_, (-rank, end, campaign))
        yield taken()
    until(math.inf)
    yield taken()


def campaign_pieces(campaigns: DataFrame, campaign_order: Sequence[str], bucket_days: int) -> DataFrame:
    """Disjoint pieces of the campaigns of each site, once for each bucket of days they touch: _site, _bucket, _from, _to
    (microseconds, both included), _campaign.

    Where campaigns overlap the last one by ``campaign_order`` is kept. They are swept over in spans of 16 buckets, so a site
    with very many campaigns is spread over time.
    """
    wide_days = 16 * bucket_days
    wide = F.lit(wide_days * 86_400_000_000)
    spans = campaigns.where((F.col("clock_start") <= F.col("clock_end")) & F.col("site").isNotNull()).select(
        F.col("site").alias("_site"), _micros(F.col("clock_start")).alias("_from"), _micros(F.col("clock_end")).alias("_to"),
        F.col("campaign_id").alias("_campaign"), F.struct(*campaign_order).alias("_order"))
    spans = spans.withColumn("_span", F.explode(F.sequence(_part(F.col("_from"), wide_days), _part(F.col("_to"), wide_days))))
    clipped = spans.withColumns({
        "_rank": F.row_number().over(Window.partitionBy("_site", "_span").orderBy("_order")),
        "_from": F.greatest(F.col("_from"), F.col("_span") * wide), "_to": F.least(F.col("_to"), (F.col("_span") + 1) * wide - 1)}).drop("_order")
    kinds = {f.name: f.dataType.simpleString() for f in clipped.schema}
    # The window has brought each group into one partition, which the sort within partitions keeps.
    pieces = clipped.sortWithinPartitions("_site", "_span", "_from").mapInPandas(
        _sweep, f"_site {kinds['_site']}, _from bigint, _to bigint, _campaign {kinds['_campaign']}")
    return pieces.withColumn("_bucket", F.explode(F.sequence(_part(F.col("_from"), bucket_days), _part(F.col("_to"), bucket_days))))


def assign_campaigns(recordings: DataFrame, campaigns: DataFrame, campaign_order: Sequence[str] = ("ordinal",),
                     strict: bool = True, bucket_days: int = 32) -> DataFrame:
    """Each valid recording with the campaign of its site whose interval holds its clock start.

    Both bounds are included; of several matching campaigns the last one (by ``campaign_order``) wins. With
    ``strict`` a valid recording outside every campaign fails the job; otherwise its campaign_id is NULL.

    The campaigns of a site are first cut into disjoint pieces, so a recording meets at most one of them and is not grouped
    again: rows that repeat stay as many as they are. The range condition becomes an equality on (site, bucket of days),
    which spreads even a site with very many recordings over time.
    """
    valid = recordings.where(F.col("error").isNull()).withColumn("_at", _micros(F.col("clock_start")))
    valid = valid.withColumn("_day", _part(F.col("_at"), bucket_days))
    pieces = campaign_pieces(campaigns, campaign_order, bucket_days)
    inside = ((F.col("site") == F.col("_site")) & (F.col("_day") == F.col("_bucket")) & F.col("_at").between(F.col("_from"), F.col("_to")))
    campaign = F.col("_campaign")
    if strict:
        campaign = F.coalesce(campaign, F.raise_error(
            F.concat(F.lit("recording outside every campaign: "), F.col("file"))).cast("string"))
    return valid.join(pieces, inside, "left").select(*recordings.columns, campaign.alias("campaign_id"))


def unassigned_files(recordings: DataFrame, campaigns: DataFrame, limit: int = 5, **order) -> list[str]:
    """The first few valid files outside every campaign, for an error text."""
    loose = assign_campaigns(recordings, campaigns, strict=False, **order).where(F.col("campaign_id").isNull())
    return [r.file for r in loose.select("file").orderBy("file").limit(limit).collect()]


def species_minutes(assigned: DataFrame, detections: DataFrame) -> DataFrame:
    """Distinct minutes (files) in which each species was detected, per campaign; matched by file name only."""
    return _minutes_heard(assigned.select("campaign_id", "file").distinct(), detections)


def _minutes_heard(files: DataFrame, detections: DataFrame) -> DataFrame:
    heard = detections.where(F.col("species").isNotNull()).select("file", "species").distinct()
    return heard.join(files, "file").groupBy("campaign_id", "species").agg(F.count(F.lit(1)).alias("minutes"))


def acoustic_summary(assigned: DataFrame, detections: DataFrame, campaigns: DataFrame,
                     standard_minutes: int | None = None) -> DataFrame:
    """Effort, detected species and rarefied richness per campaign.

    ``assigned`` comes from :func:`assign_campaigns`. The common effort is ``standard_minutes``, or the
    smallest number of minutes among the campaigns when it is not given (or 0). A campaign with less effort
    than that fails the job. Minutes, effort and species read one run of the assignment.
    """
    files = whole(assigned.select("campaign_id", "file").distinct())
    minutes = whole(files.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("valid_minutes")))
    if standard_minutes:
        effort = F.lit(int(standard_minutes)).cast("bigint")
    else:
        effort = minutes.agg(F.min("valid_minutes")).scalar()
    base = campaigns.select("site", "campaign_id").join(minutes, "campaign_id", "left").select(
        "site", "campaign_id", F.coalesce("valid_minutes", F.lit(0).cast("bigint")).alias("valid_minutes"),
        effort.alias("standard_effort_min"))
    heard = _minutes_heard(files, detections).join(
        base.select("campaign_id", "valid_minutes", "standard_effort_min").distinct(), "campaign_id")
    per_campaign = heard.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("species_detected"),
        F.sum(rarefaction_term(F.col("minutes"), F.col("valid_minutes"),
                               F.col("standard_effort_min"))).alias("rarefied_richness"),
        F.array_sort(F.collect_list("species")).alias("species"))
    n, m = F.col("valid_minutes"), F.col("standard_effort_min")
    richness = F.when((m > 0) & (m <= n), F.coalesce("rarefied_richness", F.lit(0.0))).otherwise(
        F.raise_error(F.concat(F.lit("campaign without enough minutes: "), F.col("campaign_id"))).cast("double"))
    return base.join(per_campaign, "campaign_id", "left").select(
        "site", "campaign_id", "valid_minutes",
        F.coalesce("species_detected", F.lit(0).cast("bigint")).alias("species_detected"),
        "standard_effort_min", richness.alias("rarefied_richness"),
        F.coalesce(F.array_join("species", ";"), F.lit("")).alias("species"))


def _one_per_key(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df`` with a contract: a second row for a key fails the job."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(
        F.concat(F.lit(f"{name}: key is not unique: "), F.concat_ws(", ", *keys))).cast(
            grouped.schema["_row"].dataType))
    return grouped.select(*keys, checked.alias("_row")).select(*keys, "_row.*")


def analytical_table(acoustic: DataFrame, optical: DataFrame, points: DataFrame) -> DataFrame:
    """One row per site × campaign: context, acoustic summary and optical descriptors.

    A campaign without optical series has coverage_ok false; an optical series whose campaign is unknown, or a
    repeated key on either side, fails the job.
    """
    keys = ["site", "campaign_id"]
    left = _one_per_key(acoustic, keys, "acoustic summary")
    right = _one_per_key(optical, keys, "optical descriptors")
    known = acoustic.select("campaign_id").distinct().withColumn("_known", F.lit(True))
    right = right.join(known, "campaign_id", "left").withColumn("campaign_id", F.when(
        F.col("_known"), F.col("campaign_id")).otherwise(F.raise_error(
            F.concat(F.lit("optical series without acoustic campaign: "), F.col("campaign_id"))).cast("string")))
    optical_columns = [c for c in optical.columns if c not in keys]
    joined = left.join(right.select(*keys, *optical_columns), keys, "left").withColumn(
        "coverage_ok", F.coalesce("coverage_ok", F.lit(False)))
    context = _one_per_key(points.select(*CONTEXT), ["site"], "points")
    return joined.join(context, "site", "left").select(
        *CONTEXT, "campaign_id", *[c for c in acoustic.columns if c not in keys], *optical_columns)
