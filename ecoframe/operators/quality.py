"""Quality-control report: one row per problem, with kind, target and detail.

``target`` is a file name, or the site for problems of a whole site. Rules that look at one row at a time share
one pass over the table; rules about repeated keys count first and join the few repeated keys back, or, where a problem is told
by its key alone, give out the key as often as it is repeated.

Row order, where it matters (first occurrence wins), is named by ``order`` columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecoframe import constants as C
from ecoframe.functions.scalars import valid_coordinate, years_in_text
from ecoframe.operators.skew import attach, later_keys, repeated, shared, whole

REPORT = ["kind", "target", "detail"]


def _problem(when: Column, kind: str, target: Column, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), target.alias("target"), detail.alias("detail")))


def _explode_problems(rows: DataFrame, *problems: Column) -> DataFrame:
    found = F.array_compact(F.array(*problems))
    return rows.select(F.explode(found).alias("_p")).select("_p.kind", "_p.target", "_p.detail")


def _rows(df: DataFrame, kind: str, target: str, detail: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col(target).alias("target"), detail.alias("detail"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("NULL"))
                      for p in parts])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- recordings ---------------------------------------------------------------------------------------

def modal_rate(recordings: DataFrame) -> DataFrame:
    """Most frequent sampling rate per site among valid recordings; the smallest of equally frequent ones."""
    counted = (recordings.where(F.col("error").isNull() & F.col("site").isNotNull())
               .groupBy("site", "rate_hz").agg(F.count(F.lit(1)).alias("_c")))
    return counted.groupBy("site").agg(
        F.max_by("rate_hz", F.struct(F.when(F.col("rate_hz").isNotNull(), F.col("_c")).alias("c"),
                                     (-F.col("rate_hz")).alias("r"))).alias("modal_rate_hz"),
        F.sum("_c").alias("site_recordings"))


def recording_problems(recordings: DataFrame, min_duration_s: float = C.MIN_DURATION_S) -> DataFrame:
    """Row-by-row rules on recordings: unreadable, wrong folder, short, not mono, rate unlike the site's."""
    valid = F.col("error").isNull()
    with_mode = attach(recordings, modal_rate(recordings), ["site"], "site_recordings", how="left")
    return _explode_problems(
        with_mode,
        _problem(~valid, C.QC_READ_ERROR, F.col("file"), F.col("error")),
        _problem(valid & ~F.col("site").eqNullSafe(F.col("source_site")), C.QC_SITE_MISMATCH, F.col("file"),
                 _text("name says ", F.col("site"), ", folder says ", F.col("source_site"))),
        _problem(valid & (F.col("duration_s") < min_duration_s), C.QC_SHORT, F.col("file"),
                 _text(F.col("duration_s"), f" s < {min_duration_s} s")),
        _problem(valid & ~F.col("channels").eqNullSafe(F.lit(1)), C.QC_NOT_MONO, F.col("file"),
                 _text(F.col("channels"), " channels")),
        _problem(valid & ~F.col("rate_hz").eqNullSafe(F.col("modal_rate_hz")), C.QC_RATE_MISMATCH, F.col("file"),
                 _text(F.col("rate_hz"), " Hz; most of site ", F.col("site"), ": ", F.col("modal_rate_hz"), " Hz")))


def repeated_names(recordings: DataFrame, order: Sequence[str]) -> DataFrame:
    """Second and later files of one name; which of them comes first (``order``) does not show in a problem."""
    return _rows(later_keys(recordings, ["file"]), C.QC_DUPLICATE_RECORDING, "file", F.lit("file name repeated"))


def repeated_content(recordings: DataFrame) -> DataFrame:
    return _rows(repeated(recordings.select("file", "sha256"), ["sha256"]), C.QC_DUPLICATE_RECORDING, "file",
                 _text("same content as another file (sha256 ", F.substring("sha256", 1, 12), ")"))


def repeated_clock(recordings: DataFrame) -> DataFrame:
    """Two files of one site that start together: more than one recorder under one site name."""
    valid = recordings.where(F.col("error").isNull()).select("file", "site", "clock_start")
    return _rows(repeated(valid, ["site", "clock_start"]), C.QC_SAME_CLOCK, "file",
                 _text("another file of ", F.col("site"), " starts at ", F.col("clock_start")))


# --- annotations ----------------------------------------------------------------------------------------

def repeated_annotations(detections: DataFrame, order: Sequence[str]) -> DataFrame:
    """Second and later annotations alike; which of them comes first (``order``) does not show in a problem."""
    return _rows(later_keys(detections, ["file", "species", "start_s", "end_s"]), C.QC_DUPLICATE_ANNOTATION, "file",
                 _text(F.col("species"), " ", F.col("start_s"), "–", F.col("end_s"), " s"))


def files_of(recordings: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per file name: site and duration of its first valid recording."""
    valid = F.col("error").isNull()
    first = F.min_by(F.struct("site", "duration_s"), F.when(valid, F.struct(*order)))
    return recordings.groupBy("file").agg(first.alias("_first"), F.bool_or(valid).alias("_valid")).select(
        "file", "_valid", F.when(F.col("_valid"), F.col("_first.site")).alias("_site"),
        F.when(F.col("_valid"), F.col("_first.duration_s")).alias("_duration"), F.lit(True).alias("_known"))


def names_of(detections: DataFrame, recordings: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per file name of either side: its annotations ``_n`` and the columns of :func:`files_of`, NULL where it has none.

    A missing name is unlike any other: it has a row for each side.
    """
    sizes = detections.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    return whole(sizes.join(files_of(recordings, order), "file", "full"))


def annotation_problems(detections: DataFrame, recordings: DataFrame, order: Sequence[str],
                        tolerance_s: float = C.END_TOLERANCE_S, names: DataFrame | None = None) -> DataFrame:
    """Incomplete annotations, wrong site and times outside the audio, in one pass over the joined rows.

    ``names`` is the result of :func:`names_of`, where other rules read it too.
    """
    if names is None:
        sizes = detections.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
        names = sizes.join(files_of(recordings, order), "file", "left")
    joined = attach(detections, names.where(F.col("_n").isNotNull()), ["file"], "_n")
    start, end = F.col("start_s"), F.col("end_s")
    outside = ((end > F.col("_duration") + tolerance_s) | (start < 0) | (end < start))
    known = F.coalesce(F.col("_valid"), F.lit(False))
    return _explode_problems(
        joined,
        _problem(F.col("species").isNull() | start.isNull() | end.isNull(), C.QC_INCOMPLETE_ANNOTATION,
                 F.col("file"), F.lit("species, start or end missing")),
        _problem(known & ~F.col("site").eqNullSafe(F.col("_site")), C.QC_SITE_MISMATCH, F.col("file"),
                 _text("annotation says ", F.col("site"), ", name says ", F.col("_site"))),
        _problem(known & start.isNotNull() & end.isNotNull() & outside, C.QC_ANNOTATION_OUTSIDE_AUDIO,
                 F.col("file"), _text(start, "–", end, " s in ", F.col("_duration"), " s of audio")))


def orphan_files(detections: DataFrame, recordings: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Annotated files without audio, and audio files without any annotation.

    One grouping of the names of both sides, as bits; a missing name is unlike any other. ``names`` is the result of
    :func:`names_of`, where other rules read it too.
    """
    if names is not None:
        return _orphans(names, F.col("_n").isNotNull(), F.col("_known").isNotNull())
    names = detections.select("file", F.lit(1).alias("_side")).union(recordings.select("file", F.lit(2).alias("_side")))
    sides = names.groupBy("file").agg(F.bit_or("_side").alias("_sides"))
    return _orphans(sides, F.col("_sides") != 2, F.col("_sides") != 1)


def _orphans(names: DataFrame, annotated: Column, audio: Column) -> DataFrame:
    return _explode_problems(
        names,
        _problem(annotated & (~audio | F.col("file").isNull()), C.QC_ANNOTATION_WITHOUT_AUDIO, F.col("file"),
                 F.lit("annotated file is not among the recordings")),
        _problem(audio & (~annotated | F.col("file").isNull()), C.QC_AUDIO_WITHOUT_ANNOTATION, F.col("file"),
                 F.lit("recording without annotation")))


# --- points ---------------------------------------------------------------------------------------------

def point_problems(points: DataFrame, order: Sequence[str]) -> DataFrame:
    """Coordinates that are not numbers or out of range, and sites listed more than once."""
    invalid = points.where(~valid_coordinate(F.col("latitude"), F.col("longitude")))
    return _union([
        _rows(later_keys(points, ["site"]), C.QC_DUPLICATE_POINT, "site", F.lit("site repeated in the points table")),
        _rows(invalid, C.QC_INVALID_COORDINATE, "site",
              _text("lat=", F.col("latitude"), ", lon=", F.col("longitude")))])


def first_point(points: DataFrame, order: Sequence[str]) -> DataFrame:
    declared = ["declared_rate_hz", "declared_year", "annotated_minutes"]
    return points.groupBy("site").agg(F.min_by(F.struct(*declared), F.struct(*order)).alias("_p")).select(
        "site", "_p.*", F.lit(True).alias("_point"))


def site_problems(recordings: DataFrame, points: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sites without a point, years outside the declared ones, and file counts unlike the declared minutes."""
    valid = recordings.where(F.col("error").isNull() & F.col("site").isNotNull())
    # distinct years first, so that the set collected per site is bounded by the number of years
    per_year = valid.groupBy("site", F.year("clock_start").alias("year")).agg(F.count(F.lit(1)).alias("_c"))
    per_site = per_year.groupBy("site").agg(F.sum("_c").alias("_n"), F.collect_set("year").alias("_years"))
    joined = per_site.join(first_point(points, order), "site", "left").withColumn(
        "_declared", years_in_text(F.col("declared_year")))
    point = F.coalesce(F.col("_point"), F.lit(False))
    extra_year = F.size(F.array_except("_years", "_declared")) > 0
    return _explode_problems(
        joined,
        _problem(~point, C.QC_SITE_WITHOUT_POINT, F.col("site"), F.lit("site is not in the points table")),
        _problem(point & (F.size("_declared") > 0) & extra_year, C.QC_YEAR_OUTSIDE_DECLARED, F.col("site"),
                 _text("files of ", F.array_sort("_years"), "; declared ", F.array_sort("_declared"))),
        _problem(point & (F.col("_n") != F.col("annotated_minutes")), C.QC_MINUTES_MISMATCH, F.col("site"),
                 _text(F.col("_n"), " recordings; declared ", F.col("annotated_minutes"), " minutes")))


def declared_rate_problems(recordings: DataFrame, points: DataFrame, order: Sequence[str]) -> DataFrame:
    """Recordings whose rate differs from the one declared for their site."""
    valid = recordings.where(F.col("error").isNull() & F.col("site").isNotNull())
    sizes = valid.groupBy("site").agg(F.count(F.lit(1)).alias("_n"))
    declared = sizes.join(first_point(points, order).where(F.col("declared_rate_hz").isNotNull()), "site")
    joined = attach(valid.select("file", "site", "rate_hz"),
                    declared.select("site", "_n", "declared_rate_hz"), ["site"], "_n", spread=["file", "rate_hz"])
    different = joined.where(~F.col("rate_hz").cast("double").eqNullSafe(F.col("declared_rate_hz").cast("double")))
    return _rows(different, C.QC_DECLARED_RATE_MISMATCH, "file",
                 _text(F.col("rate_hz"), " Hz; declared ", F.col("declared_rate_hz").cast("int"), " Hz"))


# --- the report -------------------------------------------------------------------------------------------

def quality_report(recordings: DataFrame, detections: DataFrame, points: DataFrame | None = None,
                   min_duration_s: float = C.MIN_DURATION_S, tolerance_s: float = C.END_TOLERANCE_S,
                   recording_order: Sequence[str] = ("path",), detection_order: Sequence[str] = ("ordinal",),
                   point_order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """All rules as one table; an input without problems gives an empty table with the same columns.

    Recordings and annotations pass one exchange each, from which every rule reads: neither input runs twice. The rules about file
    names of both sides read one table of names. No problem shows which annotation comes first, so ``detection_order`` is not
    carried along; annotations that are alike in all columns are split by their origin where they are many.
    """
    recordings = shared(recordings.select(*dict.fromkeys([
        "file", "site", "source_site", "clock_start", "duration_s", "rate_hz", "channels", "sha256", "error",
        *recording_order])), "file", *recording_order)
    key = ["file", "species", "start_s", "end_s"]
    detections = whole(detections.select(*key, "site").hint("rebalance", *[F.col(c) for c in key]))
    names = names_of(detections, recordings, recording_order)
    parts = [recording_problems(recordings, min_duration_s),
             repeated_names(recordings, recording_order),
             repeated_content(recordings),
             repeated_clock(recordings),
             repeated_annotations(detections, detection_order),
             annotation_problems(detections, recordings, recording_order, tolerance_s, names),
             orphan_files(detections, recordings, names)]
    if points is not None:
        parts += [point_problems(points, point_order),
                  site_problems(recordings, points, point_order),
                  declared_rate_problems(recordings, points, point_order)]
    return _union(parts)


def problems_by_kind(report: DataFrame) -> DataFrame:
    return report.groupBy("kind").agg(F.count(F.lit(1)).alias("problems"))
