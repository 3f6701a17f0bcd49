"""Recordings, quality control, campaigns, richness and the analytical table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import shapes as T
from ecoframe import constants as C
from ecoframe.functions import scalars as S
from ecoframe.operators import acoustic as A
from ecoframe.operators import quality as Q
from ecoframe.operators.descriptors import optical_descriptors as descriptors


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _problems(df):
    return df.select("kind", "target", "detail")


# --- names and campaigns ----------------------------------------------------------------------------------

def filename_parse(spark, sf_dir):
    """Site, clock and folder from names built from orders; broken names and impossible dates give an error."""
    stamp = F.when(F.col("o_orderstatus") == "P", F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("1340_050240"))).when(
        F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "yyyyMMdd")).otherwise(
        F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_050240")))
    name = F.concat(F.lit("c"), F.col("o_custkey"), F.lit("_"), stamp, F.lit(".WAV"))
    rows = T.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("/a/"), F.lower("o_orderpriority"), F.lit("/"), name).alias("path"))
    file = S.base_name(F.col("path"))
    return rows.select("o_orderkey", S.folder_site(F.col("path")).alias("source_site"),
                       F.when(S.recording_name_error(file).isNull(), S.recording_site(file)).alias("site"),
                       S.recording_clock(file).alias("clock_start"),
                       S.recording_name_error(file).isNotNull().alias("rejected"))


FILENAME_PARSE = """
SELECT o_orderkey, upper(o_orderpriority) AS source_site,
       CASE WHEN ok THEN 'C' || o_custkey END AS site,
       CASE WHEN ok THEN o_orderdate::DATE + INTERVAL '5 hours 2 minutes 40 seconds' END AS clock_start,
       NOT ok AS rejected
FROM (SELECT *, o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AS ok FROM orders)"""


def source_text(spark, sf_dir):
    """Sampling-rate text, years in free text and the baseline offset of scene ids, from part columns."""
    p = T.table(spark, sf_dir, "part")
    text = F.concat(F.col("p_name"), F.lit(" "), F.col("p_size"), F.when(F.col("p_size") > 25, ",5").otherwise(".0"),
                    F.lit(" KHz"))
    text = F.when(F.col("p_type") == "SMALL", F.col("p_name")).otherwise(text)
    scene = F.concat(F.lit("S2A_N0"), F.col("p_size") + 375, F.lit("_"), F.col("p_type"))
    note = F.concat(F.lit("since "), F.col("p_size") + 1990, F.lit(" until "), F.col("p_size") + 1995)
    return p.select("p_partkey", S.rate_in_hz(text).alias("rate_hz"),
                    F.array_join(S.years_in_text(note).cast("array<string>"), ",").alias("years"),
                    S.scene_baseline(scene).alias("baseline"), S.reflectance_offset(scene).alias("offset_dn"),
                    F.round(S.scene_reflectance(F.col("p_retailprice"), scene), 6).alias("reflectance"))


SOURCE_TEXT = """
SELECT p_partkey,
       CASE WHEN p_type <> 'SMALL' THEN CAST(p_size || CASE WHEN p_size > 25 THEN '.5' ELSE '.0' END AS DOUBLE) * 1000 END AS rate_hz,
       (p_size + 1990) || ',' || (p_size + 1995) AS years, '0' || (p_size + 375) AS baseline,
       CASE WHEN p_size + 375 >= 400 THEN 1000.0 ELSE 0.0 END::DOUBLE AS offset_dn,
       round((p_retailprice - CASE WHEN p_size + 375 >= 400 THEN 1000 ELSE 0 END) * 0.0001::DOUBLE, 6) AS reflectance
FROM part"""


def campaign_summary(spark, sf_dir):
    return A.campaign_table(T.recordings(spark, sf_dir)).withColumn("effort_min", F.round("effort_min", 6))


CAMPAIGN_SUMMARY = _with(T.RECORDINGS) + """
SELECT site, site || '-1' AS campaign_id, min(clock_start) AS clock_start, max(clock_start) AS clock_end,
       count(*) AS n_recordings, round(sum(duration_s) / 60, 6) AS effort_min
FROM recordings WHERE error IS NULL GROUP BY site"""


# --- quality control -----------------------------------------------------------------------------------------

def qc_recordings(spark, sf_dir):
    return _problems(Q.recording_problems(T.recordings(spark, sf_dir)))


QC_RECORDINGS_SELECT = f"""
SELECT '{C.QC_READ_ERROR}' AS kind, file AS target, error AS detail FROM recordings WHERE error IS NOT NULL
UNION ALL SELECT '{C.QC_SITE_MISMATCH}', file, 'name says ' || site || ', folder says ' || source_site
  FROM recordings WHERE error IS NULL AND site <> source_site
UNION ALL SELECT '{C.QC_SHORT}', file, duration_s || ' s < 55.0 s' FROM recordings WHERE error IS NULL AND duration_s < 55
UNION ALL SELECT '{C.QC_NOT_MONO}', file, channels || ' channels' FROM recordings WHERE error IS NULL AND channels <> 1
UNION ALL SELECT '{C.QC_RATE_MISMATCH}', file, rate_hz || ' Hz; most of site ' || site || ': ' || modal_rate || ' Hz' FROM recordings JOIN modal USING (site)
  WHERE error IS NULL AND rate_hz <> modal_rate"""
MODAL = """
rates AS (SELECT site, rate_hz, count(*) AS c FROM recordings WHERE error IS NULL GROUP BY ALL),
modal AS (SELECT site, rate_hz AS modal_rate FROM rates
          QUALIFY row_number() OVER (PARTITION BY site ORDER BY c DESC, rate_hz) = 1)"""
QC_RECORDINGS = _with(T.RECORDINGS, MODAL) + QC_RECORDINGS_SELECT


def qc_mode_divergence(spark, sf_dir):
    """Modal size per brand (smallest on ties) and how many parts differ from it."""
    parts = T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("site"), F.col("p_size").alias("rate_hz"),
                                                  F.lit(None).cast("string").alias("error"))
    modes = Q.modal_rate(parts)
    differ = Q.attach(parts, modes, ["site"], "site_recordings").where(F.col("rate_hz") != F.col("modal_rate_hz"))
    return differ.groupBy("site", "modal_rate_hz").agg(F.count(F.lit(1)).alias("divergent"))


QC_MODE_DIVERGENCE = """
WITH c AS (SELECT p_brand AS site, p_size, count(*) AS n FROM part GROUP BY ALL),
     m AS (SELECT site, p_size AS modal_rate_hz FROM c QUALIFY row_number() OVER (PARTITION BY site ORDER BY n DESC, p_size) = 1)
SELECT m.site, m.modal_rate_hz, count(*) AS divergent
FROM part JOIN m ON p_brand = m.site WHERE p_size <> modal_rate_hz GROUP BY ALL"""


def qc_duplicate_first(spark, sf_dir):
    return _problems(Q.repeated_names(T.recordings(spark, sf_dir), ["path"]))


QC_DUPLICATE_FIRST_SELECT = f"""
SELECT '{C.QC_DUPLICATE_RECORDING}' AS kind, file AS target, 'file name repeated' AS detail FROM
  (SELECT file, row_number() OVER (PARTITION BY file ORDER BY path) AS rn FROM recordings) WHERE rn > 1"""
QC_DUPLICATE_FIRST = _with(T.RECORDINGS) + QC_DUPLICATE_FIRST_SELECT


def qc_duplicate_all(spark, sf_dir):
    """Documents with equal content: every member of the group."""
    docs = T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("file"), F.sha2("text", 256).alias("sha256"))
    return _problems(Q.repeated_content(docs))


QC_DUPLICATE_ALL = f"""
SELECT '{C.QC_DUPLICATE_RECORDING}' AS kind, CAST(doc_id AS VARCHAR) AS target,
       'same content as another file (sha256 ' || left(sha256(text), 12) || ')' AS detail FROM
  (SELECT doc_id, text, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n > 1"""


def qc_same_clock(spark, sf_dir):
    return _problems(Q.repeated_clock(T.recordings(spark, sf_dir)))


QC_SAME_CLOCK_SELECT = f"""
SELECT '{C.QC_SAME_CLOCK}' AS kind, file AS target, 'another file of ' || site || ' starts at ' || clock_start AS detail FROM
  (SELECT file, site, clock_start, count(*) OVER (PARTITION BY site, clock_start) AS n FROM recordings WHERE error IS NULL) WHERE n > 1"""
QC_SAME_CLOCK = _with(T.RECORDINGS) + QC_SAME_CLOCK_SELECT


def qc_duplicate_annotations(spark, sf_dir):
    return _problems(Q.repeated_annotations(T.detections(spark, sf_dir), ["ordinal"]))


QC_DUPLICATE_ANNOTATIONS_SELECT = f"""
SELECT '{C.QC_DUPLICATE_ANNOTATION}' AS kind, file AS target,
       coalesce(species, 'NULL') || ' ' || start_s || '–' || end_s || ' s' AS detail FROM
  (SELECT *, row_number() OVER (PARTITION BY file, species, start_s, end_s ORDER BY ordinal) AS rn FROM detections)
WHERE rn > 1"""
QC_DUPLICATE_ANNOTATIONS = _with(T.DETECTIONS) + QC_DUPLICATE_ANNOTATIONS_SELECT


def qc_out_of_bounds(spark, sf_dir):
    """Incomplete annotations, annotations of another site, and annotations outside their audio."""
    return _problems(Q.annotation_problems(T.detections(spark, sf_dir), T.recordings(spark, sf_dir), ["path"]))


FILES = """
files AS (SELECT file, site AS rec_site, duration_s FROM recordings WHERE error IS NULL
          QUALIFY row_number() OVER (PARTITION BY file ORDER BY path) = 1)"""
QC_OUT_OF_BOUNDS_SELECT = f"""
SELECT '{C.QC_INCOMPLETE_ANNOTATION}' AS kind, file AS target, 'species, start or end missing' AS detail FROM detections
  WHERE species IS NULL OR start_s IS NULL OR end_s IS NULL
UNION ALL SELECT '{C.QC_SITE_MISMATCH}', file, 'annotation says ' || site || ', name says ' || rec_site FROM detections JOIN files USING (file) WHERE site <> rec_site
UNION ALL SELECT '{C.QC_ANNOTATION_OUTSIDE_AUDIO}', file, start_s || '–' || end_s || ' s in ' || duration_s || ' s of audio' FROM detections JOIN files USING (file)
  WHERE end_s > duration_s + 0.01 OR start_s < 0 OR end_s < start_s"""
QC_OUT_OF_BOUNDS = _with(T.RECORDINGS, T.DETECTIONS, FILES) + QC_OUT_OF_BOUNDS_SELECT


def qc_orphans(spark, sf_dir):
    return _problems(Q.orphan_files(T.detections(spark, sf_dir), T.recordings(spark, sf_dir)))


QC_ORPHANS_SELECT = f"""
SELECT DISTINCT '{C.QC_ANNOTATION_WITHOUT_AUDIO}' AS kind, file AS target, 'annotated file is not among the recordings' AS detail FROM detections d
  WHERE NOT EXISTS (SELECT 1 FROM recordings r WHERE r.file = d.file)
UNION ALL SELECT DISTINCT '{C.QC_AUDIO_WITHOUT_ANNOTATION}', file, 'recording without annotation' FROM recordings r
  WHERE NOT EXISTS (SELECT 1 FROM detections d WHERE r.file = d.file)"""
QC_ORPHANS = _with(T.RECORDINGS, T.DETECTIONS) + QC_ORPHANS_SELECT


def qc_points(spark, sf_dir):
    return _problems(Q.point_problems(T.points(spark, sf_dir), ["ordinal"]))


QC_POINTS_SELECT = f"""
SELECT '{C.QC_DUPLICATE_POINT}' AS kind, site AS target, 'site repeated in the points table' AS detail FROM
  (SELECT site, row_number() OVER (PARTITION BY site ORDER BY ordinal) AS rn FROM points) WHERE rn > 1
UNION ALL SELECT '{C.QC_INVALID_COORDINATE}', site, 'lat=' || latitude || ', lon=' || longitude FROM points
  WHERE NOT coalesce(TRY_CAST(latitude AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(longitude AS DOUBLE) BETWEEN -180 AND 180, false)"""
QC_POINTS = _with(T.POINTS) + QC_POINTS_SELECT


def qc_declared_vs_observed(spark, sf_dir):
    r, p = T.recordings(spark, sf_dir), T.points(spark, sf_dir)
    return _problems(Q.site_problems(r, p, ["ordinal"]).unionByName(Q.declared_rate_problems(r, p, ["ordinal"])))


SITES = """
first_point AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY site ORDER BY ordinal) = 1),
per_site AS (SELECT site, count(*) AS n, list(DISTINCT year(clock_start)) AS years FROM recordings WHERE error IS NULL GROUP BY site)"""
QC_DECLARED_SELECT = f"""
SELECT '{C.QC_SITE_WITHOUT_POINT}' AS kind, site AS target, 'site is not in the points table' AS detail FROM per_site WHERE site NOT IN (SELECT site FROM points)
UNION ALL SELECT '{C.QC_YEAR_OUTSIDE_DECLARED}', site, 'files of ' || list_sort(years)::VARCHAR || '; declared ' ||
    list_sort(list_transform(regexp_extract_all(declared_year, '\\d{{4}}'), lambda y: y::BIGINT))::VARCHAR FROM per_site JOIN first_point USING (site)
  WHERE len(regexp_extract_all(declared_year, '\\d{{4}}')) > 0
    AND NOT list_has_all(list_transform(regexp_extract_all(declared_year, '\\d{{4}}'), lambda y: y::BIGINT), years)
UNION ALL SELECT '{C.QC_MINUTES_MISMATCH}', site, n || ' recordings; declared ' || annotated_minutes || ' minutes' FROM per_site JOIN first_point USING (site) WHERE n <> annotated_minutes
UNION ALL SELECT '{C.QC_DECLARED_RATE_MISMATCH}', file, rate_hz || ' Hz; declared ' || declared_rate_hz::INTEGER || ' Hz' FROM recordings JOIN first_point USING (site)
  WHERE error IS NULL AND rate_hz <> declared_rate_hz"""
QC_DECLARED = _with(T.RECORDINGS, T.POINTS, SITES) + QC_DECLARED_SELECT


def qc_report(spark, sf_dir):
    report = Q.quality_report(T.recordings(spark, sf_dir), T.detections(spark, sf_dir), T.points(spark, sf_dir))
    return Q.problems_by_kind(report)


QC_REPORT = _with(T.RECORDINGS, MODAL, T.DETECTIONS, FILES, T.POINTS, SITES) + """
SELECT kind, count(*) AS problems FROM (""" + "\nUNION ALL ".join(
    f"SELECT * FROM ({q})" for q in [
        QC_RECORDINGS_SELECT, QC_DUPLICATE_FIRST_SELECT, QC_SAME_CLOCK_SELECT, QC_DUPLICATE_ANNOTATIONS_SELECT,
        QC_OUT_OF_BOUNDS_SELECT, QC_ORPHANS_SELECT, QC_POINTS_SELECT, QC_DECLARED_SELECT,
        f"SELECT '{C.QC_DUPLICATE_RECORDING}' AS kind, file AS target, '' AS detail FROM (SELECT file, count(*) OVER "
        "(PARTITION BY sha256) AS n FROM recordings) WHERE n > 1"]) + ") GROUP BY kind"


# --- campaigns, richness and the analytical table ---------------------------------------------------------------

def range_join_last_wins(spark, sf_dir):
    """Orders assigned to overlapping yearly campaigns of their customer; the later campaign wins."""
    assigned = A.assign_campaigns(T.recordings(spark, sf_dir), T.yearly_campaigns(spark, sf_dir))
    return assigned.select("path", "campaign_id")


RANGE_JOIN = _with(T.RECORDINGS, T.YEARLY_CAMPAIGNS) + """
SELECT path, campaign_id FROM (
  SELECT path, c.campaign_id, row_number() OVER (PARTITION BY path ORDER BY ordinal DESC) AS rn
  FROM recordings r JOIN campaigns c ON r.site = c.site AND r.clock_start BETWEEN c.clock_start AND c.clock_end
  WHERE error IS NULL) WHERE rn = 1"""


def _supplier_acoustic(spark, sf_dir):
    rec = T.supplier_recordings(spark, sf_dir)
    campaigns = A.campaign_table(rec).withColumn("ordinal", F.col("site"))
    assigned = A.assign_campaigns(rec, campaigns)
    return A.acoustic_summary(assigned, T.supplier_detections(spark, sf_dir), campaigns).withColumn(
        "rarefied_richness", F.round("rarefied_richness", 6))


def rarefaction(spark, sf_dir):
    """Acoustic summary of suppliers: effort, species, rarefied richness and the species list."""
    return _supplier_acoustic(spark, sf_dir)


RAREFACTION = _with(T.SUPPLIER_ACOUSTIC) + " SELECT * FROM acoustic"


def species_list(spark, sf_dir):
    """Species seen per campaign with the number of distinct minutes of each."""
    rec = T.supplier_recordings(spark, sf_dir).withColumn("campaign_id", S.campaign_id(F.col("site")))
    return A.species_minutes(rec, T.supplier_detections(spark, sf_dir))


SPECIES_LIST = """
SELECT 'S' || l_suppkey || '-1' AS campaign_id, p_brand AS species, count(DISTINCT l_orderkey) AS minutes
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"""


def _optical(spark, sf_dir):
    out = descriptors(T.supplier_series(spark, sf_dir))
    return out.select("site", "campaign_id", "cut", "composites", "composites_used", "quarters_covered",
                      "n_last_quarter", "coverage_ok", *[F.round(c, 6).alias(c) for c in (
                          "ndvi_median", "ndmi_median", "ndvi_amplitude_p90_p10", "ndmi_recent_change")])


def optical_descriptors(spark, sf_dir):
    return _optical(spark, sf_dir)


OPTICAL_DESCRIPTORS = _with(T.SUPPLIER_SERIES) + " SELECT * FROM optical"


def image_window(spark, sf_dir):
    """Composites of each supplier inside the leak-free year before its cut."""
    return T.supplier_series(spark, sf_dir).groupBy("site", "cut").agg(
        F.count(F.lit(1)).alias("composites"), F.min("composite_start").alias("first_start"),
        F.max("composite_start").alias("last_start"))


IMAGE_WINDOW = _with(T.SUPPLIER_SERIES) + """
SELECT site, cut, count(*) AS composites, min(composite_start) AS first_start, max(composite_start) AS last_start
FROM series GROUP BY site, cut"""


def analytical_table(spark, sf_dir):
    return A.analytical_table(_supplier_acoustic(spark, sf_dir), _optical(spark, sf_dir), T.supplier_context(spark, sf_dir))


ANALYTICAL_TABLE = _with(T.SUPPLIER_ACOUSTIC, T.SUPPLIER_SERIES) + """
SELECT a.site, n_name AS validation_group, s_nationkey - 12.0::DOUBLE AS latitude, n_regionkey * 30.0::DOUBLE AS longitude,
       s_name AS recorder, a.campaign_id, valid_minutes, species_detected, standard_effort_min, rarefied_richness, species,
       cut, composites, composites_used, quarters_covered, n_last_quarter, coalesce(coverage_ok, false) AS coverage_ok,
       ndvi_median, ndmi_median, ndvi_amplitude_p90_p10, ndmi_recent_change
FROM acoustic a LEFT JOIN optical o ON a.site = o.site AND a.campaign_id = o.campaign_id
LEFT JOIN supplier ON 'S' || s_suppkey = a.site LEFT JOIN nation ON s_nationkey = n_nationkey"""


QUERIES = {f.__name__: f for f in [
    optical_descriptors, image_window, filename_parse, source_text, campaign_summary, qc_recordings, qc_mode_divergence,
    qc_duplicate_first, qc_duplicate_all, qc_same_clock, qc_duplicate_annotations, qc_out_of_bounds, qc_orphans,
    qc_points, qc_declared_vs_observed, qc_report, range_join_last_wins, species_list, rarefaction, analytical_table]}

ORACLE = {
    "optical_descriptors": OPTICAL_DESCRIPTORS, "image_window": IMAGE_WINDOW, "filename_parse": FILENAME_PARSE,
    "source_text": SOURCE_TEXT, "campaign_summary": CAMPAIGN_SUMMARY, "qc_recordings": QC_RECORDINGS,
    "qc_mode_divergence": QC_MODE_DIVERGENCE, "qc_duplicate_first": QC_DUPLICATE_FIRST,
    "qc_duplicate_all": QC_DUPLICATE_ALL, "qc_same_clock": QC_SAME_CLOCK,
    "qc_duplicate_annotations": QC_DUPLICATE_ANNOTATIONS, "qc_out_of_bounds": QC_OUT_OF_BOUNDS,
    "qc_orphans": QC_ORPHANS, "qc_points": QC_POINTS, "qc_declared_vs_observed": QC_DECLARED, "qc_report": QC_REPORT,
    "range_join_last_wins": RANGE_JOIN, "species_list": SPECIES_LIST, "rarefaction": RAREFACTION,
    "analytical_table": ANALYTICAL_TABLE}
