"""Hashes, headers, records, items, encodings, dictionary and projections over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import shapes as T
from ecoframe.operators import raster as R
from ecoframe.sources import audio, items, projection, provenance, registry


def content_hash(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


CONTENT_HASH = "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents"


def _little_endian(n, size: int):
    parts = [F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)]
    return F.concat(*parts)


def wav_header(spark, sf_dir):
    """Headers of WAV bytes built from line items: quantity gives the length, tax the rate; some are cut short."""
    rows = T.table(spark, sf_dir, "lineitem")
    channels = F.col("l_linenumber").cast("bigint")
    rate = F.when(F.col("l_tax") > 0.04, 48000).otherwise(44100).cast("bigint")
    size = (F.col("l_quantity") * 1000).cast("bigint") * channels * 2
    fmt = F.concat(F.lit("666D742010000000"), F.lit("0100"), _little_endian(channels, 2), _little_endian(rate, 4),
                   _little_endian(rate * channels * 2, 4), _little_endian(channels * 2, 2), F.lit("1000"))
    extra = F.when(F.col("l_discount") > 0.05, "4C4953540400000061626364").otherwise("")  # a LIST chunk before the samples
    data = F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("64617461"), _little_endian(size, 4)))
    content = F.unhex(F.concat(F.lit("52494646"), _little_endian(size + 36, 4), F.lit("57415645"), fmt, extra, data))
    header = rows.select("l_orderkey", "l_linenumber", audio.wav_header(content).alias("h"))
    return header.groupBy("h.channels", "h.rate_hz", F.col("h.header_error").isNotNull().alias("unreadable")).agg(
        F.count(F.lit(1)).alias("files"), F.round(F.sum("h.duration_s"), 6).alias("duration_s"))


WAV_HEADER = """
SELECT CASE WHEN ok THEN l_linenumber END AS channels, CASE WHEN ok THEN CASE WHEN l_tax > 0.04 THEN 48000 ELSE 44100 END END AS rate_hz,
       NOT ok AS unreadable, count(*) AS files,
       round(sum(CASE WHEN ok THEN l_quantity * 1000 / CASE WHEN l_tax > 0.04 THEN 48000 ELSE 44100 END END), 6) AS duration_s
FROM (SELECT *, l_returnflag <> 'R' AS ok FROM lineitem) GROUP BY 1, 2, 3"""


def record_files(spark, sf_dir):
    """File maps of records built as JSON, one record per order and one file per line item."""
    rows = T.table(spark, sf_dir, "lineitem")
    file = F.to_json(F.struct(
        F.concat_ws(".", "l_orderkey", "l_linenumber", F.coalesce(T.cents("l_extendedprice"), F.lit(0))).alias("key"), F.col("l_quantity").cast("bigint").alias("size"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("sha1:"), F.col("l_partkey"))).otherwise(
            F.concat(F.lit("md5:"), F.md5(F.col("l_partkey").cast("string")))).alias("checksum"),
        F.struct(F.concat(F.lit("https://files/"), F.col("l_partkey")).alias("self")).alias("links")))
    documents = rows.select(F.concat(F.lit('{"files": ['), file, F.lit("]}")).alias("record"))
    return registry.files_of_record(documents, "record")


RECORD_FILES = """
SELECT l_orderkey || '.' || l_linenumber || '.' || coalesce(CAST(round(l_extendedprice * 100) AS BIGINT), 0) AS name, 'https://files/' || l_partkey AS url,
       l_quantity::BIGINT AS size, CASE WHEN l_returnflag <> 'R' THEN md5(l_partkey::VARCHAR) END AS md5 FROM lineitem"""


def zip_members(spark, sf_dir):
    """Archive listings built from line items: only audio members stay, with flattened names."""
    rows = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    prefix = F.when(F.col("l_linestatus") == "O", "").otherwise("._")
    suffix = F.when(F.col("l_returnflag") == "A", ".txt").when(F.col("l_returnflag") == "N", ".WAV").otherwise(".wav")
    member = F.concat(F.lit("x/"), F.col("l_suppkey"), F.lit("/"), prefix, F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", T.cents("l_extendedprice")), suffix)
    archive = rows.select(F.col("l_orderkey").cast("string").alias("zip"), member.alias("member"), F.col("l_quantity").cast("bigint").alias("size"))
    return audio.wav_members(archive)


ZIP_MEMBERS = """
SELECT l_orderkey::VARCHAR AS zip, 'x/' || l_suppkey || '/' || name AS member, name, l_quantity::BIGINT AS size FROM (
  SELECT *, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) || CASE WHEN l_returnflag = 'N' THEN '.WAV' ELSE '.wav' END AS name
  FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'A')"""


def catalogue_items(spark, sf_dir):
    """Catalogue features built as JSON from orders, read back as items with the metadata of two bands."""
    o = T.table(spark, sf_dir, "orders")
    start = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")
    end = F.date_format(F.date_add("o_orderdate", 15), "yyyy-MM-dd'T'23:59:59'Z'")
    text = F.format_string(
        '{"id": "I%s", "bbox": [-40.5, -8.0, %s, -7.0], "properties": {"start_datetime": "%s", "end_datetime": "%s", '
        '"bdc:tiles": ["0%s"], "eo:cloud_cover": %s}, "assets": {"B02": {"href": "b02/%s", "eo:bands": [{"nodata": 0, '
        '"scale": 0.0001}]}, "SCL": {"href": "scl/%s", "eo:bands": [{"nodata": 0}]}, "thumbnail": {"href": "t"}}}',
        F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 40).cast("string"), start, end, F.col("o_custkey").cast("string"),
        F.floor(F.col("o_totalprice") / 10000).cast("string"), F.col("o_orderkey").cast("string"), F.col("o_orderkey").cast("string"))
    found = items.items_from_json(o.select(text.alias("value")))
    return items.item_bands(found).select(
        "item_id", F.to_date("start").alias("start"), F.to_date("end").alias("end"), "west", "east", "tile", "item_cloud_pct",
        "band", "href", "nodata", "scale")


CATALOGUE_ITEMS = """
SELECT 'I' || o_orderkey AS item_id, o_orderdate::DATE AS start, o_orderdate::DATE + 15 AS end, -40.5::DOUBLE AS west,
       (o_custkey % 40)::DOUBLE AS east, '0' || o_custkey AS tile, floor(o_totalprice / 10000)::DOUBLE AS item_cloud_pct, band,
       CASE band WHEN 'B02' THEN 'b02/' ELSE 'scl/' END || o_orderkey AS href, 0::DOUBLE AS nodata,
       CASE band WHEN 'B02' THEN 0.0001::DOUBLE END AS scale
FROM orders, (SELECT unnest(['B02', 'SCL']) AS band) b"""


def dictionary_gap(spark, sf_dir):
    """Part names used as columns per brand, without those described by the small parts."""
    parts = T.table(spark, sf_dir, "part")
    columns = parts.select(F.col("p_brand").alias("table"), F.concat_ws("_", "p_name", "p_size").alias("column")).distinct()
    described = parts.where(F.col("p_type") == "SMALL").select(F.concat_ws("_", "p_name", "p_size").alias("column")).distinct()
    return provenance.undescribed(columns, described)


DICTIONARY_GAP = """
SELECT DISTINCT p_brand AS "table", p_name || '_' || p_size AS "column" FROM part
WHERE p_name || '_' || p_size NOT IN (SELECT p_name || '_' || p_size FROM part WHERE p_type = 'SMALL')"""


def distinct_scenes(spark, sf_dir):
    """Distinct parts of joined lists: priorities of each customer, split again."""
    joined = T.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("scenes"))
    return provenance.distinct_sorted(joined, "scenes")


DISTINCT_SCENES = "SELECT DISTINCT o_orderpriority AS value FROM orders"


def lat_lon_grid(spark, sf_dir):
    """Every order day as a scene, with a 3×3 grid of points."""
    days = T.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return R.lat_lon_grid(days, [0.46, 0.51, 0.56], [-79.24, -79.19, -79.14])


LAT_LON_GRID = """
SELECT DISTINCT o_orderdate::DATE AS day, 'P' || (a.k * 3 + b.k) AS point, b.v AS longitude, a.v AS latitude
FROM orders, (SELECT unnest([0, 1, 2]) AS k, unnest([0.46, 0.51, 0.56]::DOUBLE[]) AS v) a, (SELECT unnest([0, 1, 2]) AS k, unnest([-79.24, -79.19, -79.14]::DOUBLE[]) AS v) b"""


def grid_to_lon_lat(spark, sf_dir):
    """Suppliers as UTM points on the old datum, moved to longitude and latitude."""
    s = T.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") + 480000).alias("x"), (F.col("s_nationkey") * 1000 + 8325906.0).alias("y"))
    lon, lat = projection.utm_to_lon_lat(F.col("x"), F.col("y"), 24, ellipsoid="GRS67")
    old = s.withColumn("lon", lon).withColumn("lat", lat)
    lon, lat = projection.shift_datum(F.col("lon"), F.col("lat"), "GRS67", "WGS84", projection.SAD69_TO_WGS84)
    return old.select("s_suppkey", F.round(lon, 8).alias("longitude"), F.round(lat, 8).alias("latitude"))


# The grid's series in the third flattening n = f / (2 - f), then a shift of geocentric coordinates.
GRID_TO_LON_LAT = """
WITH shape AS (
  SELECT *, 1 / (2 * inverse - 1) AS n, (2 - 1 / inverse) / inverse AS e2 FROM (SELECT 6378160.0::DOUBLE AS a, 298.25::DOUBLE AS inverse)),
plane AS (
  SELECT s_suppkey, s.*, (s_nationkey * 1000 + 8325906.0::DOUBLE - 1e7) / (0.9996::DOUBLE * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)) AS xi,
         (s_acctbal + 480000 - 5e5::DOUBLE) / (0.9996::DOUBLE * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)) AS eta
  FROM supplier, shape s),
sphere AS (
  SELECT *, xi - (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96) * sin(2 * xi) * cosh(2 * eta) - (n**2 / 48 + n**3 / 15) * sin(4 * xi) * cosh(4 * eta)
              - 17 * n**3 / 480 * sin(6 * xi) * cosh(6 * eta) AS p,
         eta - (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96) * cos(2 * xi) * sinh(2 * eta) - (n**2 / 48 + n**3 / 15) * cos(4 * xi) * sinh(4 * eta)
             - 17 * n**3 / 480 * cos(6 * xi) * sinh(6 * eta) AS q
  FROM plane),
conformal AS (SELECT *, asin(sin(p) / cosh(q)) AS chi, atan2(sinh(q), cos(p)) + radians(24 * 6 - 183) AS lon FROM sphere),
geographic AS (
  SELECT *, chi + (2 * n - 2 * n**2 / 3 - 2 * n**3) * sin(2 * chi) + (7 * n**2 / 3 - 8 * n**3 / 5) * sin(4 * chi)
            + 56 * n**3 / 15 * sin(6 * chi) AS lat FROM conformal),
centred AS (
  SELECT s_suppkey, a / sqrt(1 - e2 * sin(lat)**2) * cos(lat) * cos(lon) - 67.35 AS gx,
         a / sqrt(1 - e2 * sin(lat)**2) * cos(lat) * sin(lon) + 3.88 AS gy,
         a / sqrt(1 - e2 * sin(lat)**2) * (1 - e2) * sin(lat) - 38.22 AS gz FROM geographic),
wgs AS (SELECT *, sqrt(gx**2 + gy**2) AS d, 6378137.0::DOUBLE AS b, 6378137.0::DOUBLE * (1 - 1 / 298.257223563::DOUBLE) AS minor FROM centred),
bowring AS (SELECT *, atan2(gz * b, d * minor) AS u FROM wgs)
SELECT s_suppkey, round(degrees(atan2(gy, gx)), 8) AS longitude, round(degrees(atan2(
         gz + (b**2 - minor**2) / minor**2 * minor * sin(u)**3, d - (1 - minor**2 / b**2) * b * cos(u)**3)), 8) AS latitude
FROM bowring"""


QUERIES = {f.__name__: f for f in [
    content_hash, wav_header, record_files, zip_members, catalogue_items, dictionary_gap, distinct_scenes, lat_lon_grid, grid_to_lon_lat]}
ORACLE = {"content_hash": CONTENT_HASH, "wav_header": WAV_HEADER, "record_files": RECORD_FILES, "zip_members": ZIP_MEMBERS,
          "catalogue_items": CATALOGUE_ITEMS, "dictionary_gap": DICTIONARY_GAP, "distinct_scenes": DISTINCT_SCENES,
          "lat_lon_grid": LAT_LON_GRID, "grid_to_lon_lat": GRID_TO_LON_LAT}
