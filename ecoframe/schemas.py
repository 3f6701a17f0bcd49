"""Schemas of the domain tables: type, description and the column name used in exported CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _column(name: str, kind: T.DataType, exported: str, description: str) -> T.StructField:
    """A column; `exported` is the fixed name that it has in CSV files."""
    return T.StructField(name, kind, True, {"comment": description, "exported": exported})


COLUMNS = [
    _column("site", T.StringType(), "sitio", "site code"),
    _column("campaign_id", T.StringType(), "campanha_id", "campaign of the site (site-number)"),
    _column("file", T.StringType(), "arquivo", "audio file name; the site for problems of a whole site"),
    _column("validation_group", T.StringType(), "grupo_validacao", "group held out together in validation"),
    _column("study_area", T.StringType(), "area_estudo", "study area as declared by the source"),
    _column("country", T.StringType(), "pais", "country as declared by the source"),
    _column("biome", T.StringType(), "bioma_olson", "biome as declared by the source"),
    _column("latitude", T.DoubleType(), "latitude", "WGS84 latitude of the site centre"),
    _column("longitude", T.DoubleType(), "longitude", "WGS84 longitude of the site centre"),
    _column("coordinate_precision", T.StringType(), "precisao_coord", "what the coordinate stands for"),
    _column("recorder", T.StringType(), "gravador", "recorder and microphone as declared"),
    _column("declared_rate_hz", T.DoubleType(), "taxa_declarada_hz", "declared sampling rate (Hz)"),
    _column("declared_year", T.StringType(), "ano_declarado_metadata", "declared recording year, free text"),
    _column("annotated_minutes", T.IntegerType(), "minutos_anotados", "annotated minutes as declared"),
    _column("clock_start", T.TimestampNTZType(), "inicio_relogio", "clock start without zone"),
    _column("clock_end", T.TimestampNTZType(), "fim_relogio", "last clock start of the campaign"),
    _column("n_recordings", T.LongType(), "n_gravacoes", "valid audio files"),
    _column("effort_min", T.DoubleType(), "esforco_min", "minutes of valid audio"),
    _column("source_site", T.StringType(), "sitio_origem", "site of the folder the file came from"),
    _column("duration_s", T.DoubleType(), "duracao_s", "audio duration (s)"),
    _column("rate_hz", T.IntegerType(), "taxa_hz", "sampling rate in the header (Hz)"),
    _column("channels", T.IntegerType(), "canais", "number of channels"),
    _column("sha256", T.StringType(), "sha256", "hash of the file content"),
    _column("error", T.StringType(), "erro", "name or header error; empty if none"),
    _column("time_zone", T.StringType(), "fuso", "zone of the recorder clock"),
    _column("point_id", T.StringType(), "ponto_id", "recorder within the site"),
    _column("species", T.StringType(), "especie", "annotated species"),
    _column("start_s", T.DoubleType(), "inicio_s", "start of the vocalisation in the file (s)"),
    _column("end_s", T.DoubleType(), "fim_s", "end of the vocalisation in the file (s)"),
    _column("freq_min_hz", T.DoubleType(), "freq_min_hz", "lowest frequency of the annotation box (Hz)"),
    _column("freq_max_hz", T.DoubleType(), "freq_max_hz", "highest frequency of the annotation box (Hz)"),
    _column("source", T.StringType(), "fonte", "origin of the annotation"),
    _column("kind", T.StringType(), "tipo", "kind of problem"),
    _column("target", T.StringType(), "arquivo", "file (or site) with the problem"),
    _column("detail", T.StringType(), "detalhe", "what was found"),
    _column("cut", T.DateType(), "corte", "last day of the image window: the eve of the first recording"),
    _column("item_id", T.StringType(), "item_id", "catalogue item of the composite"),
    _column("item_updated", T.StringType(), "item_atualizado", "update time of the item in the catalogue"),
    _column("tile", T.StringType(), "tile", "tile codes of the item"),
    _column("composite_start", T.DateType(), "inicio_composicao", "first day of the composite"),
    _column("composite_end", T.DateType(), "fim_composicao", "last day of the composite"),
    _column("item_cloud_pct", T.DoubleType(), "nuvem_item_pct", "cloud cover of the whole item (%)"),
    _column("x_cube", T.DoubleType(), "x_cubo", "x of the point in the raster system"),
    _column("y_cube", T.DoubleType(), "y_cubo", "y of the point in the raster system"),
    _column("pixel_row", T.IntegerType(), "pixel_linha", "raster row of the point"),
    _column("pixel_col", T.IntegerType(), "pixel_coluna", "raster column of the point"),
    _column("B02", T.DoubleType(), "B02", "blue surface reflectance"),
    _column("B04", T.DoubleType(), "B04", "red surface reflectance"),
    _column("B08", T.DoubleType(), "B08", "near-infrared surface reflectance"),
    _column("B8A", T.DoubleType(), "B8A", "narrow near-infrared surface reflectance"),
    _column("B11", T.DoubleType(), "B11", "short-wave infrared surface reflectance"),
    _column("NDVI", T.DoubleType(), "NDVI", "vegetation index of the cube"),
    _column("EVI", T.DoubleType(), "EVI", "enhanced vegetation index of the cube"),
    _column("SCL", T.IntegerType(), "SCL", "scene class in the cube"),
    _column("CLEAROB", T.IntegerType(), "CLEAROB", "clear observations in the period"),
    _column("TOTALOB", T.IntegerType(), "TOTALOB", "observations in the period"),
    _column("PROVENANCE", T.IntegerType(), "PROVENANCE", "day of year of the source observation"),
    _column("NDMI", T.DoubleType(), "NDMI", "moisture index (B8A − B11)/(B8A + B11)"),
    _column("source_scl", T.IntegerType(), "SCL_origem", "scene class in the source scene"),
    _column("source_scene", T.StringType(), "cena_origem", "source scene of the point's pixel"),
    _column("n_scenes", T.IntegerType(), "n_cenas_origem", "scenes of the day over the point"),
    _column("source_conflict", T.BooleanType(), "conflito_scl_origem", "scenes disagree and none reproduces the cube"),
    _column("source_b04_difference", T.DoubleType(), "dif_b04_origem", "difference of red reflectance, source scene against cube"),
    _column("window_source_scenes", T.StringType(), "cenas_origem_janela", "source scenes of the window, separated by ;"),
    _column("observation_date", T.DateType(), "data_observacao", "observation day of the pixel"),
    _column("valid", T.BooleanType(), "valido", "valid by the main rule"),
    _column("invalid_reason", T.StringType(), "motivo_invalido", "reasons, empty if valid"),
    _column("valid_cube_scl_b02", T.BooleanType(), "valido_scl_cubo_b02", "variant: class of the cube and haze test"),
    _column("valid_cube_scl_only", T.BooleanType(), "valido_somente_scl_cubo", "variant: class of the cube only"),
    _column("window_n_pixels", T.IntegerType(), "viz_n_pixels", "pixels in the window"),
    _column("window_n_valid", T.IntegerType(), "viz_n_validos", "valid pixels in the window"),
    _column("window_ndvi_median", T.DoubleType(), "viz_NDVI_mediana", "median NDVI of the valid window pixels"),
    _column("window_ndvi_sd", T.DoubleType(), "viz_NDVI_dp", "population deviation of NDVI in the window"),
    _column("window_evi_median", T.DoubleType(), "viz_EVI_mediana", "median EVI of the valid window pixels"),
    _column("window_evi_sd", T.DoubleType(), "viz_EVI_dp", "population deviation of EVI in the window"),
    _column("window_ndmi_median", T.DoubleType(), "viz_NDMI_mediana", "median NDMI of the valid window pixels"),
    _column("window_ndmi_sd", T.DoubleType(), "viz_NDMI_dp", "population deviation of NDMI in the window"),
    _column("valid_minutes", T.LongType(), "minutos_validos", "valid minutes of the campaign"),
    _column("species_detected", T.LongType(), "especies_detectadas", "species in all minutes (not true richness)"),
    _column("standard_effort_min", T.LongType(), "esforco_padrao_min", "common effort of the rarefaction (minutes)"),
    _column("rarefied_richness", T.DoubleType(), "riqueza_rarefeita", "expected species in the common effort"),
    _column("composites", T.LongType(), "composicoes", "composites in the window"),
    _column("composites_used", T.LongType(), "composicoes_usadas", "composites with a mostly valid pixel window"),
    _column("quarters_covered", T.IntegerType(), "trimestres_cobertos", "quarters of the window with a used composite"),
    _column("n_last_quarter", T.LongType(), "n_ultimo_trimestre", "used composites in the last quarter"),
    _column("coverage_ok", T.BooleanType(), "cobertura_ok", "the series meets the minimum coverage"),
    _column("ndvi_median", T.DoubleType(), "ndvi_mediana", "median NDVI over the year"),
    _column("ndmi_median", T.DoubleType(), "ndmi_mediana", "median NDMI over the year"),
    _column("ndvi_amplitude_p90_p10", T.DoubleType(), "ndvi_amplitude_p90_p10", "90th minus 10th percentile of NDVI"),
    _column("ndmi_recent_change", T.DoubleType(), "ndmi_mudanca_recente", "last-quarter median of NDMI minus the yearly one"),
]
COLUMN_TYPE = {c.name: c.dataType for c in COLUMNS}
EXPORT_NAME = {c.name: c.metadata["exported"] for c in COLUMNS}
DESCRIPTION = {c.name: c.metadata["comment"] for c in COLUMNS}
# the species column of the analytical table is the joined list, under its own exported name
SPECIES_LIST_EXPORT = "especies"

TABLES = {
    "points": [
        "site", "validation_group", "study_area", "country", "biome", "latitude", "longitude",
        "coordinate_precision", "recorder", "declared_rate_hz", "declared_year", "annotated_minutes",
    ],
    "campaigns": [
        "site", "campaign_id", "clock_start", "clock_end", "n_recordings", "effort_min",
    ],
    "recordings": [
        "file", "site", "source_site", "clock_start", "duration_s", "rate_hz", "channels", "sha256", "error",
        "time_zone", "point_id",
    ],
    "detections": [
        "site", "file", "species", "start_s", "end_s", "freq_min_hz", "freq_max_hz", "source",
    ],
    "quality_report": [
        "kind", "target", "detail",
    ],
    "series": [
        "site", "campaign_id", "cut", "item_id", "item_updated", "tile", "composite_start", "composite_end",
        "item_cloud_pct", "x_cube", "y_cube", "pixel_row", "pixel_col", "B02", "B04", "B08", "B8A", "B11", "NDVI",
        "EVI", "SCL", "CLEAROB", "TOTALOB", "PROVENANCE", "NDMI", "source_scl", "source_scene", "n_scenes",
        "source_conflict", "source_b04_difference", "window_source_scenes", "observation_date", "valid",
        "invalid_reason", "valid_cube_scl_b02", "valid_cube_scl_only", "window_n_pixels", "window_n_valid",
        "window_ndvi_median", "window_ndvi_sd", "window_evi_median", "window_evi_sd", "window_ndmi_median",
        "window_ndmi_sd",
    ],
    "analytical_table": [
        "site", "validation_group", "latitude", "longitude", "recorder", "campaign_id", "valid_minutes",
        "species_detected", "standard_effort_min", "rarefied_richness", "species", "cut", "composites",
        "composites_used", "quarters_covered", "n_last_quarter", "coverage_ok", "ndvi_median", "ndmi_median",
        "ndvi_amplitude_p90_p10", "ndmi_recent_change",
    ],
}


def columns(table: str) -> list[str]:
    return list(TABLES[table])


def _export(table: str, column: str) -> str:
    return SPECIES_LIST_EXPORT if (table, column) == ("analytical_table", "species") else EXPORT_NAME[column]


def schema(table: str, exported: bool = False) -> T.StructType:
    return T.StructType([
        T.StructField(_export(table, c) if exported else c, COLUMN_TYPE[c], True, {"comment": DESCRIPTION[c]})
        for c in columns(table)])


def to_export(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order, under their exported names; columns it lacks are NULL."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(COLUMN_TYPE[c]).alias(_export(table, c))
                       for c in columns(table)])


def from_export(df: DataFrame, table: str) -> DataFrame:
    """Back to the engine's names."""
    return df.select(*[F.col(_export(table, c)).cast(COLUMN_TYPE[c]).alias(c) for c in columns(table)
                       if _export(table, c) in df.columns])
