"""Codes, thresholds and labels that results must carry unchanged."""

# --- Fixed values: recordings and quality control ---------------------------------------------
RECORDING_NAME_PATTERN = r"(?i)^([A-Za-z0-9]+)_(\d{8})_(\d{6})\.wav$"
RECORDING_CLOCK_FORMAT = "yyyyMMddHHmmss"
RATE_KHZ_PATTERN = r"(?i)([\d.,]+)\s*kHz"
YEAR_PATTERN = r"(\d{4})"
MIN_DURATION_S = 55.0
END_TOLERANCE_S = 0.01

QC_READ_ERROR = "erro_leitura"
QC_DUPLICATE_RECORDING = "gravacao_duplicada"
QC_SITE_MISMATCH = "sitio_divergente"
QC_SHORT = "duracao_curta"
QC_NOT_MONO = "canais_nao_mono"
QC_SAME_CLOCK = "horario_repetido"
QC_RATE_MISMATCH = "taxa_divergente"
QC_INCOMPLETE_ANNOTATION = "anotacao_incompleta"
QC_DUPLICATE_ANNOTATION = "anotacao_duplicada"
QC_ANNOTATION_WITHOUT_AUDIO = "anotacao_sem_audio"
QC_AUDIO_WITHOUT_ANNOTATION = "audio_sem_anotacao"
QC_ANNOTATION_OUTSIDE_AUDIO = "anotacao_fora_do_audio"
QC_SITE_WITHOUT_POINT = "sitio_sem_ponto"
QC_DUPLICATE_POINT = "ponto_duplicado"
QC_INVALID_COORDINATE = "coordenada_invalida"
QC_YEAR_OUTSIDE_DECLARED = "ano_fora_do_declarado"
QC_MINUTES_MISMATCH = "minutos_divergentes"
QC_DECLARED_RATE_MISMATCH = "taxa_diferente_da_declarada"

UNKNOWN_ZONE = "desconhecido"
UNKNOWN_RECORDER = "desconhecido (centro do sítio)"
COORDINATE_PRECISION = "centro do sítio (Metadata.csv)"
ANNOTATION_SOURCE = "anotacao_especialista_wabad_v4"

# --- Fixed values: optical series --------------------------------------------------------------
SPECTRAL_BANDS = ["B02", "B04", "B08", "B8A", "B11"]
INDEX_BANDS = ["NDVI", "EVI"]
QUALITY_BANDS = ["SCL", "CLEAROB", "TOTALOB", "PROVENANCE"]
BANDS = SPECTRAL_BANDS + INDEX_BANDS + QUALITY_BANDS

SCL_NAMES = {
    0: "sem dado",
    1: "saturado ou defeituoso",
    2: "área escura",
    3: "sombra de nuvem",
    4: "vegetação",
    5: "solo exposto",
    6: "água",
    7: "não classificado",
    8: "nuvem (prob. média)",
    9: "nuvem (prob. alta)",
    10: "cirrus",
    11: "neve ou gelo",
}
SCL_UNKNOWN = "desconhecida"
SCL_VALID = [4, 5, 6]
SCL_CLOUD = [8, 9, 10]
SCL_SHADOW = 3
HAZE_B02_MAX = 0.10
WINDOW_RADIUS_PX = 1
SERIES_DAYS = 365
COMPOSITE_DAYS = 16
SOURCE_B04_TOLERANCE = 0.01
BASELINE_PATTERN = r"_N(\d{4})_"
OFFSET_BASELINE = 400
BASELINE_OFFSET_DN = 1000.0
SCENE_SCALE = 0.0001

REASON_OUTSIDE_RASTER = "ponto fora do raster"
REASON_NO_SCENE = "sem cena de origem no dia"
REASON_SCENE_WITHOUT_DATA = "cena de origem sem dado no pixel"
REASON_SCENE_CONFLICT = "cenas de origem em conflito e nenhuma reproduz o cubo"
REASON_SOURCE_CLASS = "SCL origem"
REASON_BAND_MISSING = "banda sem dado"
REASON_PROVENANCE_MISSING = "PROVENANCE sem dado"
REASON_PROVENANCE_OUTSIDE = "PROVENANCE fora do período"
REASON_HAZE = "névoa"

STATUS_VALID = "válida"
STATUS_CLOUD = "nuvem"
STATUS_SHADOW = "sombra de nuvem"
STATUS_HAZE = "névoa (B02)"
STATUS_OTHER = "outro"
STATUSES = [STATUS_VALID, STATUS_CLOUD, STATUS_SHADOW, STATUS_HAZE, STATUS_OTHER]

# --- Fixed values: coverage rule and descriptors -----------------------------------------------
MIN_VALID_COMPOSITES = 10
QUARTERS = 4
MIN_VALID_WINDOW_PIXELS = 5
MIN_LAST_QUARTER_COMPOSITES = 2
HALF_COMPOSITE_DAYS = 8

# --- Fixed values: cloudiness slices -----------------------------------------------------------
RULE_LABELS = {
    "valid_cube_scl_b02": "SCL do cubo + B02 (regra do teste original)",
    "valid": "SCL da cena de origem + B02 (decisão D)",
}
SLICE_ALL = "todos"
SLICE_QUARTER = "trimestre"
PASS_SEPARATOR = " de "

# --- Fixed values: inference and sizing study --------------------------------------------------
MIN_RELEVANT_GAIN = 0.10
LEVEL = 0.90
MODELS = {
    "M2": ["stable_recent", "landscape"],
    "M2b": ["stable_recent", "landscape", "stable_median"],
    "M3": ["stable_recent", "landscape", "stable_median", "dynamics"],
}
READING_CONFIRMED = "relevante confirmado"
READING_POSITIVE_ABOVE = "positivo, estimativa acima do mínimo"
READING_POSITIVE_BELOW = "positivo, abaixo do mínimo"
READING_INCONCLUSIVE = "inconclusivo"
READING_DISCARDED = "relevante descartado"
READINGS = [READING_CONFIRMED, READING_POSITIVE_ABOVE, READING_POSITIVE_BELOW, READING_INCONCLUSIVE,
            READING_DISCARDED]
INTERVAL_METHODS = ["erros_fixos", "reajuste", "reajuste_basico", "cv_corrigido"]
ADOPTED_METHOD = "reajuste_basico"
