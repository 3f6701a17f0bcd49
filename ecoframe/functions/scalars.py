"""Row-level derivations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ecoframe import constants as C


def finite(x: Column) -> Column:
    """NULL where the value is NaN or infinite: NULL is the only missing value in this engine."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def three_decimals(x: Column) -> Column:
    """Text of a number from 0.01 on with three decimals, rounded from its exact binary value as C's "%.3f" does.

    ``format_string`` and ``round`` start from the shortest decimal text instead, and differ on the many
    four-digit reflectances that end in 5. From 2^62 on they are all that is used.
    """
    unit = 2 ** 59
    # The part behind the point is exact as a double and as 59 bits.
    before = F.floor(F.least(x, F.lit(2.0 ** 62)))
    exact = ((F.least(x, F.lit(2.0 ** 62)) - before) * F.lit(float(unit))).cast("bigint").cast("decimal(20,0)") * F.lit(1000).cast("decimal(4,0)")
    whole = F.floor(exact / F.lit(unit).cast("decimal(20,0)")).cast("decimal(20,0)")
    rest = exact - whole * F.lit(unit).cast("decimal(20,0)")
    half = F.lit(unit // 2).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    thousandths = whole.cast("bigint") + F.when(up, 1).otherwise(0)
    carry = F.floor(thousandths / 1000)
    text = F.concat((before + carry).cast("string"), F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0"))
    return F.when(x < 2.0 ** 62, text).otherwise(F.format_string("%.3f", x))


def join_messages(*messages: Column) -> Column:
    """The non-NULL messages in order, separated by "; "; NULL when there are none."""
    return F.nullif(F.concat_ws("; ", *messages), F.lit(""))


# --- recording names and source text ------------------------------------------------------------

def recording_site(name: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(name, C.RECORDING_NAME_PATTERN, 1)), F.lit(""))


def recording_clock(name: Column) -> Column:
    """Clock start without zone; NULL if the name does not match or holds an impossible date."""
    digits = F.concat(F.regexp_extract(name, C.RECORDING_NAME_PATTERN, 2),
                      F.regexp_extract(name, C.RECORDING_NAME_PATTERN, 3))
    return F.try_to_timestamp(digits, F.lit(C.RECORDING_CLOCK_FORMAT)).cast("timestamp_ntz")


def recording_name_error(name: Column) -> Column:
    return F.when(
        ~F.coalesce(F.regexp_like(name, F.lit(C.RECORDING_NAME_PATTERN)), F.lit(False))
        | recording_clock(name).isNull(),
        F.concat(F.lit("name does not follow SITE_YYYYMMDD_HHMMSS.wav: "), name))


def folder_site(path: Column) -> Column:
    """Upper-case name of the folder that holds the file."""
    return F.upper(F.try_element_at(F.split(path, "/"), F.lit(-2)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def rate_in_hz(text: Column) -> Column:
    """"44,1 kHz" → 44100.0; NULL when the text names no rate."""
    number = F.replace(F.regexp_extract(text, C.RATE_KHZ_PATTERN, 1), F.lit(","), F.lit("."))
    return number.try_cast("double") * 1000


def years_in_text(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(C.YEAR_PATTERN), 1)
    return F.transform(found, lambda y: y.cast("int"))


def campaign_id(site: Column) -> Column:
    return F.concat(site, F.lit("-1"))


def fractional_hour(clock: Column) -> Column:
    return F.hour(clock) + F.minute(clock) / 60


def valid_coordinate(latitude: Column, longitude: Column) -> Column:
    lat, lon = latitude.try_cast("double"), longitude.try_cast("double")
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


# --- time windows ---------------------------------------------------------------------------------

def window_cut(clock_start: Column) -> Column:
    """The eve of the first recording: nothing later may enter the image series."""
    return F.date_sub(F.to_date(clock_start), 1)


def window_start(clock_start: Column, days: int = C.SERIES_DAYS) -> Column:
    return F.date_sub(window_cut(clock_start), days)


def inside_window(start: Column, end: Column, window_from: Column, cut: Column) -> Column:
    """The whole period lies in [window start, cut], both ends included."""
    return (F.to_date(start) >= window_from) & (F.to_date(end) <= cut)


def observation_date(composite_start: Column, day_of_year: Column) -> Column:
    """Day of year → date; days before the composite start belong to the next year."""
    this_year = F.date_add(F.trunc(composite_start, "YEAR"), day_of_year.cast("int") - 1)
    next_year = F.date_add(F.add_months(F.trunc(composite_start, "YEAR"), 12), day_of_year.cast("int") - 1)
    return F.when(this_year < composite_start, next_year).otherwise(this_year)


def relative_quarter(day: Column, cut: Column) -> Column:
    """Quarter 0–3 of the 365 days that end at the cut (91.25-day bins, not calendar quarters)."""
    elapsed = F.datediff(day, F.date_sub(cut, C.SERIES_DAYS))
    bin_ = F.floor(elapsed / F.lit(C.SERIES_DAYS / C.QUARTERS))
    return F.least(F.greatest(bin_, F.lit(0)), F.lit(C.QUARTERS - 1)).cast("int")


def period_index(day: Column, first_day: Column, days: int = C.COMPOSITE_DAYS) -> Column:
    return F.floor(F.datediff(day, first_day) / F.lit(float(days))).cast("int")


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


# --- optical arithmetic -----------------------------------------------------------------------------

def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def physical(raw: Column, nodata: Column, scale: Column | None) -> Column:
    """NULL where the pixel is nodata, else the scaled value (quality bands have no scale)."""
    raw = raw.cast("double")
    missing = F.when(F.isnan(nodata), F.isnan(raw)).otherwise(raw == nodata)
    value = raw if scale is None else raw * scale
    return F.when(~missing & ~F.isnan(raw), value)


def scene_baseline(scene_id: Column) -> Column:
    return F.nullif(F.regexp_extract(scene_id, C.BASELINE_PATTERN, 1), F.lit(""))


def reflectance_offset(scene_id: Column) -> Column:
    is_offset = F.coalesce(scene_baseline(scene_id).cast("int") >= C.OFFSET_BASELINE, F.lit(False))
    return F.when(is_offset, F.lit(C.BASELINE_OFFSET_DN)).otherwise(F.lit(0.0))


def scene_reflectance(dn: Column, scene_id: Column) -> Column:
    return (dn - reflectance_offset(scene_id)) * F.lit(C.SCENE_SCALE)


def scl_valid(scl: Column) -> Column:
    return F.coalesce(scl.isin(C.SCL_VALID), F.lit(False))


def scl_name(scl: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in C.SCL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, scl.cast("int")), F.lit(C.SCL_UNKNOWN))


def composite_status(valid: Column, source_scl: Column, reason: Column) -> Column:
    hazy = source_scl.isin(C.SCL_VALID) & F.coalesce(F.contains(reason, F.lit(C.REASON_HAZE)), F.lit(False))
    return (F.when(valid, C.STATUS_VALID)
            .when(source_scl.isin(C.SCL_CLOUD), C.STATUS_CLOUD)
            .when(source_scl == C.SCL_SHADOW, C.STATUS_SHADOW)
            .when(hazy, C.STATUS_HAZE)
            .otherwise(C.STATUS_OTHER))


# --- species sets ------------------------------------------------------------------------------------

def jaccard_distance(a: Column, b: Column) -> Column:
    """1 − |a ∩ b| / |a ∪ b|; two empty sets are at distance 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def _falling(x: Column) -> Column:
    """ψ(x) = Σ xᵏ/(k(k+1)): what is left of (A−s)·ln(1−s/A) beside −s and divided by s, for x = s/A; a series where x is small."""
    series = F.lit(0.0)
    for k in range(14, 0, -1):
        series = (series + F.lit(1.0 / (k * (k + 1)))) * x
    return F.when(x < 0.1, series).otherwise(1 + (1 - x) * F.log1p(-x) / x)


def _stirling(n: Column) -> Column:
    """The remainder of Stirling's formula for ln n!; its error is below 1/(1680 n⁷), from 64 on below 2e-16."""
    return 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * n * n * n * n * n)


def rarefaction_term(minutes: Column, total: Column, m: Column) -> Column:
    """Chance that a species seen in ``minutes`` of ``total`` minutes shows up in ``m`` drawn without return.

    1 − C(N−n, m)/C(N, m). With s the smaller and L the larger of n and m the ratio is Π (N−L−j)/(N−j) over j < s, because
    drawing m minutes that avoid the n is the same event as placing the n minutes outside the m. Up to 64 factors are
    multiplied. Beyond, the ratio is below 4e-15 where fewer than 64 minutes would be left over, and counts as 0; else it follows
    from Stirling's formula, with the large terms cancelled before they are computed. No list grows with the minutes.
    """
    n = total.cast("double")
    short, size = F.least(minutes, m).cast("double"), F.greatest(minutes, m).cast("double")
    few = F.sequence(F.lit(0), F.greatest(F.least(short, F.lit(64.0)), F.lit(1.0)).cast("int") - 1)
    product = F.aggregate(few, F.lit(1.0), lambda acc, j: acc * F.greatest(n - size - j, F.lit(0.0)) / (n - j))
    rest = n - size
    left = F.greatest(rest - short, F.lit(64.0))
    inside, outside = short / F.greatest(rest, short + 64), short / n
    log = (short * F.log1p(-size / F.greatest(n, size + 1)) - short * (_falling(inside) - _falling(outside))
           - (F.log1p(-inside) - F.log1p(-outside)) / 2
           + _stirling(F.greatest(rest, F.lit(64.0))) - _stirling(left) - _stirling(n) + _stirling(n - short))
    absent = (F.when(short <= 0, F.lit(1.0)).when(short <= 64, product).when(rest - short < 64, F.lit(0.0)).otherwise(F.exp(log)))
    return F.when((m > 0) & (m <= total), 1 - absent).otherwise(
        F.raise_error(F.concat(F.lit("rarefaction effort "), m.cast("string"),
                               F.lit(" must be between 1 and "), total.cast("string"))).cast("double"))


# --- interval reading ---------------------------------------------------------------------------------

def interval_reading(gain: Column, lower: Column, upper: Column, minimum: float = C.MIN_RELEVANT_GAIN) -> Column:
    """Reading of a gain interval against the smallest relevant gain; the order of the cases matters."""
    return (F.when(lower >= minimum, C.READING_CONFIRMED)
            .when((lower > 0) & (gain >= minimum), C.READING_POSITIVE_ABOVE)
            .when((lower > 0) & (upper < minimum), C.READING_POSITIVE_BELOW)
            .when(upper < minimum, C.READING_DISCARDED)
            .otherwise(C.READING_INCONCLUSIVE))


def interval_covers(target: Column, lower: Column, upper: Column) -> Column:
    return F.coalesce(target.between(lower, upper), F.lit(False))
