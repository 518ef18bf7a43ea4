"""Column functions: climate arithmetic, cell ids, calendar keys, distances, land cover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.0
CELL_PATTERN = r"^Grid_(-?\d+\.\d+)_(-?\d+\.\d+)$"

# Class codes of the land-cover groups, and which survey epoch serves up to which year.
LANDCOVER_GROUPS = {"urban": (21, 22, 23, 24), "agriculture": (81, 82), "wetland": (90, 95), "water": (11, 12)}
EPOCHS = ((2014, 2013), (2017, 2016), (None, 2019))


def mean_temperature(tmax: Column, tmin: Column) -> Column:
    return (tmax + tmin) / 2


def vapour_deficit(celsius: Column, vapour_pressure: Column) -> Column:
    """Saturation vapour pressure (Pa, Magnus form) less the actual one."""
    return 610.78 * F.exp(17.27 * celsius / (celsius + 237.3)) - vapour_pressure


def rescale(band: Column, factor: float = 0.0001) -> Column:
    return band * factor


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is 0."""
    return F.try_divide(a - b, a + b)


def cell_id(lat: Column, lon: Column) -> Column:
    return F.format_string("Grid_%.3f_%.3f", lat.cast("double"), lon.cast("double"))


def cell_centroid(cell: Column) -> tuple[Column, Column]:
    """Latitude and longitude that the id spells; null for malformed ids."""
    part = lambda i: F.regexp_extract(cell, CELL_PATTERN, i).try_cast("double")
    return part(1), part(2)


def is_cell_id(cell: Column) -> Column:
    return cell.rlike(CELL_PATTERN)


def parse_histogram(text: Column) -> Column:
    """`{code=count, ...}` as map<int, double>; the last of repeated codes counts, junk gives an empty map."""
    pattern = r"(\d+(?:\.\d+)?)\s*=\s*([0-9eE.+-]+)"
    codes = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    counts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(2))
    pairs = F.zip_with(codes, counts, lambda k, v: F.struct(k.try_cast("double").cast("int").alias("k"), v.try_cast("double").alias("v")))
    valid = F.filter(pairs, lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    empty = F.create_map().cast("map<int,double>")
    return F.aggregate(valid, empty, lambda done, x: F.map_concat(F.map_filter(done, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))


def histogram_total(hist: Column, ignore: tuple[int, ...] = ()) -> Column:
    counts = F.map_values(F.map_filter(hist, lambda k, _: ~k.isin(*ignore)) if ignore else hist)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)


def histogram_fraction(hist: Column, codes: tuple[int, ...], ignore: tuple[int, ...] = ()) -> Column:
    """Share of the counted pixels that lies in codes; null where nothing is counted."""
    keep = tuple(c for c in codes if c not in ignore)
    part = F.aggregate(F.map_values(F.map_filter(hist, lambda k, _: k.isin(*keep))), F.lit(0.0), lambda a, x: a + x)
    total = histogram_total(hist, ignore)
    return F.when(total > 0, part / total)


def log_count(n: Column) -> Column:
    return F.log1p(n)


def effort_weight(n: Column) -> Column:
    return F.sqrt(F.greatest(n, F.lit(1)).cast("double"))


def iso_year(day: Column) -> Column:
    return F.date_part(F.lit("YEAROFWEEK"), day)


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def week_monday(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def iso_monday(year: Column, week: Column) -> Column:
    """The Monday of an ISO week: that of 4 January's week, and on."""
    fourth = F.make_date(year.cast("int"), F.lit(1), F.lit(4))
    return F.date_add(F.to_date(F.date_trunc("week", fourth)), ((week - 1) * 7).cast("int"))


def season(day: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year."""
    angle = 2 * F.pi() * F.dayofyear(day) / F.lit(365.25)
    return F.sin(angle), F.cos(angle)


def week_neighbours(week: Column, k: int) -> Column:
    """The weeks at most k away on the circle of 1 to 53."""
    return F.array_distinct(F.transform(F.sequence(week - k, week + k), lambda x: (F.pmod(x - 1, F.lit(53)) + 1).cast("int")))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos_lat: Column | float) -> Column:
    """Equirectangular distance with a given cosine of the latitude."""
    dy, dx = lat1 - lat2, (lon1 - lon2) * cos_lat
    return KM_PER_DEGREE * F.sqrt(dy * dy + dx * dx)


def support(distance: Column, falloff_km: float = 120.0) -> Column:
    """exp(-d / falloff); without any distance 0."""
    return F.coalesce(F.exp(-distance / falloff_km), F.lit(0.0))


def opacity(confidence: Column, floor: float = 0.25) -> Column:
    return floor + (1.0 - floor) * confidence


def disagreement(*scores: Column) -> Column:
    return F.greatest(*scores) - F.least(*scores) if len(scores) > 1 else F.lit(0.0)


def region_label(lat: Column, lon: Column) -> Column:
    """A rough name of the part of Florida that a point lies in (fixed limits and names)."""
    return (
        F.when(lat < 25.3, "Florida Keys / far south tip")
        .when((lat < 27.0) & (lon > -81.8), "South FL (Everglades / SE coast)")
        .when(lat < 27.0, "SW coast (Naples area)")
        .when(lat < 29.0, "Central Florida")
        .when(lon < -83.5, "Western Panhandle")
        .when(lon < -82.5, "Big Bend / north-central")
        .when(lat.isNotNull() & lon.isNotNull(), "Northeast Florida")
    )


def epoch_year(year: Column, epochs: tuple = EPOCHS) -> Column:
    """The survey year that stands for a study year."""
    out = None
    for last, epoch in epochs:
        if last is None:
            return F.when(year.isNotNull(), epoch) if out is None else out.when(year.isNotNull(), epoch)
        out = F.when(year <= last, epoch) if out is None else out.when(year <= last, epoch)
    return out


def degree_day(celsius: Column, base: float = 10.0) -> Column:
    return F.when(celsius.isNotNull(), F.greatest(celsius - base, F.lit(0.0)))


def cold_day(celsius: Column, below: float = 10.0) -> Column:
    return (celsius < below).cast("double")


def fold_label(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def key_hash(seed: int | str, *key: Column) -> Column:
    """32 bits of a digest of seed and key: the same numbers in any engine that has md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
