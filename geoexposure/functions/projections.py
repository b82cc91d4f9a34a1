"""Projections and tile systems as columns: equal-area, web Mercator, UTM and 100-km squares, 10-degree tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS 84 (semi-major axis, flattening) and the UTM scale.
A, FLAT, UTM_SCALE = 6378137.0, 1 / 298.257223563, 0.9996
E2 = FLAT * (2 - FLAT)
E1 = E2**0.5
# Letters of latitude bands, of 100-km columns by zone, and of 100-km rows by zone parity.
BANDS = "CDEFGHJKLMNPQRSTUVWXX"
COLUMNS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ")
ROWS = ("ABCDEFGHJKLMNPQRSTUV", "FGHJKLMNPQRSTUVABCDE")


def _at(letters: Column | str, index: Column) -> Column:
    text = F.lit(letters) if isinstance(letters, str) else letters
    return F.substring(text, index.cast("int") + 1, F.lit(1))


def to_equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres in the cylindrical equal-area projection of the ellipsoid, standard parallel 0."""
    s = F.sin(F.radians(lat))
    q = (s / (1 - s * s * E2) - F.log((1 - s * E1) / (1 + s * E1)) / (2 * E1)) * (1 - E2)
    return F.radians(lon) * A, q * (A / 2)


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * A, F.log(F.tan(F.radians(lat) / 2 + F.pi() / 4)) * A


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(F.atan(F.exp(y / A)) * 2 - F.pi() / 2)


def normalized_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60; a meridian between two zones belongs to the western one, -180 to zone 1."""
    return F.greatest(F.lit(1), F.ceil((normalized_lon(lon) + 180) / 6)).cast("int")


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series in the third flattening, to the third order."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alphas = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(lat), F.radians(normalized_lon(lon) - (zone * 6 - 183))
    c = 2 * n**0.5 / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * c) * c)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1))
    east, north = eta, xi
    for k, a in enumerate(alphas, 1):
        east = east + F.cos(xi * 2 * k) * F.sinh(eta * 2 * k) * a
        north = north + F.sin(xi * 2 * k) * F.cosh(eta * 2 * k) * a
    return east * (UTM_SCALE * radius) + 500000.0, north * (UTM_SCALE * radius) + F.when(lat < 0, 10000000.0).otherwise(0.0)


def _named(value: Column, of) -> Column:
    """``of(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> Column:
    """Longitude and latitude (a struct lon, lat) of an easting and northing of a zone; ``south``: whether the northing counts from the south. The inverse Krueger series, to the fourth order."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    betas = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    deltas = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    grid = F.struct(((north - F.when(south, 10000000.0).otherwise(0.0)) / (UTM_SCALE * radius)).alias("xi"), ((east - 500000.0) / (UTM_SCALE * radius)).alias("eta"), zone.alias("zone"))

    def plain(g: Column) -> Column:
        x, y = g["xi"], g["eta"]
        for k, b in enumerate(betas, 1):
            x = x - F.sin(g["xi"] * 2 * k) * F.cosh(g["eta"] * 2 * k) * b
            y = y - F.cos(g["xi"] * 2 * k) * F.sinh(g["eta"] * 2 * k) * b
        return F.struct(x.alias("x"), y.alias("y"), g["zone"].alias("zone"))

    def sphere(g: Column) -> Column:
        lon = normalized_lon(g["zone"] * 6 - 183 + F.degrees(F.atan2(F.sinh(g["y"]), F.cos(g["x"]))))
        return F.struct(F.asin(F.sin(g["x"]) / F.cosh(g["y"])).alias("chi"), lon.alias("lon"))

    def ellipsoid(g: Column) -> Column:
        lat = g["chi"]
        for k, d in enumerate(deltas, 1):
            lat = lat + F.sin(g["chi"] * 2 * k) * d
        return F.struct(g["lon"].alias("lon"), F.degrees(lat).alias("lat"))

    return _named(grid, lambda g: _named(plain(g), lambda p: _named(sphere(p), ellipsoid)))


def _first_row(band: int) -> int:
    """The least northing of a band in whole 100 km: that of its southern edge, on the middle of a zone in the north and at its rim in the south."""
    n = FLAT / (2 - FLAT)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    phi, lam, c = math.radians(band * 8 - 80), math.radians(3 if band < 10 else 0), 2 * n**0.5 / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - c * math.atanh(c * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(t, 1))
    xi += (n / 2 - 2 * n**2 / 3) * math.sin(2 * xi) * math.cosh(2 * eta)
    return math.floor((UTM_SCALE * radius * xi + (10000000.0 if band < 10 else 0.0)) / 100000)


def from_mgrs_100k(square: Column, east: Column | float = 0.0, north: Column | float = 0.0) -> Column:
    """Longitude and latitude (a struct lon, lat) of a point ``east`` and ``north`` metres from the south-western corner of a 100-km square (zone, band, column, row letters; spaces don't count). Null for other names.

    Row letters repeat every 2,000 km: of the rows that one may stand for the first that is not south of the band is taken.
    """
    letter = lambda name, k: F.substring(name, -k, 1)

    def parts(name: Column) -> Column:
        zone = F.regexp_extract(name, "^[0-9]+", 0).cast("int")
        column = _place(F.element_at(F.array(*map(F.lit, COLUMNS)), (zone - 1) % 3 + 1), letter(name, 2))
        row = _place(F.element_at(F.array(*map(F.lit, ROWS)), (zone - 1) % 2 + 1), letter(name, 1))
        return F.struct(zone.alias("zone"), _place(BANDS, letter(name, 3)).alias("band"), column.alias("column"), row.alias("row"))

    def found(p: Column) -> Column:
        first = F.element_at(F.array(*[F.lit(_first_row(b)) for b in range(20)]), p["band"] + 1)
        rows = first + F.pmod(p["row"] - first, F.lit(20))
        return F.when((p["column"] >= 0) & (p["row"] >= 0), from_utm((p["column"] + 1) * 100000.0 + east, rows * 100000.0 + north, p["zone"], p["band"] < 10))

    name = F.upper(F.regexp_replace(square, r"\s", ""))
    sound = lambda n: n.rlike("^([1-9]|0[1-9]|[1-5][0-9]|60)[C-HJ-NP-X][A-HJ-NP-Z][A-HJ-NP-V]$")
    return _named(name, lambda n: F.when(sound(n), _named(parts(n), found)))


def _place(letters: Column | str, letter: Column) -> Column:
    """The number of a letter among ``letters``, from 0; -1 if it isn't there."""
    return F.instr(F.lit(letters) if isinstance(letters, str) else letters, letter) - 1


def square_name(zone: Column, band: Column, east: Column, north: Column) -> Column:
    """Name of a square from its zone, the number of its band from 80 degrees south, and its easting and northing in whole 100 km."""
    column = _at(F.element_at(F.array(*map(F.lit, COLUMNS)), (zone - 1) % 3 + 1), east - 1)
    row = _at(F.element_at(F.array(*map(F.lit, ROWS)), (zone - 1) % 2 + 1), F.pmod(north, F.lit(20)))
    return F.concat(F.lpad(zone.cast("string"), 2, "0"), _at(BANDS, band), column, row)


def to_mgrs_100k(lon: Column, lat: Column) -> Column:
    """Zone, band and 100-km square; a message outside the bands."""
    zone = utm_zone(lon)
    east, north = to_utm(lon, lat, zone)
    name = square_name(zone, F.floor(lat / 8 + 10), F.floor(east / 100000), F.floor(north / 100000))
    return F.when(lat < -80, "Too far South").when(lat > 84, "Too far North").otherwise(name)


def tiles_for_bbox(boxes: DataFrame) -> DataFrame:
    """Every box (xmin, ymin, xmax, ymax in degrees) with the 10-degree tiles that it meets."""
    span = lambda low, high, most: F.sequence(F.greatest(F.lit(0), F.floor(low).cast("int")), F.least(F.lit(most), F.floor(high).cast("int")))
    ok = (F.floor((F.col("xmin") + 180) / 10) <= 35) & (F.floor((F.col("xmax") + 180) / 10) >= 0)
    ok = ok & (F.floor((90 - F.col("ymax")) / 10) <= 17) & (F.floor((90 - F.col("ymin")) / 10) >= 0)
    h = boxes.where(ok).withColumn("h", F.explode(span((F.col("xmin") + 180) / 10, (F.col("xmax") + 180) / 10, 35)))
    v = h.withColumn("v", F.explode(span((90 - F.col("ymax")) / 10, (90 - F.col("ymin")) / 10, 17)))
    return v.withColumn("tile", F.format_string("h%02dv%02d", "h", "v")).drop("h", "v")


def mgrs_tiles_for_bbox(boxes: DataFrame, step: float = 50000.0, edge: float = 5000.0) -> DataFrame:
    """Every box (xmin, ymin, xmax, ymax in degrees) with the 100-km squares that it meets; where xmin > xmax it lies across the date line.

    Boxes are cut to zones and latitude bands. The squares that the four edges of such a piece run through are found from pairs of points ``edge`` metres apart,
    those in its inside from points at half the size of a square. Between two points an edge is taken as straight, which is off by a metre or so (a few near 84 degrees).
    """
    count = lambda span, metres: F.greatest(F.lit(1), F.ceil(span * 111320.0 / metres).cast("int"))
    part = lambda w, e: F.struct(w.cast("double").alias("w"), e.cast("double").alias("e"))
    xmin, xmax = F.col("xmin"), F.col("xmax")
    halves = F.when(xmin <= xmax, F.array(part(xmin, xmax))).otherwise(F.array(part(xmin, F.lit(180.0)), part(F.lit(-180.0), xmax)))
    last = F.when(F.col("_h.e") >= 180, 60).otherwise(utm_zone(F.col("_h.e")))
    first = F.when(F.col("_h.w") >= 180, 60).otherwise(utm_zone(F.col("_h.w")))
    zones = boxes.select(F.struct("*").alias("_own"), "ymin", "ymax", F.explode(halves).alias("_h"))
    zones = zones.where("ymin <= 84 AND ymax >= -80").withColumn("_zone", F.explode(F.sequence(first, F.greatest(first, last))))
    band = lambda lat: F.least(F.lit(19), F.greatest(F.lit(0), F.floor(lat / 8 + 10))).cast("int")
    bands = zones.withColumn("_band", F.explode(F.sequence(band(F.col("ymin")), band(F.col("ymax")))))
    # A meridian between zones is the western one's, a parallel between bands the northern one's.
    west, east = F.greatest("_h.w", F.col("_zone") * 6.0 - 186 + F.when(F.col("_zone") > 1, 1e-9).otherwise(0.0)), F.least("_h.e", F.col("_zone") * 6.0 - 180)
    south, north = F.greatest("ymin", F.col("_band") * 8.0 - 80), F.least("ymax", F.when(F.col("_band") == 19, 84.0).otherwise(F.col("_band") * 8.0 - 72 - 1e-9))
    pieces = bands.select("_own", "_zone", "_band", west.alias("w"), east.alias("e"), south.alias("s"), north.alias("n")).where("w <= e AND s <= n")

    w, e, s, n = map(F.col, "wesn")
    place = lambda lon, lat: F.struct(lon.alias("lon"), lat.alias("lat"))
    # One pair for a step along an edge; inside, both of its points are the same.
    along = lambda much, at: F.transform(F.sequence(F.lit(0), much - 1), lambda i: F.struct(at(i / much).alias("a"), at((i + 1) / much).alias("b")))
    wide, high = count(e - w, edge), count(n - s, edge)
    edges = [along(wide, lambda t, lat=lat: place(w + (e - w) * t, lat)) for lat in (s, n)] + [along(high, lambda t, lon=lon: place(lon, s + (n - s) * t)) for lon in (w, e)]
    across, up = count(e - w, step), count(n - s, step)
    inside = F.flatten(F.transform(F.sequence(F.lit(0), across), lambda i: F.transform(F.sequence(F.lit(0), up), lambda j: place(w + (e - w) * i / across, s + (n - s) * j / up))))
    pairs = pieces.select("_own", "_zone", "_band", F.explode(F.concat(*edges, F.transform(inside, lambda p: F.struct(p.alias("a"), p.alias("b"))))).alias("_p"))
    (ax, ay), (bx, by) = (to_utm(F.col(f"_p.{p}.lon"), F.col(f"_p.{p}.lat"), F.col("_zone")) for p in "ab")
    pairs = pairs.select("_own", "_zone", "_band", *[(v / 100000).alias(c) for v, c in ((ax, "ax"), (ay, "ay"), (bx, "bx"), (by, "by"))])
    cell = lambda x, y: F.struct(F.floor(x).alias("x"), F.floor(y).alias("y"))
    share = lambda c: (F.greatest(F.floor(f"a{c}"), F.floor(f"b{c}")) - F.col(f"a{c}")) / (F.col(f"b{c}") - F.col(f"a{c}"))
    corner = (F.floor("ax") != F.floor("bx")) & (F.floor("ay") != F.floor("by"))
    between = F.when(corner, F.when(share("x") < share("y"), cell(F.col("bx"), F.col("ay"))).otherwise(cell(F.col("ax"), F.col("by")))).otherwise(cell(F.col("ax"), F.col("ay")))
    met = pairs.select("_own", "_zone", "_band", F.explode(F.array(cell(F.col("ax"), F.col("ay")), cell(F.col("bx"), F.col("by")), between)).alias("_c"))
    return met.select("_own.*", square_name(F.col("_zone"), F.col("_band"), F.col("_c.x"), F.col("_c.y")).alias("square")).distinct()


def shift_lon_360(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360).otherwise(lon)


def crosses_date_line(xmin: Column, xmax: Column) -> Column:
    """An extent of more than 300 degrees is taken for one across the date line."""
    return (xmax - xmin) > 300


def local_overpass_utc(day: Column, lon: Column) -> Column:
    """01:30 local solar time of a day, in UTC."""
    seconds = F.lit(5400.0) - lon / 15 * 3600
    return F.timestamp_micros((F.unix_micros(day.cast("timestamp")) + F.round(seconds * 1000000)).cast("long"))


def night_hours(lat: Column, day_of_year: Column) -> Column:
    """Whole hours of night from the solar declination; 0 and 24 in polar day and night."""
    declination = F.asin(F.sin(F.radians((day_of_year - 81) * (360 / 365.24))) * F.sin(F.radians(F.lit(23.44))))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(F.radians(lat)) * F.tan(declination)))
    return F.rint(24 - F.degrees(F.acos(cosine)) * 2 / 15).cast("int")


def night_hours_simple(lat: Column, day_of_year: Column) -> Column:
    """The second variant: declination 0.409 sin(2 pi (d - 80) / 365), ten hours at least."""
    declination = F.sin((day_of_year - 80) * 2 * F.pi() / 365) * 0.409
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(F.radians(lat)) * F.tan(declination)))
    return F.greatest(F.lit(10.0), 24 - F.degrees(F.acos(cosine)) * 2 / 15)


def baseline_month(day: Column, today: Column, mid_month: bool) -> Column:
    """Date of the monthly baseline: the month before if ``day`` is in the current month; the 15th or the 1st."""
    month = F.trunc(day, "month")
    month = F.when(month == F.trunc(today, "month"), F.add_months(month, -1)).otherwise(month)
    return F.date_add(month, 14 if mid_month else 0)


def baseline_year(day: Column, today: Column, mid_year: bool) -> Column:
    """Date of the yearly baseline: the year before if ``day`` is in the current year; July or January 1st."""
    year = F.year(day) - (F.year(day) == F.year(today)).cast("int")
    return F.make_date(year, F.lit(7 if mid_year else 1), F.lit(1))


def baseline_period(day: Column, today: Column, level: Column, stac: Column, lon: Column, recent: Column | None = None) -> Column:
    """Time that a search for the observations of ``day`` asks for, by processing level.

    Daily levels (A1, A2) are flown over at 01:30 local solar time at ``lon``, the middle of the area. Monthly ones (A3) lie on the 15th in catalogs (``stac``) and on the 1st elsewhere,
    a month before where ``day`` is in the current one; ``latest_available_month`` steps further back to what is published. Yearly ones (A4) lie on July 1st or January 1st; a day to come has none.
    Null for other levels, and where ``recent`` (a stream that holds seven days) is true and ``day`` is more than seven days off.
    """
    # Names of the levels, and the days that the near real-time stream holds.
    of = lambda *names: F.coalesce(F.upper(level).rlike("|".join(names)), F.lit(False))
    by_route = lambda at: F.when(stac, at(day, today, True)).otherwise(at(day, today, False)).cast("timestamp")
    period = F.when(of("A1", "A2"), local_overpass_utc(day, lon)).when(of("A3"), by_route(baseline_month)).when(of("A4") & (day <= today), by_route(baseline_year))
    return period if recent is None else F.when(~(recent & (F.abs(F.datediff(today, day)) > 7)), period)


def outage_baseline_day(day: Column) -> Column:
    """The day whose monthly baseline an outage on ``day`` is held against: six weeks before."""
    return F.date_sub(day, 42)
