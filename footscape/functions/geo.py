"""Geometry as column expressions.

A point is a pair of double columns or STRUCT<lng, lat>; a polyline is
ARRAY<STRUCT<lng, lat>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE = 111320.0
POINT = "struct<lng:double,lat:double>"
LINE = f"array<{POINT}>"
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def point(lng: Column, lat: Column) -> Column:
    return F.struct(lng.cast("double").alias("lng"), lat.cast("double").alias("lat"))


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    a1, a2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((a2 - a1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    s = half_lat * half_lat + F.cos(a1) * F.cos(a2) * half_lng * half_lng
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(s)))


def distance(a: Column, b: Column) -> Column:
    return haversine(a["lng"], a["lat"], b["lng"], b["lat"])


def pieces(line: Column) -> Column:
    """Array of STRUCT<i, a, b>: the straight pieces of a polyline in order."""
    return F.when(F.size(line) >= 2, F.transform(
        F.sequence(F.lit(0), F.size(line) - 2),
        lambda i: F.struct(i.alias("i"), F.get(line, i).alias("a"), F.get(line, i + 1).alias("b")),
    )).otherwise(F.array().cast(f"array<struct<i:int,a:{POINT},b:{POINT}>>"))


def line_length(line: Column) -> Column:
    return F.aggregate(pieces(line), F.lit(0.0), lambda acc, p: acc + distance(p["a"], p["b"]))


def along(a: Column, b: Column, t: Column) -> Column:
    """The point at fraction t between a and b, in degrees."""
    return point(a["lng"] + (b["lng"] - a["lng"]) * t, a["lat"] + (b["lat"] - a["lat"]) * t)


def line_midpoint(line: Column) -> Column:
    """The point half way along, by length."""
    half = line_length(line) / 2
    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast(POINT).alias("at"))

    def step(acc, p):
        d = distance(p["a"], p["b"])
        t = F.when(d == 0, F.lit(0.0)).otherwise((half - acc["done"]) / d)
        hit = acc["at"].isNull() & (acc["done"] + d >= half)
        return F.struct(
            (acc["done"] + d).alias("done"),
            F.when(hit, along(p["a"], p["b"], t)).otherwise(acc["at"]).alias("at"))

    found = F.aggregate(pieces(line), start, step, lambda acc: acc["at"])
    return F.when(F.size(line) == 1, F.get(line, F.lit(0))).otherwise(F.coalesce(found, F.get(line, F.size(line) - 1)))


def scale(lat: Column) -> tuple[Column, Column]:
    """Metres in a degree of longitude and of latitude at a latitude."""
    o = F.radians(lat)
    ky = F.lit(111132.92) - F.lit(559.82) * F.cos(2 * o)
    kx = F.lit(111412.84) * F.cos(o) - F.lit(93.5) * F.cos(3 * o)
    return kx, ky


def fraction(lng: Column, lat: Column, a: Column, b: Column, kx: Column, ky: Column) -> Column:
    """How far along a piece its point closest to (lng, lat) lies, 0 to 1, on a plane of the given scale."""
    ax, ay = a["lng"] * kx, a["lat"] * ky
    dx, dy = b["lng"] * kx - ax, b["lat"] * ky - ay
    den = dx * dx + dy * dy
    raw = F.when(den == 0, F.lit(0.0)).otherwise(((lng * kx - ax) * dx + (lat * ky - ay) * dy) / den)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def nearest_on_piece(lng: Column, lat: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """(fraction along the piece, metres) of the closest point, on a plane at the point's latitude."""
    t = fraction(lng, lat, a, b, *scale(lat))
    foot = along(a, b, t)
    return t, haversine(lng, lat, foot["lng"], foot["lat"])


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns, as `withColumns` does, behind an `explode` of one row.

    Expressions over them name them, and are not rewritten into expressions over what they were made of: a formula in which each step
    uses the one before several times would grow with every step, until its code is too long to be compiled.
    """
    out = df.withColumn("_held", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    return out.withColumns({n: F.col("_held")[n] for n in columns}).drop("_held")


def with_nearest(pairs: DataFrame, lng: Column, lat: Column, a: Column, b: Column) -> DataFrame:
    """Add `t` and `dist`, as `nearest_on_piece` has them, to pairs of points and pieces with the `scale` of the point, `kx` and `ky`."""
    out = held(pairs, t=fraction(lng, lat, a, b, F.col("kx"), F.col("ky")))
    foot = along(a, b, F.col("t"))
    return held(out, dist=haversine(lng, lat, foot["lng"], foot["lat"]))


def point_to_line(lng: Column, lat: Column, line: Column) -> Column:
    """STRUCT<dist, idx, t, foot> of the closest point of a polyline; the first piece wins ties."""
    def one(p):
        t, d = nearest_on_piece(lng, lat, p["a"], p["b"])
        return F.struct(d.alias("dist"), p["i"].alias("idx"), t.alias("t"), along(p["a"], p["b"], t).alias("foot"))

    single = F.struct(
        distance(point(lng, lat), F.get(line, F.lit(0))).alias("dist"), F.lit(0).alias("idx"),
        F.lit(0.0).alias("t"), F.get(line, F.lit(0)).alias("foot"))
    return F.when(F.size(line) == 1, single).otherwise(F.array_min(F.transform(pieces(line), one)))


def bearing(a: Column, b: Column) -> Column:
    """Initial bearing a→b in [0, 360)."""
    l1, l2, d = F.radians(a["lat"]), F.radians(b["lat"]), F.radians(b["lng"] - a["lng"])
    y = F.sin(d) * F.cos(l2)
    x = F.cos(l1) * F.sin(l2) - F.sin(l1) * F.cos(l2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def bearing_delta(a: Column, b: Column) -> Column:
    """Unsigned difference of two bearings, 0 to 180."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.when(d > 180, F.lit(360.0) - d).otherwise(d)


def signed_turn(a: Column, b: Column) -> Column:
    """Turn from bearing a to b in (-180, 180]; positive is to the right."""
    d = F.pmod(b - a + 540, F.lit(360.0)) - 180
    return F.when(d == -180, F.lit(180.0)).otherwise(d)


def bbox(line: Column) -> Column:
    """STRUCT<w, s, e, n>."""
    lngs, lats = F.transform(line, lambda p: p["lng"]), F.transform(line, lambda p: p["lat"])
    return F.struct(
        F.array_min(lngs).alias("w"), F.array_min(lats).alias("s"),
        F.array_max(lngs).alias("e"), F.array_max(lats).alias("n"))


def pad_bbox(box: Column, metres: float | Column) -> Column:
    m = metres if isinstance(metres, Column) else F.lit(float(metres))
    d_lat = m / F.lit(METRES_PER_DEGREE)
    cos_mid = F.greatest(F.lit(0.1), F.cos(F.radians((box["s"] + box["n"]) / 2)))
    d_lng = m / (F.lit(METRES_PER_DEGREE) * cos_mid)
    return F.struct(
        (box["w"] - d_lng).alias("w"), (box["s"] - d_lat).alias("s"),
        (box["e"] + d_lng).alias("e"), (box["n"] + d_lat).alias("n"))


def bbox_intersects(a: Column, b: Column) -> Column:
    return ~((a["e"] < b["w"]) | (a["w"] > b["e"]) | (a["n"] < b["s"]) | (a["s"] > b["n"]))


def bbox_area_km2(box: Column) -> Column:
    h = (box["n"] - box["s"]) * F.lit(110.574)
    w = (box["e"] - box["w"]) * F.lit(111.320) * F.cos(F.radians((box["s"] + box["n"]) / 2))
    return F.abs(h * w)


def cell(lng: Column, lat: Column, deg: float) -> Column:
    """Grid cell of a point as STRUCT<cx, cy>; the join key of every spatial join here."""
    return F.struct(F.floor(lng / F.lit(deg)).alias("cx"), F.floor(lat / F.lit(deg)).alias("cy"))


def cells_of_box(box: Column, deg: float) -> Column:
    """All grid cells a bounding box touches."""
    xs = F.sequence(F.floor(box["w"] / F.lit(deg)), F.floor(box["e"] / F.lit(deg)))
    ys = F.sequence(F.floor(box["s"] / F.lit(deg)), F.floor(box["n"] / F.lit(deg)))
    return F.flatten(F.transform(xs, lambda x: F.transform(
        ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def geohash(lng: Column, lat: Column, precision: int) -> Column:
    """Base-32 geohash from interleaved bits of the two scaled coordinates."""
    bits = precision * 5
    lng_bits, lat_bits = (bits + 1) // 2, bits // 2

    def scaled(value, low, span, n):
        top = float(1 << n)
        return F.greatest(F.lit(0.0), F.least(F.lit(top - 1), F.floor((value - low) / span * top).cast("double"))).cast("long")

    x, y = scaled(lng, -180.0, 360.0, lng_bits), scaled(lat, -90.0, 180.0, lat_bits)

    def bit(i):  # i-th bit from the left; even positions carry longitude
        source, width = (x, lng_bits) if i % 2 == 0 else (y, lat_bits)
        return F.shiftright(source, width - 1 - i // 2).bitwiseAND(F.lit(1))

    chars = []
    for c in range(precision):
        code = sum((bit(c * 5 + j) * (1 << (4 - j)) for j in range(1, 5)), bit(c * 5) * 16)
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def round_coord(x: Column, decimals: int = 5) -> Column:
    f = float(10 ** decimals)
    return F.floor(x * F.lit(f) + F.lit(0.5)).cast("double") / F.lit(f)
