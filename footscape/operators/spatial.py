"""Spatial joins: equi-joins on grid cells with an exact distance test behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footscape import params as P
from footscape.functions import geo as G
from footscape.operators.observations import newest_n
from footscape.session import stored

ROWS_PER_TASK = 500_000
#: A table of more rows is never broadcast: what Spark expects of its size is taken from compressed files, far below that of its rows in the driver.
BROADCAST_ROWS = 100_000
#: The share of the radius in which points are snapped first.
FIRST_REACH = 1 / 8


def unless_few(df: DataFrame) -> DataFrame:
    """`df` as a side of joins that are shuffled and merged, unless it has few rows."""
    return df.hint("merge") if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS else df


def split_hot(big: DataFrame, small: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """Add `_salt` to both sides so that no join key brings more than `rows_per_task` big rows to one task.

    The table of hot keys has at most rows(big) / rows_per_task rows, which bounds
    the broadcast; keys that are not hot keep a single salt value.
    """
    # stored, as both sides read it and the big side may be dear
    hot = stored(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows_per_task)
                 .select(*keys, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_n")))
    if hot.isEmpty():
        return big.withColumn("_salt", F.lit(0)), small.withColumn("_salt", F.lit(0))
    b = big.join(F.broadcast(hot), keys, "left")
    flat = [c for c, t in big.dtypes if not t.startswith("map")]
    b = b.withColumn("_salt", F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64(*flat), F.col("_n")).cast("int"))).drop("_n")
    s = small.join(F.broadcast(hot), keys, "left")
    s = s.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return b, s


def grid_cells(df: DataFrame, deg: float, lng: str = "lng", lat: str = "lat", reach: int = 0) -> DataFrame:
    """Add the grid cell (`cx`, `cy`) of a point; with `reach`, one row per neighbouring cell."""
    cx, cy = F.floor(F.col(lng) / F.lit(deg)), F.floor(F.col(lat) / F.lit(deg))
    if reach == 0:
        return df.withColumns({"cx": cx, "cy": cy})
    around = F.sequence(F.lit(-reach), F.lit(reach))
    out = df.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    return out.withColumns({"cx": cx + F.col("_dx"), "cy": cy + F.col("_dy")}).drop("_dx", "_dy")


def shape_cells(shapes: DataFrame, deg: float, radius_m: float) -> DataFrame:
    """One row per grid cell that a polyline, widened by the radius, touches."""
    cells = G.cells_of_box(G.pad_bbox(G.bbox(F.col("geometry")), radius_m * 1.01), deg)
    return shapes.withColumn("_c", F.explode(cells)).select("*", "_c.cx", "_c.cy").drop("_c")


def points_near_lines(points: DataFrame, lines: DataFrame, radius_m: float, deg: float,
                      point_columns: list[str], line_columns: list[str], of_piece: dict[str, Column] | None = None) -> DataFrame:
    """Points with each straight piece of a polyline within the radius: `idx`, `t`, `dist`, `a`, `b`.

    `of_piece` are further columns over `a` and `b`, computed once per piece instead of once per pair.

    Only the pieces are put into several cells; a point looks in its own cell, so a
    pair is met once.  A long polyline is as cheap as its pieces, and the distance
    is plain arithmetic.  A cheap box test comes before the trigonometry.
    """
    kx, ky = G.scale(F.col("lat"))
    pts = grid_cells(points.select(*point_columns, "lng", "lat").withColumns({"kx": kx, "ky": ky}), deg)
    # a polyline of a single point is a piece of no length
    line = F.when(F.size("geometry") == 1, F.array(F.struct(
        F.lit(0).alias("i"), F.get("geometry", F.lit(0)).alias("a"), F.get("geometry", F.lit(0)).alias("b")))).otherwise(G.pieces(F.col("geometry")))
    pcs = lines.select(*line_columns, F.explode(line).alias("p")).select(*line_columns, F.col("p.i").alias("idx"), "p.a", "p.b")
    box = G.pad_bbox(G.bbox(F.array("a", "b")), radius_m * 1.01)
    pcs = pcs.withColumns({"box": box, **(of_piece or {})}).withColumn("_c", F.explode(G.cells_of_box(F.col("box"), deg)))
    pcs = pcs.select(*line_columns, "idx", "a", "b", *(of_piece or {}), "box", "_c.cx", "_c.cy")
    pts, pcs = split_hot(pts, pcs, ["cx", "cy"])
    near_box = F.col("lng").between(F.col("box.w"), F.col("box.e")) & F.col("lat").between(F.col("box.s"), F.col("box.n"))
    pairs = pts.join(unless_few(pcs), ["cx", "cy", "_salt"]).filter(near_box).drop("cx", "cy", "_salt", "box")
    pairs = G.with_nearest(pairs, F.col("lng"), F.col("lat"), F.col("a"), F.col("b")).drop("kx", "ky")
    return pairs.filter(F.col("dist") <= radius_m)


def images_near_segments(images: DataFrame, segments: DataFrame) -> DataFrame:
    """Frame and segment pairs within the search radius, with `near` = the closest piece (and its `bearing`). Images have one row per id.

    A segment of a single piece meets a frame once, so its pairs are final; only those of segments of several
    pieces, or whose id comes twice, are gathered by pair.
    """
    attrs = ["lng", "lat", "captured_at", "compass_angle", "quality_score", "sequence_id"]
    pieces = segments.groupBy(F.col("segment_id").alias("_id")).agg(F.sum(F.greatest(F.lit(1), F.size("geometry") - 1)).alias("_n"))
    lines = segments.select("segment_id", "geometry").join(pieces.filter("_n > 1"), F.col("segment_id").eqNullSafe(F.col("_id")), "left")
    lines = stored(lines.select("segment_id", "geometry", F.col("_n").isNotNull().alias("many")))
    pairs = points_near_lines(images, lines, P.IMAGE_RADIUS_M, 0.0006, ["image_id", *attrs[2:]], ["segment_id", "many"], {"bearing": G.bearing(F.col("a"), F.col("b"))})
    near = F.struct("dist", "idx", "t", "a", "b", "bearing").alias("near")
    once = lambda many: pairs.filter(F.col("many") if many else ~F.col("many"))
    single = once(False).select("image_id", "segment_id", near, *attrs)
    if lines.filter("many").isEmpty():
        return single
    return single.unionByName(once(True).groupBy("image_id", "segment_id").agg(F.min(near).alias("near"), *[F.first(c).alias(c) for c in attrs]))


def snap_points(points: DataFrame, edges: DataFrame, radius_m: float = P.SNAP_RADIUS_M, key: str = "point_id", within: bool = False) -> DataFrame:
    """The nearest edge of every point within the radius; points without one are absent. `within`: only edges of the point's region count.

    A plain minimum per point, so it is combined before the shuffle. Points with an edge within a share of the radius are
    settled first, since none farther away can be nearer; only the others meet all edges within the whole radius.
    """
    close = stored(_nearest(points.filter(F.col(key).isNotNull()), edges, radius_m * FIRST_REACH, key, within))
    return close.unionByName(_nearest(points.join(unless_few(close.select(key)), key, "left_anti"), edges, radius_m, key, within))


def _nearest(points: DataFrame, edges: DataFrame, radius_m: float, key: str, within: bool) -> DataFrame:
    own, theirs = ([key, "_region"], ["segment_id", "region_id"]) if within else ([key], ["segment_id"])
    points = points.withColumnRenamed("region_id", "_region") if within else points
    pairs = points_near_lines(points, edges, radius_m, max(0.0006, 0.002 * radius_m / P.SNAP_RADIUS_M), own, theirs)
    pairs = pairs.filter("_region = region_id") if within else pairs
    best = pairs.groupBy(key).agg(F.min(F.struct("dist", "segment_id", "idx", "t", "a", "b")).alias("n"))
    n = F.col("n")
    return best.select(key, n["dist"].alias("dist"), n["segment_id"].alias("segment_id"), n["idx"].alias("idx"), n["t"].alias("t"),
                       G.along(n["a"], n["b"], n["t"]).alias("foot"))


def nearby_pois(segments: DataFrame, pois: DataFrame, radius_m: float = P.POI_RADIUS_M) -> DataFrame:
    """One row per segment and public service within the radius of its centre, with rounded metres."""
    deg = 0.005
    places = pois.select("poi_id", F.col("class"), "name", F.col("lng").alias("plng"), F.col("lat").alias("plat"),
                         F.array(G.point(F.col("lng"), F.col("lat"))).alias("geometry"))
    places = shape_cells(places, deg, radius_m).drop("geometry")
    centres = grid_cells(segments.select("segment_id", F.col("centre")["lng"].alias("lng"), F.col("centre")["lat"].alias("lat")), deg)
    centres, places = split_hot(centres, places, ["cx", "cy"])
    d = G.haversine(F.col("lng"), F.col("lat"), F.col("plng"), F.col("plat"))
    return (centres.join(places, ["cx", "cy", "_salt"]).withColumn("_d", d).filter(F.col("_d") <= radius_m)
            .select("segment_id", "poi_id", "class", "name", F.floor(F.col("_d") + 0.5).cast("int").alias("distance_m")))


def nearest_pois(pairs: DataFrame, n: int = 6) -> DataFrame:
    """The n nearest services per segment as a bounded array."""
    top = newest_n(pairs, ["segment_id"], [F.asc("distance_m"), F.asc("poi_id")], n)
    return top.groupBy("segment_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(
        "rn", "class", "name", "distance_m"))), lambda p: F.struct(p["class"].alias("class"), p["name"].alias("name"),
                                                                  p["distance_m"].alias("distance_m"))).alias("nearby_pois"))


def points_in_regions(points: DataFrame, regions: DataFrame, deg: float = 0.05) -> DataFrame:
    """Points with each region whose bounding box (`bbox`) holds them, by a grid equi-join."""
    boxes = regions.withColumn("_c", F.explode(G.cells_of_box(F.col("bbox"), deg))).select("*", "_c.cx", "_c.cy").drop("_c")
    pts, boxes = split_hot(grid_cells(points, deg), boxes, ["cx", "cy"])
    b = F.col("bbox")
    inside = F.col("lng").between(b["w"], b["e"]) & F.col("lat").between(b["s"], b["n"])
    return pts.join(boxes, ["cx", "cy", "_salt"]).filter(inside).drop("cx", "cy", "_salt")


def segments_in_bbox(segments: DataFrame, box: Column, pad_m: float = P.IMAGE_RADIUS_M) -> DataFrame:
    """Add `in_search_area`: the polyline's envelope meets the padded search box."""
    return segments.withColumn("in_search_area", (F.size("geometry") > 0) & G.bbox_intersects(
        G.pad_bbox(box, pad_m), G.bbox(F.col("geometry"))))


def bbox_area_guard(regions: DataFrame, max_km2: float = P.MAX_IMPORT_KM2) -> DataFrame:
    """Add `area_km2` and `too_large`."""
    return regions.withColumn("area_km2", G.bbox_area_km2(F.col("bbox"))).withColumn("too_large", F.col("area_km2") > max_km2)


def tile_bbox(boxes: DataFrame, max_span: float) -> DataFrame:
    """Split every box into an equal grid of tiles no wider than `max_span` degrees."""
    b = F.col("bbox")
    cols = F.greatest(F.lit(1), F.ceil((b["e"] - b["w"]) / max_span).cast("int"))
    rows = F.greatest(F.lit(1), F.ceil((b["n"] - b["s"]) / max_span).cast("int"))
    t = boxes.withColumns({"_cols": cols, "_rows": rows})
    t = t.withColumn("tile_x", F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)))
    t = t.withColumn("tile_y", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)))
    dx, dy = (b["e"] - b["w"]) / F.col("_cols"), (b["n"] - b["s"]) / F.col("_rows")
    return t.withColumn("tile", F.struct(
        (b["w"] + F.col("tile_x") * dx).alias("w"), (b["s"] + F.col("tile_y") * dy).alias("s"),
        (b["w"] + (F.col("tile_x") + 1) * dx).alias("e"), (b["s"] + (F.col("tile_y") + 1) * dy).alias("n"))).drop("_cols", "_rows")


def tile_truncation(images: DataFrame, tiles: DataFrame, limit: int = P.TILE_IMAGE_LIMIT) -> DataFrame:
    """Images per tile, with `truncated` where the count reaches the limit; empty tiles count 0.

    Needs `tile_id` and `tile`; an image on a shared edge counts for both tiles.
    """
    pairs = points_in_regions(images.select("image_id", "lng", "lat"), tiles.select("tile_id", F.col("tile").alias("bbox")))
    counts = pairs.groupBy("tile_id").agg(F.count(F.lit(1)).alias("images"))
    return (tiles.join(counts, "tile_id", "left").withColumn("images", F.coalesce("images", F.lit(0)))
            .withColumn("truncated", F.col("images") >= limit))
