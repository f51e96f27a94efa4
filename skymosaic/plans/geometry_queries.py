"""Queries of tiling, box geometry, affine transforms, projections and the tile join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import projections as P
from ..functions import quads as Q
from ..operators import align, coast, labels, spatial, tiling
from ..session import checkpointed
from .fixtures import frame
from .registry import area, quad, query


def xy(points, k: int, digits: int = 6):
    p = F.element_at(points, k + 1)
    return [F.round(p["x"], digits).alias(f"px{k}"), F.round(p["y"], digits).alias(f"py{k}")]


def pairs(spark: SparkSession, sf_dir: str, keep_all: bool = False) -> DataFrame:
    """Tile labels: tile_id, source_id, ann_id, class_id, visible."""
    annotations = labels.keep_trained(frame(spark, sf_dir, "annotations")).select("ann_id", "source_id", "class_id", "points")
    tiles = frame(spark, sf_dir, "tiles").select("source_id", "tile_id", "x_off", "y_off", "tw", "th")
    return spatial.tile_annotation_join(tiles, annotations, keep_all=keep_all, quads=True)


@query("SELECT tile_id, ann_id, class_id, round(visible, 6) visible FROM tile_labels")
def tile_annotation_join(spark, sf_dir):
    return pairs(spark, sf_dir).select("tile_id", "ann_id", "class_id", F.round("visible", 6).alias("visible"))


@query("SELECT class_id, count(*) pairs, count(*) FILTER (WHERE visible >= 0.25e0) kept, count(*) FILTER (WHERE visible < 0.25e0) dropped, count(*) FILTER (WHERE visible = 0) touching FROM tile_pairs GROUP BY class_id")
def visibility_audit(spark, sf_dir):
    n = lambda c: F.count_if(c)
    return pairs(spark, sf_dir, True).groupBy("class_id").agg(F.count("*").alias("pairs"), n(F.col("visible") >= 0.25).alias("kept"), n(F.col("visible") < 0.25).alias("dropped"), n(F.col("visible") == 0).alias("touching"))


@query("""
    SELECT (SELECT count(*) FROM annotations) read, (SELECT count(*) FROM annotations WHERE class_raw = 9) dropped_class, CAST(0 AS BIGINT) dropped_geometry,
           count(*) pairs, count(*) FILTER (WHERE visible >= 0.25e0) kept, count(*) FILTER (WHERE visible < 0.25e0) dropped_visible, count(*) FILTER (WHERE visible = 0) touching FROM tile_pairs""")
def label_counters(spark, sf_dir):
    """What is counted on the way while labels are written: one pass over tiles and annotations."""
    annotations = frame(spark, sf_dir, "annotations").select("ann_id", "source_id", "class_raw", "points")
    tiles = frame(spark, sf_dir, "tiles").select("source_id", "tile_id", "x_off", "y_off", "tw", "th")
    kept, counted = spatial.counted_join(tiles, annotations, quads=True)
    checkpointed(kept.select("tile_id", "ann_id", "class_id"))
    found = counted()
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"`{k}` long" for k in found))


@query("""
    SELECT source_id, i*384 col_off, j*384 row_off, least(768, w-i*384) tile_width, least(768, h-j*384) tile_height, 500000e0+0.5e0*(i*384) origin_x, 8000000e0-0.5e0*(j*384) origin_y
    FROM (SELECT *, unnest(range(CAST(ceil(h/384e0) AS BIGINT))) j FROM (SELECT *, unnest(range(CAST(ceil(w/384e0) AS BIGINT))) i FROM sources) a) b""")
def tile_grid(spark, sf_dir):
    moved = G.window_affine(G.affine(0.5, 0.0, 500000.0, 0.0, -0.5, 8000000.0), F.col("col_off"), F.col("row_off"))
    grid = tiling.tile_grid(frame(spark, sf_dir, "sources"))
    return grid.select("source_id", "col_off", "row_off", "tile_width", "tile_height", moved["c"].alias("origin_x"), moved["f"].alias("origin_y"))


@query("""
    SELECT tile_id, 768-tw pad_right, 768-th pad_bottom,
           array_to_string(list_transform(range(16), lambda k: CASE WHEN k//4 < th%3+1 AND k%4 < tw%3+1 THEN tile_id%7+1 ELSE 0 END), ',') cells FROM tiles""")
def tile_edge_padding(spark, sf_dir):
    t = frame(spark, sf_dir, "tiles")
    value = (F.col("tile_id") % 7 + 1).cast("double")
    pixels = F.array_repeat(F.array_repeat(value, (F.col("tw") % 3 + 1).cast("int")), (F.col("th") % 3 + 1).cast("int"))
    cells = F.array_join(F.transform(F.flatten(tiling.pad(pixels, 4, 4)), lambda v: v.cast("int").cast("string")), ",")
    return t.select("tile_id", (768 - F.col("tw")).alias("pad_right"), (768 - F.col("th")).alias("pad_bottom"), cells.alias("cells"))


@query("""
    SELECT tile_id, bands, CASE WHEN len(b) >= 3 THEN array_to_string(b[1:3], ',') ELSE concat(b[1], ',', b[1], ',', b[1]) END chosen
    FROM (SELECT tile_id, tile_id%5+1 bands, list_transform(range(tile_id%5+1), lambda k: tile_id%11+k) b FROM tiles) t""")
def band_selection(spark, sf_dir):
    bands = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tile_id") % 5), lambda k: F.col("tile_id") % 11 + k)
    return frame(spark, sf_dir, "tiles").select("tile_id", (F.col("tile_id") % 5 + 1).alias("bands"), F.array_join(F.transform(tiling.select_bands(bands), lambda v: v.cast("string")), ",").alias("chosen"))


@query("SELECT class_raw, CAST(CASE WHEN class_raw = 9 THEN NULL WHEN class_raw = 6 THEN 4 ELSE class_raw END AS INT) class_id, count(*) n FROM annotations GROUP BY class_raw")
def class_remap_filter(spark, sf_dir):
    return frame(spark, sf_dir, "annotations").groupBy("class_raw", labels.remap(F.col("class_raw")).alias("class_id")).agg(F.count("*").alias("n"))


_side = lambda a, b: f"sqrt((x{b}-x{a})*(x{b}-x{a}) + (y{b}-y{a})*(y{b}-y{a}))"
_sides = ", ".join(_side(k, (k + 1) % 4) for k in range(4))


@query(f"""
    SELECT ann_id, round({area(quad())}, 6) area, round(greatest({_sides}), 6) long_side, round(least({_sides}), 6) short_side,
           round(least(x0,x1,x2,x3), 6) min_x, round(greatest(y0,y1,y2,y3), 6) max_y, round(cx, 4) centre_x, round(cy, 4) centre_y FROM annotations""")
def obb_geometry(spark, sf_dir):
    p, b, c = F.col("points"), Q.bounds(F.col("points")), Q.centroid(F.col("points"))
    r = lambda v, n, d=6: F.round(v, d).alias(n)
    return frame(spark, sf_dir, "annotations").select("ann_id", r(Q.area(p), "area"), r(Q.long_side(p), "long_side"), r(Q.short_side(p), "short_side"), r(b["x0"], "min_x"), r(b["y1"], "max_y"), r(c["x"], "centre_x", 4), r(c["y"], "centre_y", 4))


def _min_side(least: str) -> str:
    inner = f"SELECT *, (x0+x1+x2+x3)/4 mx, (y0+y1+y2+y3)/4 my, {_side(0, 1)} n1, {_side(1, 2)} n2 FROM annotations"
    axes = f"SELECT *, (x1-x0)/n1*(greatest(n1,{least})/2) ux, (y1-y0)/n1*(greatest(n1,{least})/2) uy, (x2-x1)/n2*(greatest(n2,{least})/2) vx, (y2-y1)/n2*(greatest(n2,{least})/2) vy FROM ({inner}) a"
    corner = lambda k, s, t: f"round(mx{s}ux{t}vx, 6) px{k}, round(my{s}uy{t}vy, 6) py{k}"
    return f"SELECT ann_id, {corner(0, '-', '-')}, {corner(1, '+', '-')}, {corner(2, '+', '+')}, {corner(3, '-', '+')} FROM ({axes}) b"


@query(_min_side("12e0"))
def obb_enforce_min_side(spark, sf_dir):
    grown = frame(spark, sf_dir, "annotations").select("ann_id", G.enforce_min_side(F.col("points"), 12.0).alias("g"))
    return grown.select("ann_id", *[c for k in range(4) for c in xy(F.col("g"), k)])


@query(f"SELECT ann_id, round({area(quad())}, 4) area FROM annotations")
def min_rotated_rectangle(spark, sf_dir):
    return _rectangles(frame(spark, sf_dir, "annotations"))


def _rectangles(a):
    """The smallest rectangle around the corners and middles of a rectangle's sides has the rectangle's area."""
    p = Q.corners(F.col("points"))
    mid = F.array(*[G.point((p[k][0] + p[(k + 1) % 4][0]) / 2, (p[k][1] + p[(k + 1) % 4][1]) / 2) for k in range(4)])
    return a.select("ann_id", F.round(Q.area(G.min_rotated_rectangle(F.concat("points", mid))), 4).alias("area"))


@query("""
    SELECT ann_id, round(gx, 6) gx, round(gy, 6) gy, round(0.5e0*(x0+0.5e0)+0.25e0*(y0+0.5e0)+c0, 6) centre_gx, round(x0, 6) back_x, round(y0, 6) back_y FROM
    (SELECT *, 0.5e0*x0+0.25e0*y0+c0 gx, -0.25e0*x0+-0.5e0*y0+8000000e0 gy FROM (SELECT *, 500000e0+source_id*1000e0 c0 FROM annotations) a) b""")
def affine_roundtrip(spark, sf_dir):
    t = G.affine(0.5, 0.25, F.lit(500000.0) + F.col("source_id") * 1000.0, -0.25, -0.5, 8000000.0)
    a = frame(spark, sf_dir, "annotations").withColumn("t", G.affine_from_text(G.affine_to_text(t)))
    a = a.withColumn("g", G.apply_affine(F.col("t"), F.slice("points", 1, 1))).withColumn("b", G.invert_affine(F.col("t"), F.col("g"))).withColumn("c", G.apply_affine(F.col("t"), F.slice("points", 1, 1), 0.5))
    r = lambda c, f, n: F.round(F.element_at(c, 1)[f], 6).alias(n)
    return a.select("ann_id", r("g", "x", "gx"), r("g", "y", "gy"), r("c", "x", "centre_gx"), r("b", "x", "back_x"), r("b", "y", "back_y"))


_local = lambda k: f"{{'x': (a.x{k}-t.x_off)/768e0, 'y': (a.y{k}-t.y_off)/768e0}}"


@query(f"""
    SELECT l.tile_id, l.ann_id, l.class_id, (a.x0-t.x_off)/768e0 px0, (a.y0-t.y_off)/768e0 py0, (a.x2-t.x_off)/768e0 px2, (a.y2-t.y_off)/768e0 py2
    FROM tile_labels l JOIN tiles t ON l.tile_id = t.tile_id JOIN annotations a ON l.ann_id = a.ann_id WHERE {area('[' + ', '.join(_local(k) for k in range(4)) + ']')} >= 1e-9""")
def label_rows(spark, sf_dir):
    rows = labels.to_label_rows(pairs(spark, sf_dir), quads=True)
    corner = lambda k, f: F.col("corners")[k][f].alias(f"p{f}{k}")
    return rows.select("tile_id", "ann_id", "class_id", *[corner(k, f) for k in (0, 2) for f in "xy"])


@query("SELECT t.tile_id, count(l.ann_id) n_labels, count(l.ann_id) = 0 background FROM tiles t LEFT JOIN tile_labels l ON t.tile_id = l.tile_id GROUP BY t.tile_id")
def tile_labels_with_background(spark, sf_dir):
    """Labels are counted; their text, which `with_background` also makes, is not read here and so not built."""
    rows = labels.to_label_rows(pairs(spark, sf_dir), quads=True).select("tile_id", labels.label_line(F.col("class_id"), F.col("corners")).alias("line"))
    tiles = labels.with_background(frame(spark, sf_dir, "tiles").select("tile_id"), rows)
    return tiles.select("tile_id", "n_labels", (F.col("n_labels") == 0).alias("background"))


@query(f"""
    SELECT ann_id, round(side, 6) side, round(mx-side/2, 6) min_x, round(my-side/2, 6) min_y, round(mx+side/2, 6) max_x, round(my+side/2, 6) max_y, round(CASE WHEN side > 0 THEN 224e0/(side/0.5e0) ELSE 0 END, 6) scale
    FROM (SELECT *, greatest(bx1-bx0, by1-by0) side, (bx0+bx1)/2 mx, (by0+by1)/2 my FROM (SELECT *, least(x0,x1,x2,x3) bx0, least(y0,y1,y2,y3) by0, greatest(x0,x1,x2,x3) bx1, greatest(y0,y1,y2,y3) by1 FROM annotations) a) b
    WHERE class_raw IN (0, 2)""")
def square_chip_windows(spark, sf_dir):
    chips = tiling.square_chips(labels.of_classes(frame(spark, sf_dir, "annotations")), resolution=0.5)
    return chips.select("ann_id", *[F.round(c, 6).alias(c) for c in ("side", "min_x", "min_y", "max_x", "max_y", "scale")])


_ZOOM = 12
_X, _Y = (lambda v: f"CAST(floor(({v}+180e0)/360e0*4096) AS BIGINT)"), (lambda v: f"CAST(floor((1e0-asinh(tan(radians({v})))/pi())/2e0*4096) AS BIGINT)")
_WINDOW = "x/4096e0*360e0-180e0 west, degrees(atan(sinh(pi()*(1e0-2e0*(y+1)/4096e0)))) south, (x+1)/4096e0*360e0-180e0 east, degrees(atan(sinh(pi()*(1e0-2e0*y/4096e0)))) north"
_SLIPPY = f"""SELECT k, x, y, {_WINDOW} FROM
    (SELECT *, unnest(range({_Y("north")}, {_Y("south+1e-9")}+1)) y FROM (SELECT *, unnest(range({_X("west")}, {_X("east-1e-9")}+1)) x FROM islands) a) b"""
_OVER = "(greatest(0e0, least(t.east, {e})-greatest(t.west, {w}))*greatest(0e0, least(t.north, {n})-greatest(t.south, {s})))"
_LAND, _LAKE = _OVER.format(w="i.west", s="i.south", e="i.east", n="i.north"), _OVER.format(w="i.lw", s="i.ls", e="i.le", n="i.ln")
_ON_EDGE = "(t.west <= {e} AND {w} <= t.east AND t.south <= {n} AND {s} <= t.north AND NOT (t.west > {w} AND t.east < {e} AND t.south > {s} AND t.north < {n}))"
_COAST = f"""SELECT DISTINCT t.x, t.y, t.west, t.south, t.east, t.north FROM ({_SLIPPY}) t JOIN islands i ON t.k = i.k
    WHERE {_ON_EDGE.format(w="i.west", s="i.south", e="i.east", n="i.north")} OR (lake AND {_ON_EDGE.format(w="lw", s="ls", e="le", n="ln")})"""


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, points, hole): the rings of all islands and lakes."""
    ring = lambda w, s, e, n: F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ((w, s), (e, s), (e, n), (w, n))])
    islands = frame(spark, sf_dir, "islands")
    lakes = islands.filter("lake").select("k", ring("lw", "ls", "le", "ln").alias("points"), F.lit(True).alias("hole"))
    return islands.select("k", ring("west", "south", "east", "north").alias("points"), F.lit(False).alias("hole")).unionByName(lakes)


def _slippy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of every island's bounds."""
    tiles = frame(spark, sf_dir, "islands").select("k", F.explode(P.tiles_of(*[F.col(c) for c in ("west", "south", "east", "north")], _ZOOM)).alias("t")).select("k", "t.x", "t.y")
    return tiles.withColumn("b", P.tile_bounds(F.col("x"), F.col("y"), _ZOOM)).select("k", "x", "y", "b.*")


@query(f"SELECT k, x, y, round(west, 6) west, round(south, 6) south, round(east, 6) east, round(north, 6) north FROM ({_SLIPPY}) s")
def slippy_tiles(spark, sf_dir):
    return _slippy(spark, sf_dir).select("k", "x", "y", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


@query(f"SELECT x, y, round(west, 6) west, round(north, 6) north FROM ({_COAST}) c")
def coast_tiles(spark, sf_dir):
    """Tiles that a shore crosses, that of a lake included."""
    return coast.coast_tiles(_islands(spark, sf_dir), _ZOOM).select("x", "y", *[F.round(c, 6).alias(c) for c in ("west", "north")])


@query(f"""
    SELECT x, y, round(ratio, 6) ratio FROM (
      SELECT x, y, sum({_LAND}-CASE WHEN lake THEN {_LAKE} ELSE 0e0 END)/((max(t.east)-max(t.west))*(max(t.north)-max(t.south))) ratio
      FROM ({_COAST}) t JOIN islands i ON t.west < i.east AND i.west < t.east AND t.south < i.north AND i.south < t.north GROUP BY x, y) r WHERE ratio BETWEEN 0.30 AND 0.65""")
def land_ratio_filter(spark, sf_dir):
    """Tiles on a shore that are 30 to 65 percent land; lakes are no land."""
    land = _islands(spark, sf_dir)
    tiles = coast.land_share(coast.coast_tiles(land, _ZOOM), land)
    return tiles.filter(F.col("land_ratio").between(0.30, 0.65)).select("x", "y", F.round("land_ratio", 6).alias("ratio"))


_PHI, _LAM = "radians(lat)", "radians(lon-51e0)"
_ECC = repr(P._e)
_TERMS_X = "".join(f" + {a!r}*cos({2 * (k + 1)}*xi)*sinh({2 * (k + 1)}*eta)" for k, a in enumerate(P.FORWARD))
_TERMS_Y = "".join(f" + {a!r}*sin({2 * (k + 1)}*xi)*cosh({2 * (k + 1)}*eta)" for k, a in enumerate(P.FORWARD))
_UTM = f"""
    SELECT id, lon, lat, 500000e0+{P.SCALE * P._A!r}*(eta{_TERMS_X}) x, 10000000e0+{P.SCALE * P._A!r}*(xi{_TERMS_Y}) y FROM (
      SELECT *, atan2(t, cos({_LAM})) xi, atanh(sin({_LAM})/sqrt(1+t*t)) eta FROM (
        SELECT *, sinh(atanh(sin({_PHI}))-{_ECC}*atanh({_ECC}*sin({_PHI}))) t FROM (
          SELECT s_suppkey id, 48e0+(s_suppkey%13)*0.5e0 lon, -25e0+(s_suppkey%29)*0.45e0 lat FROM supplier) a) b) c"""


@query(f"SELECT id, round(x, 3) x, round(y, 3) y, round(lon, 6) back_lon, round(lat, 6) back_lat FROM ({_UTM}) u")
def wgs84_to_utm(spark, sf_dir):
    places = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey id", "48e0+(s_suppkey%13)*0.5e0 lon", "-25e0+(s_suppkey%29)*0.45e0 lat")
    u = places.withColumn("u", P.to_utm(F.col("lon"), F.col("lat"), 39)).withColumn("back", P.from_utm(F.col("u.x"), F.col("u.y"), 39))
    return u.select("id", F.round("u.x", 3).alias("x"), F.round("u.y", 3).alias("y"), F.round("back.x", 6).alias("back_lon"), F.round("back.y", 6).alias("back_lat"))


_CORNERS = "(SELECT s_suppkey*4+k s_suppkey, k FROM supplier CROSS JOIN (VALUES (0),(1),(2),(3)) c(k)) sq"
_PLACED = _UTM.replace("s_suppkey id, 48e0+(s_suppkey%13)*0.5e0 lon, -25e0+(s_suppkey%29)*0.45e0 lat FROM supplier", f"s_suppkey id, 48e0+((s_suppkey-k)/4%13)*0.5e0+CASE WHEN k IN (1, 2) THEN 0.001e0 ELSE 0e0 END lon, -25e0+((s_suppkey-k)/4%29)*0.45e0+CASE WHEN k > 1 THEN 0.001e0 ELSE 0e0 END lat FROM {_CORNERS}".replace("(s_suppkey-k)/4", "CAST((s_suppkey-k)/4 AS BIGINT)"))


@query(f"SELECT CAST((id-id%4)/4 AS BIGINT) ann_id, CAST(id%4 AS INT) corner, round(x, 3) x, round(y, 3) y FROM ({_PLACED}) u")
def align_truth(spark, sf_dir):
    """Truth without a system, small first coordinates: degrees, brought into the predictions' zone."""
    lon, lat = F.lit(48.0) + (F.col("s_suppkey") % 13) * 0.5, F.lit(-25.0) + (F.col("s_suppkey") % 29) * 0.45
    square = F.array(*[G.point(lon + dx, lat + dy) for dx, dy in ((0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0, 0.001))])
    truth = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("ann_id"), square.alias("points"))
    truth, _, _ = align.align_projections(truth, truth, None, 32739)
    out = truth.select("ann_id", F.posexplode("points").alias("corner", "p"))
    return out.select("ann_id", "corner", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query(f"SELECT k, x, y, round((east+west)/2, 6) lon, round((north+south)/2, 6) lat FROM ({_SLIPPY}) s")
def tile_centres(spark, sf_dir):
    centre = tiling.tile_centre(*[F.col(c) for c in ("west", "south", "east", "north")])
    return _slippy(spark, sf_dir).withColumn("c", centre).select("k", "x", "y", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


@query("""
    SELECT ann_id, CAST(cx AS BIGINT) px, CAST(cy AS BIGINT) py, CAST(cx AS BIGINT)-1000 x_off, CAST(cy AS BIGINT)-1000 y_off, CAST(2000 AS BIGINT) width, CAST(950 AS BIGINT) box_x FROM annotations""")
def chip_context(spark, sf_dir):
    """The pixel of every annotation's place and the window around it."""
    t = G.affine(0.5, 0.0, F.lit(500000.0) + F.col("source_id") * 1000.0, 0.0, -0.5, 8000000.0)
    sources = frame(spark, sf_dir, "sources").select("source_id", t.alias("transform"))
    chips = frame(spark, sf_dir, "annotations").withColumn("t", t).withColumn("g", F.element_at(G.apply_affine(F.col("t"), F.array(G.point(F.col("cx"), F.col("cy"))), 0.5), 1)).select("ann_id", "source_id", "g.x", "g.y")
    return tiling.chip_context(chips, sources, F.lit(True)).select("ann_id", "px", "py", "window.x_off", "window.y_off", "window.width", "window.box_x")
