"""Vector data: one row for each feature, (fid, geom, attributes).

geom is a struct of type (point, line or polygon) and parts; a part is a struct of hole and ring, an array of (x, y). Point
in polygon is an even-odd count of crossed edges, so holes need no care and overlapping features are taken one by one.
Edges of a mask are pruned by bounding boxes before they meet points.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnflow.functions.projections import Projection, transform
from cairnflow.operators.grid import Extent

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PART = T.StructType([T.StructField("hole", T.BooleanType()), T.StructField("ring", T.ArrayType(POINT))])
GEOM = T.StructType([T.StructField("type", T.StringType()), T.StructField("parts", T.ArrayType(PART))])


def polygon(*rings: Iterable[tuple[float, float]]) -> tuple:
    """A geom value: the first ring outside, the others holes."""
    return ("polygon", [(k > 0, [(float(x), float(y)) for x, y in ring]) for k, ring in enumerate(rings)])


def features(spark, rows: Iterable[tuple]) -> DataFrame:
    """(fid, geom) from plain values."""
    return spark.createDataFrame(list(rows), T.StructType([T.StructField("fid", T.LongType()), T.StructField("geom", GEOM)]))


def vertices(df: DataFrame) -> DataFrame:
    """(fid, part, place, hole, x, y)."""
    parts = df.select("fid", F.posexplode("geom.parts").alias("part", "p"))
    return parts.select("fid", "part", F.col("p.hole").alias("hole"), F.posexplode("p.ring").alias("place", "v")).select("fid", "part", "place", "hole", "v.x", "v.y")


def edges(df: DataFrame) -> DataFrame:
    """(fid, x1, y1, x2, y2) of all rings; an open ring is closed."""
    ring = F.col("p.ring")
    closed = F.concat(ring, F.slice(ring, 1, 1))
    pairs = F.arrays_zip(F.slice(closed, F.lit(1), F.size(ring)).alias("a"), F.slice(closed, F.lit(2), F.size(ring)).alias("b"))
    rows = df.select("fid", F.explode("geom.parts").alias("p")).select("fid", F.explode(pairs).alias("e"))
    flat = rows.select("fid", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    return flat.where("x1 <> x2 or y1 <> y2")


def boxes(df: DataFrame) -> DataFrame:
    """(fid, xmin, xmax, ymin, ymax) of each feature, without exploding it."""
    points = F.flatten(F.transform("geom.parts", lambda p: p["ring"]))
    xs, ys = F.transform(points, lambda v: v["x"]), F.transform(points, lambda v: v["y"])
    return df.select("fid", F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"), F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax"))


def extent(df: DataFrame) -> Extent | None:
    """The extent of all features: one row comes to the driver."""
    row = boxes(df).agg(F.min("xmin"), F.max("xmax"), F.min("ymin"), F.max("ymax")).first()
    return None if row[0] is None else Extent(*row)


def inside(points: DataFrame, mask: DataFrame, x: str = "x", y: str = "y", key: Iterable[str] = ("id",)) -> DataFrame:
    """(key, fid) for points in a feature of ``mask``.

    Edges go to horizontal strips of the mask's extent, and points to theirs, so the join is on the strip; only edges
    that span the point's y are counted.
    """
    key = list(key)
    bound = extent(mask)
    if bound is None:
        return points.select(*key, F.lit(None).cast("long").alias("fid")).where(F.lit(False))
    n = 256
    height = max(bound.ymax - bound.ymin, 1e-300) / n
    strip = lambda c: F.least(F.greatest(F.floor((c - bound.ymin) / height), F.lit(0)), F.lit(n - 1)).cast("int")
    e = edges(mask).where("y1 <> y2")
    spread = e.select("*", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))).alias("__s"))
    own = points.where(F.col(x).between(bound.xmin, bound.xmax) & F.col(y).between(bound.ymin, bound.ymax))
    own = own.select(*key, F.col(x).alias("__x"), F.col(y).alias("__y"), strip(F.col(y)).alias("__s"))
    spans = (F.col("y1") > F.col("__y")) != (F.col("y2") > F.col("__y"))
    at = F.col("x1") + (F.col("__y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossed = own.join(spread, "__s").where(spans & (F.col("__x") < at))
    return crossed.groupBy(*key, "fid").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select(*key, "fid")


def mask_cells(cells: DataFrame, grid, mask: DataFrame, touches: bool = False) -> DataFrame:
    """Cells outside every feature lose their value; ``touches`` keeps those that an edge passes through as well."""
    centres = cells.select("row", "col").distinct().select("row", "col", grid.x().alias("x"), grid.y().alias("y"))
    keep = inside(centres, mask, key=("row", "col")).select("row", "col").distinct()
    if touches:
        keep = keep.union(touched_cells(grid, mask)).distinct()
    joined = cells.join(keep.withColumn("__in", F.lit(True)), ["row", "col"], "left")
    return joined.withColumn("value", F.when(F.col("__in"), F.col("value"))).select(*cells.columns)


def touched_cells(grid, mask: DataFrame) -> DataFrame:
    """(row, col) of cells that an edge of the mask passes through: each edge's own cells, row by row."""
    e = edges(mask)
    top, low = F.greatest("y1", "y2"), F.least("y1", "y2")
    bounded = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))
    rows = e.where((top >= grid.extent.ymin) & (low <= grid.extent.ymax)).select("*", F.explode(F.sequence(bounded(grid.row_at(top), grid.nrow), bounded(grid.row_at(low), grid.nrow))).alias("row"))
    y_top = F.lit(grid.extent.ymax) - F.col("row") * F.lit(grid.yres)
    y_low = y_top - F.lit(grid.yres)
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) * slope)
    a, b = at(F.least(F.greatest(y_top, low), top)), at(F.greatest(F.least(y_low, top), low))
    flat = F.col("y1") == F.col("y2")
    left = F.when(flat, F.least("x1", "x2")).otherwise(F.least(a, b))
    right = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(a, b))
    span = rows.where((right >= grid.extent.xmin) & (left <= grid.extent.xmax))
    return span.select("row", F.explode(F.sequence(bounded(grid.col_at(left), grid.ncol), bounded(grid.col_at(right), grid.ncol))).alias("col")).distinct()


def crop(df: DataFrame, to: Extent) -> DataFrame:
    """Features whose box meets the extent."""
    b = boxes(df).where((F.col("xmax") >= to.xmin) & (F.col("xmin") <= to.xmax) & (F.col("ymax") >= to.ymin) & (F.col("ymin") <= to.ymax))
    return df.join(b.select("fid"), "fid", "left_semi")


def project(df: DataFrame, source: Projection, target: Projection) -> DataFrame:
    """Every vertex to another projection, inside the geometry."""
    if source == target:
        return df

    def moved(v):
        x, y = transform(v["x"], v["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    parts = F.transform("geom.parts", lambda p: F.struct(p["hole"].alias("hole"), F.transform(p["ring"], moved).alias("ring")))
    return df.withColumn("geom", F.struct(F.col("geom.type").alias("type"), parts.alias("parts")))


def keep_types(df: DataFrame, like: DataFrame) -> DataFrame:
    """Features of the geometry types that ``like`` has."""
    return df.join(F.broadcast(like.select(F.col("geom.type").alias("__t")).distinct()), F.col("geom.type") == F.col("__t"), "left_semi")


def contained(df: DataFrame, within: DataFrame) -> DataFrame:
    """(fid, within_fid): features all of whose vertices lie in one feature of ``within`` and none of whose edges crosses
    one of its edges."""
    v = vertices(df).select("fid", "part", "place", "x", "y")
    n = v.groupBy("fid").agg(F.count("*").alias("n"))
    hit = inside(v.withColumnRenamed("fid", "of"), within, key=("of", "part", "place")).groupBy("of", "fid").agg(F.count("*").alias("k"))
    full = hit.join(n.withColumnRenamed("fid", "of"), "of").where("k = n").select("of", F.col("fid").alias("within_fid"))
    a = edges(df).toDF("of", "ax", "ay", "bx", "by")
    b = edges(within).toDF("within_fid", "cx", "cy", "dx", "dy")
    side = lambda px, py, qx, qy, rx, ry: (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px))
    cross = (side("ax", "ay", "bx", "by", "cx", "cy") * side("ax", "ay", "bx", "by", "dx", "dy") < 0) & (side("cx", "cy", "dx", "dy", "ax", "ay") * side("cx", "cy", "dx", "dy", "bx", "by") < 0)
    crossing = full.join(a, "of").join(b, "within_fid").where(cross).select("of", "within_fid").distinct()
    return full.join(crossing, ["of", "within_fid"], "left_anti").select(F.col("of").alias("fid"), "within_fid")


# Geometry that columns can't express, a feature at a time


def clip_ring(ring: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """The part of a ring in a convex ring, by cutting at each of its edges in turn (Sutherland and Hodgman)."""
    area = np.sum(convex[:, 0] * np.roll(convex[:, 1], -1) - np.roll(convex[:, 0], -1) * convex[:, 1])
    edge_list = convex if area > 0 else convex[::-1]
    out = ring
    for a, b in zip(edge_list, np.roll(edge_list, -1, axis=0)):
        if not len(out):
            break
        d = b - a
        s = d[0] * (out[:, 1] - a[1]) - d[1] * (out[:, 0] - a[0])
        made = []
        for p, q, sp, sq in zip(out, np.roll(out, -1, axis=0), s, np.roll(s, -1)):
            if sp >= 0:
                made.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                made.append(p + (q - p) * sp / (sp - sq))
        out = np.array(made).reshape(-1, 2)
    return out


def clip(df: DataFrame, mask: list[tuple[float, float]]) -> DataFrame:
    """Polygons cut by one convex mask ring; features outside go. Concave masks: split them into convex ones first."""
    ring = np.array(mask, dtype=float)
    d = np.roll(ring, -1, axis=0) - ring
    turn = d[:, 0] * np.roll(d[:, 1], -1) - d[:, 1] * np.roll(d[:, 0], -1)
    if (turn > 1e-12).any() and (turn < -1e-12).any():
        raise ValueError("the mask is not convex")
    schema = df.schema

    def run(batches):
        for pdf in batches:
            geoms = []
            for g in pdf["geom"]:
                parts = []
                for p in g["parts"]:
                    cut = clip_ring(np.array([[v["x"], v["y"]] for v in p["ring"]], dtype=float).reshape(-1, 2), ring)
                    if len(cut) > 2:
                        parts.append({"hole": p["hole"], "ring": [{"x": x, "y": y} for x, y in cut.tolist()]})
                geoms.append({"type": g["type"], "parts": parts} if parts else None)
            pdf = pdf.assign(geom=geoms)
            yield pdf[pdf["geom"].notna()]

    return df.mapInPandas(run, schema)


def slabs(rings: list[np.ndarray]) -> list[np.ndarray]:
    """The inside of rings (even-odd, so holes and concave rings need no care) as convex pieces.

    Between two neighbouring heights at which a vertex lies or two edges cross, edges don't meet, so the inside there
    is a row of trapezoids.
    """
    segments = np.array([[*p, *q] for r in rings for p, q in zip(r, np.roll(r, -1, axis=0)) if p[1] != q[1]]).reshape(-1, 4)
    if not len(segments):
        return []
    x1, y1, x2, y2 = segments.T
    heights = set(y1.tolist()) | set(y2.tolist())
    for k in range(len(segments)):
        dx, dy, ex, ey = x2[k] - x1[k], y2[k] - y1[k], x2[k + 1 :] - x1[k + 1 :], y2[k + 1 :] - y1[k + 1 :]
        den = dx * ey - dy * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((x1[k + 1 :] - x1[k]) * ey - (y1[k + 1 :] - y1[k]) * ex) / den
            u = ((x1[k + 1 :] - x1[k]) * dy - (y1[k + 1 :] - y1[k]) * dx) / den
        heights |= set((y1[k] + t[(den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)] * dy).tolist())
    made = []
    levels = sorted(heights)
    for low, high in zip(levels, levels[1:]):
        on = (np.minimum(y1, y2) <= low) & (np.maximum(y1, y2) >= high)
        at = lambda y: x1[on] + (y - y1[on]) * (x2[on] - x1[on]) / (y2[on] - y1[on])
        bottom, top = at(low), at(high)
        order = np.argsort(bottom + top, kind="stable")
        for a, b in zip(order[::2], order[1::2]):
            piece = [(bottom[a], low), (bottom[b], low), (top[b], high), (top[a], high)]
            made.append(np.array([p for p, q in zip(piece, piece[-1:] + piece[:-1]) if p != q]))
    return [p for p in made if len(p) > 2]


_TILES = 64  #: tiles on each side of the mask's extent


def intersect(df: DataFrame, mask: DataFrame) -> DataFrame:
    """``df`` cut by the features of ``mask``: a row for each two that have an area in common, as pieces.

    Masks may be concave, have holes and several parts. Their convex pieces and the features meet by tiles of the
    mask's extent, by boxes within these, and each pair is cut by itself; nothing is collected but the extent. Lines
    and points aren't cut; empty geometries meet nothing.
    """
    bound = extent(mask)
    if bound is None:
        return df.where(F.lit(False))

    def decompose(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for fid, g in zip(pdf["fid"], pdf["geom"]):
                rings = [np.array([[v["x"], v["y"]] for v in p["ring"]], dtype=float).reshape(-1, 2) for p in g["parts"]] if g is not None else []
                rows += [(fid, k, p.tolist(), *p.min(axis=0), *p.max(axis=0)) for k, p in enumerate(slabs([r for r in rings if len(r) > 2]))]
            yield pd.DataFrame(rows, columns=["mask_fid", "piece", "convex", "x0", "y0", "x1", "y1"])

    pieces = mask.select("fid", "geom").mapInPandas(decompose, "mask_fid long, piece int, convex array<array<double>>, x0 double, y0 double, x1 double, y1 double")
    width, height = (max(b - a, 1e-300) / _TILES for a, b in ((bound.xmin, bound.xmax), (bound.ymin, bound.ymax)))
    tile = lambda c, low, size: F.least(F.greatest(F.floor((c - F.lit(low)) / F.lit(size)), F.lit(0)), F.lit(_TILES - 1)).cast("int")

    def tiles(rows: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
        across = rows.select("*", F.explode(F.sequence(tile(F.col(x0), bound.xmin, width), tile(F.col(x1), bound.xmin, width))).alias("tx"))
        return across.select("*", F.explode(F.sequence(tile(F.col(y0), bound.ymin, height), tile(F.col(y1), bound.ymin, height))).alias("ty"))

    near = boxes(df).where((F.col("xmax") >= bound.xmin) & (F.col("xmin") <= bound.xmax) & (F.col("ymax") >= bound.ymin) & (F.col("ymin") <= bound.ymax))
    met = tiles(near, "xmin", "ymin", "xmax", "ymax").join(tiles(pieces, "x0", "y0", "x1", "y1"), ["tx", "ty"])
    met = met.where("xmin < x1 and xmax > x0 and ymin < y1 and ymax > y0")
    # a pair meets in several tiles; it counts in the first one of those that both cover
    first = (F.col("tx") == F.greatest(tile(F.col("xmin"), bound.xmin, width), tile(F.col("x0"), bound.xmin, width))) & (F.col("ty") == F.greatest(tile(F.col("ymin"), bound.ymin, height), tile(F.col("y0"), bound.ymin, height)))
    pairs = met.where(first).select("fid", "mask_fid", "piece", "convex")

    def cut(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for fid, mask_fid, convex, g in zip(pdf["fid"], pdf["mask_fid"], pdf["convex"], pdf["geom"]):
                by = np.array([list(p) for p in convex])
                for p in g["parts"]:
                    ring = clip_ring(np.array([[v["x"], v["y"]] for v in p["ring"]], dtype=float).reshape(-1, 2), by)
                    if len(ring) > 2:
                        rows.append((fid, mask_fid, {"hole": p["hole"], "ring": [{"x": x, "y": y} for x, y in ring.tolist()]}))
            yield pd.DataFrame(rows, columns=["fid", "mask_fid", "part"])

    polygons = df.where("geom.type = 'polygon'").select("fid", "geom")
    parts = pairs.join(polygons, "fid").select("fid", "mask_fid", "convex", "geom").mapInPandas(cut, T.StructType([T.StructField("fid", T.LongType()), T.StructField("mask_fid", T.LongType()), T.StructField("part", PART)]))
    whole = parts.groupBy("fid", "mask_fid").agg(F.struct(F.lit("polygon").alias("type"), F.collect_list("part").alias("parts")).alias("geom"))
    whole = whole.where(area(F.col("geom")) > 0)
    return df.drop("geom").join(whole.drop("mask_fid"), "fid").select(*df.columns)


def area(geom: Column) -> Column:
    """The area of a polygon: its rings' less its holes'."""

    def ring_area(ring: Column) -> Column:
        after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        return F.abs(F.aggregate(F.zip_with(ring, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, x: s + x)) / 2

    return F.aggregate(geom["parts"], F.lit(0.0), lambda s, p: s + F.when(p["hole"], -ring_area(p["ring"])).otherwise(ring_area(p["ring"])))


def ring_crossings(ring: np.ndarray) -> list[tuple[int, int, float, float]]:
    """Pairs of edges of a closed ring that cross, with the place."""
    n, found = len(ring), []
    nxt = np.roll(ring, -1, axis=0)
    for i in range(n):
        p, r = ring[i], nxt[i] - ring[i]
        for j in range(i + 2, n - (i == 0)):
            q, s = ring[j], nxt[j] - ring[j]
            den = r[0] * s[1] - r[1] * s[0]
            if den:
                t = ((q[0] - p[0]) * s[1] - (q[1] - p[1]) * s[0]) / den
                u = ((q[0] - p[0]) * r[1] - (q[1] - p[1]) * r[0]) / den
                if 0 < t < 1 and 0 < u < 1:
                    found.append((i, j, float(p[0] + t * r[0]), float(p[1] + t * r[1])))
    return found


def simple_rings(ring: np.ndarray) -> list[np.ndarray]:
    """A ring that crosses itself, split at its crossings into rings that don't."""
    crossings = ring_crossings(ring)
    if not crossings:
        return [ring]
    i, j, x, y = crossings[0]
    at = np.array([[x, y]])
    inner = np.concatenate([at, ring[i + 1 : j + 1]])
    outer = np.concatenate([ring[: i + 1], at, ring[j + 1 :]])
    return [r for part in (inner, outer) if len(part) > 2 for r in simple_rings(part)]


def _rings(df: DataFrame, schema, make):
    def run(batches):
        for pdf in batches:
            yield make(pdf)

    return df.mapInPandas(run, schema)


def validity(df: DataFrame) -> DataFrame:
    """(fid, valid): no ring crosses itself, and each has three vertices at least."""
    import pandas as pd

    def ok(g) -> bool:
        if g["type"] != "polygon":
            return True
        rings = [np.array([[v["x"], v["y"]] for v in p["ring"]], dtype=float).reshape(-1, 2) for p in g["parts"]]
        rings = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]
        return all(len(r) > 2 and not ring_crossings(r) for r in rings)

    return _rings(df.select("fid", "geom"), "fid long, valid boolean", lambda pdf: pd.DataFrame({"fid": pdf["fid"], "valid": [ok(g) for g in pdf["geom"]]}))


def repaired(df: DataFrame) -> DataFrame:
    """Features with crossing rings split; valid ones as they are."""

    def fix(g):
        if g["type"] != "polygon":
            return g
        parts = []
        for p in g["parts"]:
            r = np.array([[v["x"], v["y"]] for v in p["ring"]], dtype=float).reshape(-1, 2)
            r = r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r
            parts += [{"hole": p["hole"], "ring": [{"x": x, "y": y} for x, y in s.tolist()]} for s in simple_rings(r)]
        return {"type": "polygon", "parts": parts}

    return _rings(df, df.schema, lambda pdf: pdf.assign(geom=[fix(g) for g in pdf["geom"]]))


def geometry_hash(df: DataFrame) -> str:
    """A name for an area: of the vertices only, whatever the attributes; coordinates rounded to four digits."""
    from cairnflow.functions.digest import frame_hash

    rounded = vertices(df).select("part", "place", "hole", F.bround("x", 4).alias("x"), F.bround("y", 4).alias("y"))
    return frame_hash(rounded)[:16]
