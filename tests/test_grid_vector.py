import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.functions import projections as pr
from cairnflow.operators import grid as g
from cairnflow.operators import vector as v
from cairnflow.operators.conform import SKIP, Features, Raster, conform, with_old_names

NAN, INF = float("nan"), float("inf")


def cells(spark, values, ncol=None):
    n = ncol or len(values)
    return spark.createDataFrame([(0, k // n, k % n, x) for k, x in enumerate(values)], "layer int, row int, col int, value double")


@pytest.mark.parametrize(
    "values, expected",
    [
        ([0.0, 1.0, None, NAN], "LOG1S"),
        ([-1.0, 98.0, None], "INT1S"),
        ([1.0, 100.0, None], "INT1U"),
        ([64000.0, 65000.0], "INT2U"),
        ([-32767.0, 32767.0, None], "INT2S"),
        ([0.0, 5e8, None], "INT4U"),
        ([-2e8, 2e8, None], "INT4S"),
        ([-10.5, 87.2], "FLT4S"),
        ([3.4e26, -3.4e28], "FLT4S"),
        ([1.7e308], "FLT8S"),
        ([INF, 1.0], "FLT8S"),
        ([1.0, 4.0, 2.0], "INT1U"),
        ([None, None], "LOG1S"),
    ],
)
def test_datatypes(spark, values, expected):
    assert g.datatypes(cells(spark, values)).first().datatype == expected


def test_crop_and_empty(spark):
    c, grid = cells(spark, [float(k) for k in range(16)], 4), g.Grid(4, 4, g.Extent(0, 4, 0, 4))
    part, new = g.crop(c, grid, g.Extent(1, 3, 1, 3))
    assert (new.nrow, new.ncol, new.extent) == (2, 2, g.Extent(1, 3, 1, 3))
    assert [r.value for r in g.values(part).collect()] == [5.0, 6.0, 9.0, 10.0]
    none, empty = g.crop(c, grid, g.Extent(10, 11, 10, 11))
    assert none.count() == 0 and empty.nrow == 0
    assert g.crop(c, grid, g.Extent(1, 3, 1, 3), 1)[1].ncol == 4


def test_masks_and_holes(spark):
    c, grid = cells(spark, [1.0] * 36, 6), g.Grid(6, 6, g.Extent(0, 6, 0, 6))
    ring = v.polygon([(1, 1), (5, 1), (5, 5), (1, 5)], [(2, 2), (4, 2), (4, 4), (2, 4)])
    kept = v.mask_cells(c, grid, v.features(spark, [(0, ring)]))
    assert kept.count() == 36 and kept.where("value is not null").count() == 12
    two = v.features(spark, [(0, v.polygon([(0, 0), (3, 0), (3, 3), (0, 3)])), (1, v.polygon([(2, 2), (5, 2), (5, 5), (2, 5)]))])
    assert v.mask_cells(c, grid, two).where("value is not null").count() == 17
    small = v.features(spark, [(0, v.polygon([(1.1, 1.1), (1.3, 1.1), (1.3, 1.3), (1.1, 1.3)]))])
    assert v.mask_cells(c, grid, small).where("value is not null").count() == 0
    assert v.mask_cells(c, grid, small, touches=True).where("value is not null").count() == 1
    by = g.mask(c, cells(spark, [None, 1.0] * 18, 6))
    assert by.where("value is not null").count() == 18


def test_resampling(spark):
    c, grid = cells(spark, [float(r * 4 + k) for r in range(4) for k in range(4)], 4), g.Grid(4, 4, g.Extent(0, 4, 0, 4))
    target = g.Grid(2, 2, g.Extent(0, 4, 0, 4))
    assert [r.value for r in g.values(g.resample_bilinear(c, grid, target)).collect()] == [2.5, 4.5, 10.5, 12.5]
    assert [r.value for r in g.values(g.resample_nearest(c, grid, target)).collect()] == [5.0, 7.0, 13.0, 15.0]
    outside = g.Grid(1, 2, g.Extent(-4, 4, 0, 4))
    assert [r.value for r in g.values(g.resample_nearest(c, grid, outside)).collect()] == [None, 10.0]


@pytest.mark.parametrize(
    "p, lon, lat, x, y",
    [
        (pr.LambertConic(33, 45, 23, -96), -75, 35, 1894410.9, 1564649.5),
        (pr.Albers(29.5, 45.5, 23, -96), -75, 35, 1885472.7, 1535925.0),
        (pr.TransverseMercator(-75), -73.5, 40.5, 500000 + 127106.5, 4484124.4),
        (pr.WebMercator(), 180, 0, math.pi * 6378137, 0),
    ],
)
def test_projections(spark, p, lon, lat, x, y):
    """The first three are worked examples of the manual, on an ellipsoid that differs by some hundred metres."""
    fx, fy = p.forward("lon", "lat")
    bx, by = p.inverse("x", "y")
    row = spark.createDataFrame([(float(lon), float(lat))], "lon double, lat double").select(fx.alias("x"), fy.alias("y")).select("x", "y", bx.alias("lon"), by.alias("lat")).first()
    assert abs(row.x - x) < 500 and abs(row.y - y) < 500
    assert abs(row.lon - lon) < 1e-6 and abs(row.lat - lat) < 1e-6


def test_containment(spark):
    big = v.features(spark, [(7, v.polygon([(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)]))])
    small = v.features(spark, [(1, v.polygon([(1, 1), (2, 1), (2, 2)])), (2, v.polygon([(1, 8), (9, 8), (9, 9)])), (3, v.polygon([(11, 1), (12, 1), (12, 2)]))])
    assert [(r.fid, r.within_fid) for r in v.contained(small, big).collect()] == [(1, 7)]


def test_clip_and_repair(spark):
    f = v.features(spark, [(1, v.polygon([(0, 0), (4, 0), (4, 4), (0, 4)])), (2, v.polygon([(20, 20), (21, 20), (21, 21)]))])
    cut = v.clip(f, [(2, 2), (6, 2), (6, 6), (2, 6)])
    box = v.boxes(cut).collect()
    assert [(r.fid, r.xmin, r.xmax, r.ymin, r.ymax) for r in box] == [(1, 2.0, 4.0, 2.0, 4.0)]
    with pytest.raises(ValueError):
        v.clip(f, [(0, 0), (4, 0), (1, 1), (0, 4)])
    bow = v.features(spark, [(1, v.polygon([(0, 0), (2, 2), (2, 0), (0, 2)]))])
    assert [r.valid for r in v.validity(bow).collect()] == [False]
    assert [r.valid for r in v.validity(v.repaired(bow)).collect()] == [True]
    assert len(v.simple_rings(np.array([[0, 0], [2, 2], [2, 0], [0, 2]], float))) == 2


def test_conform_order_and_skips(spark):
    c = Raster(cells(spark, [float(k) for k in range(100)], 10), g.Grid(10, 10, g.Extent(0, 10, 0, 10), datatype="INT1U"))
    area = Features(v.features(spark, [(0, v.polygon([(2, 2), (8, 2), (5, 8)]))]), pr.LonLat())
    full = conform(c, area)
    assert full.grid.extent == g.Extent(2, 8, 2, 8) and 0 < full.cells.where("value is not null").count() < 36
    assert conform(c, area, mask=SKIP).cells.where("value is not null").count() == 36
    assert conform(c, area, crop=SKIP).grid.extent == c.grid.extent
    other = Raster(cells(spark, [1.0] * 9, 3), g.Grid(3, 3, g.Extent(1, 7, 1, 7)))
    assert conform(c, other).grid.same_cells(other.grid)
    moved = conform(area, project=pr.WebMercator(), crop=SKIP, mask=SKIP)
    assert abs(v.extent(moved.rows).xmax - math.radians(8) * 6378137) < 1e-6
    assert with_old_names(study_area=1, target_crs=2) == {"crop": 1, "mask": 1, "project": 2}
    with pytest.raises(ValueError):
        with_old_names(filename2="x")


def test_domains(spark, tmp_path):
    from cairnflow.plans.domain import for_domain

    made = []

    def square(x, fid):
        return (fid, v.polygon([(x, 0), (x + 10, 0), (x + 10, 10), (x, 10)]))

    def make(domain):
        made.append(1)
        return domain.select("fid", "geom").withColumn("value", domain.fid * 2)

    path = str(tmp_path / "domains")
    a, b = v.features(spark, [square(0, 1)]), v.features(spark, [square(50, 2)])
    inner = v.features(spark, [(1, v.polygon([(1, 1), (2, 1), (2, 2)]))])
    assert for_domain(spark, path, a, make)[1] and for_domain(spark, path, b, make)[1]
    rows, new = for_domain(spark, path, inner, make)
    assert not new and rows.count() == 1 and len(made) == 2


def ring_of(n, r=5.0, cx=0.0, cy=0.0, dent=0.0):
    return [(cx + (r - dent * (k % 2)) * math.cos(2 * math.pi * k / n), cy + (r - dent * (k % 2)) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def test_features_cut_by_any_mask(spark):
    """Stars, holes, several parts and features, against sampled points."""
    import random

    import numpy as np

    def odd(x, y, rings):
        n = 0
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                n += (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        return n % 2 == 1

    rng = random.Random(3)
    subjects = {k: [ring_of(rng.randrange(3, 9), 3, rng.uniform(-5, 5), rng.uniform(-5, 5))] for k in range(12)}
    masks = {0: [ring_of(14, 6, -1, 0, 3.5), ring_of(6, 1.5, -1, 0)], 1: [ring_of(10, 4, 9, 9, 2)], 2: [[(-9, -9), (-5, -9), (-9, -5), (-5, -5)]]}
    df = v.features(spark, [(k, v.polygon(*r)) for k, r in subjects.items()])
    cut = v.intersect(df, v.features(spark, [(k, v.polygon(*r)) for k, r in masks.items()]))
    assert cut.columns == df.columns
    got = {}
    for r in cut.select("fid", v.area(F.col("geom")).alias("a")).collect():
        got[r.fid] = got.get(r.fid, 0) + r.a
    points = [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(40_000)]
    for k, rings in subjects.items():
        share = np.mean([odd(x, y, rings) and sum(odd(x, y, m) for m in masks.values()) for x, y in points])
        assert abs(share * 18 * 18 - got.get(k, 0.0)) < 0.7
    assert v.intersect(df.limit(0), df).count() == 0 and v.intersect(df, df.limit(0)).count() == 0
    many = v.features(spark, [(0, v.polygon(ring_of(3000)))])
    whole = v.intersect(v.features(spark, [(7, v.polygon([(-9, -9), (9, -9), (9, 9), (-9, 9)]))]), many).select(v.area(F.col("geom"))).first()[0]
    assert abs(whole - 25 * math.pi) < 0.01


def test_old_names_of_targets():
    full = with_old_names(study_area="sa", raster_to_match="rtm")
    assert full == {"crop": "rtm", "project": "rtm", "to": "rtm", "mask": "sa"}
    assert with_old_names(study_area="sa", raster_to_match="rtm", use_sa_crs=True, mask_with_rtm=True) == {"crop": "rtm", "project": "sa", "to": "rtm", "mask": "rtm"}
    assert with_old_names(study_area="sa", use_sa_crs=False) == {"crop": "sa", "mask": "sa", "project": SKIP}
    assert with_old_names(study_area="sa", crop="new", method="near") == {"crop": "new", "mask": "sa", "method": "near"}


def test_conform_takes_older_names(spark):
    from cairnflow.functions.projections import LonLat

    data = Raster(cells(spark, [float(k) for k in range(16)], 4), g.Grid(4, 4, g.Extent(0, 4, 0, 4), LonLat()))
    area = Features(v.features(spark, [(0, v.polygon([(0, 0), (2, 0), (2, 2), (0, 2)]))]), LonLat())
    values = lambda made: sorted(r.value for r in made.cells.where("value is not null").collect())
    assert values(conform(data, study_area=area)) == values(conform(data, crop=area, mask=area)) == [8.0, 9.0, 12.0, 13.0]
    with pytest.raises(TypeError, match="studyarea"):
        conform(data, studyarea=area)
    with pytest.raises(ValueError):
        conform(data, filename2="x")
