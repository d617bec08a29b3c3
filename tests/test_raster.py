"""Hand-computed values for raster blocks."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from cellframe.operators import combine, elemwise, misc, spatial, temporal
from cellframe.plans.block import Block, DummyBlock, construct
from cellframe.plans.meta import Extent, Grid, frames_between, nearest, parse_percentile
from cellframe.sources.raster import MemorySource

HOUR, DAY = timedelta(hours=1), timedelta(days=1)
T0 = datetime(2000, 1, 1)


def raster(values, first=T0, delta=HOUR, none=255, dtype="uint8", **kw):
    data = np.array(values, dtype=dtype)
    if data.ndim == 2:
        data = data[None]
    return MemorySource(data, none, "EPSG:3857", 1, (0, data.shape[1]), first, delta if len(data) > 1 else None, **kw)


def values(spark, block, **request):
    """{frame: rows of values}"""
    out = {}
    for r in block.get_data(spark, **request).collect():
        out.setdefault(r["t"], {})[r["i"], r["j"]] = r["v"]
    return {t: [[c[i, j] for j in range(1 + max(j for _, j in c))] for i in range(1 + max(i for i, _ in c))] for t, c in sorted(out.items())}


def only(spark, block, **request):
    found = values(spark, block, **request)
    assert len(found) == 1
    return next(iter(found.values()))


@pytest.fixture(scope="module")
def source():
    return raster([np.full((10, 10), k) for k in (1, 7, 255)], metadata=["a", "b", "c"])


@pytest.fixture(scope="module")
def row():
    """Three days of [1, 0, no data]."""
    return raster([[[1, 0, np.nan]]] * 3, delta=DAY, none=None, dtype="float64")


def frames(spark, block, start=None, stop=None):
    return [r["t"] for r in block.get_data(spark, mode="time", start=start, stop=stop).collect()]


def test_attributes(source):
    for name in source.ATTRIBUTES:
        assert getattr(source, name) is not None
    assert source.period == (T0, T0 + 2 * HOUR) and source.timedelta == HOUR and len(source) == 3
    assert source.dtype == "uint8" and source.fillvalue == 255


def test_frames_between():
    times = [T0, T0 + HOUR, T0 + 2 * HOUR, T0 + 3 * HOUR]
    assert frames_between(times, None, None) == times[-1:]
    assert frames_between(times, T0 + 0.5 * HOUR, None) == [times[0]]
    assert frames_between(times, T0 + 1.5 * HOUR, None) == [times[2]]
    assert frames_between(times, T0 - DAY, None) == [times[0]] and frames_between(times, T0 + DAY, None) == [times[3]]
    assert frames_between(times, T0 + HOUR, T0 + 2 * HOUR) == times[1:3]
    assert frames_between(times, T0 + DAY, T0 + 2 * DAY) == []
    assert nearest(times, T0 + 0.5 * HOUR) == T0 and nearest(times, T0 + 0.5 * HOUR, "forward") == times[1]


def test_window_and_point(spark, source):
    got = values(spark, source, bbox=(-1, 8, 1, 11), width=2, height=3, start=T0)
    assert got == {T0: [[None, None], [None, 1], [None, 1]]}
    assert only(spark, source, bbox=(5, 5, 5, 5), start=T0 + HOUR) == [[7]]
    assert values(spark, source, start=T0 + DAY, stop=T0 + 2 * DAY) == {}
    assert only(spark, source, bbox=(0, 0, 10, 10), width=2, height=2, start=T0) == [[1, 1], [1, 1]]


def test_reprojected_window(spark):
    a = MemorySource(np.arange(4, dtype="uint8").reshape(2, 2), 255, "EPSG:28992", 100, (155000, 463200))
    lonlat = Extent((155000, 463000, 155200, 463200), "EPSG:28992").transformed("EPSG:4326").bbox
    assert only(spark, a, bbox=lonlat, width=2, height=2, projection="EPSG:4326") == [[0, 1], [2, 3]]


def test_meta(spark, source):
    assert [r["meta"] for r in source.get_data(spark, mode="meta", start=T0, stop=T0 + DAY).collect()] == ["a", "b", "c"]


def test_math(spark):
    a, b = raster([[1, 2, 255]]), raster([[4, 0, 1]])
    assert only(spark, a + b) == [[5, 2, None]]
    assert only(spark, a - b) == [[-3, 2, None]]
    assert only(spark, a * 2) == [[2, 4, None]] and only(spark, -a) == [[-1, -2, None]]
    assert only(spark, a / b) == [[0.25, None, None]]
    assert only(spark, a**2) == [[1, 4, None]] and only(spark, a**-1) == [[1.0, 0.5, None]]
    assert only(spark, a + np.int16(2)) == [[3, 4, None]] and only(spark, a * np.array([2])) == [[2, 4, None]]
    assert (a + b).dtype == "int32" and (a / b).dtype == "float64"
    with pytest.raises(TypeError):
        a + "x"


def test_comparisons_and_logic(spark):
    a = raster([[1, 2, 255]])
    assert only(spark, a == 1) == [[True, False, False]] and only(spark, a != 1) == [[False, True, True]]
    assert only(spark, a > 1) == [[False, True, False]] and only(spark, a >= 1) == [[True, True, False]]
    assert only(spark, a < 2) == [[True, False, False]] and only(spark, a <= 2) == [[True, True, False]]
    x, y = a > 1, a >= 1
    assert only(spark, x & y) == [[False, True, False]] and only(spark, x | y) == [[True, True, False]]
    assert only(spark, x ^ y) == [[True, False, False]] and only(spark, ~x) == [[True, False, True]]
    assert only(spark, elemwise.IsData(a)) == [[True, True, False]] and only(spark, elemwise.IsNoData(a)) == [[False, False, True]]
    with pytest.raises(TypeError):
        a & x
    with pytest.raises(TypeError):
        ~a
    with pytest.raises(TypeError):
        elemwise.IsData(x)


def test_fill_exp_log(spark):
    a, b = raster([[1, 255, 255]]), raster([[2, 3, 255]])
    assert only(spark, elemwise.FillNoData(a, b)) == [[2, 3, None]] and only(spark, elemwise.FillNoData(b, a)) == [[1, 3, None]]
    assert only(spark, elemwise.Exp(raster([[0, 255]]))) == [[1.0, None]]
    assert only(spark, elemwise.Log(raster([[1, 0, 255]]))) == [[0.0, None, None]]
    assert only(spark, elemwise.Log10(raster([[100, 0]]))) == [[2.0, None]]


def test_time_steps_must_agree(source):
    other = raster([[[1]]] * 2, delta=DAY)
    with pytest.raises(ValueError):
        source + other


def test_misc(spark):
    a = raster([[0, 2, 5, 255]])
    assert only(spark, misc.Clip(a, raster([[1, 255, 1, 1]]))) == [[0, None, 5, None]]
    assert only(spark, misc.Clip(a, a > 1)) == [[None, 2, 5, None]]
    assert only(spark, misc.Mask(a, 3)) == [[3, 3, 3, None]] and misc.Mask(a, 0).fillvalue == 1
    assert only(spark, misc.MaskBelow(a, 2)) == [[None, 2, 5, None]]
    assert only(spark, misc.Step(a, value=2)) == [[0, 0, 1, None]]
    assert only(spark, misc.Step(a, 10, 20, 2, 15)) == [[10, 15, 20, None]]
    assert only(spark, misc.Classify(a, [2, 4])) == [[0, 1, 2, None]] and only(spark, misc.Classify(a, [2, 4], right=True)) == [[0, 0, 2, None]]
    assert only(spark, misc.Reclassify(a, [[2, 100]])) == [[0, 100, 5, None]] and only(spark, misc.Reclassify(a, [[2, 100]], True)) == [[None, 100, None, None]]
    assert only(spark, misc.Reclassify(a, [[255, 9]])) == [[0, 2, 5, 9]]
    with pytest.raises(ValueError):
        misc.Classify(a, [2, 2])
    with pytest.raises(ValueError):
        misc.Reclassify(a, [[1, 2], [1, 3]])


STACK = [([[1, 1, 1], [0, 5, 0]], 0, "uint8"), ([[2, 2, 2], [4, 5, 2**64 - 1]], 2**64 - 1, "uint64"), ([[3, 3, 3], [4, 42, 42]], 42, "float32")]


@pytest.mark.parametrize(
    "statistic,expected",
    [
        ("first", [1, 1, 1, 4, 5, None]), ("last", [3, 3, 3, 4, 5, None]), ("count", [3, 3, 3, 2, 2, 0]), ("sum", [6, 6, 6, 8, 10, 0]), ("mean", [2, 2, 2, 4, 5, None]), ("min", [1, 1, 1, 4, 5, None]), ("max", [3, 3, 3, 4, 5, None]),
        ("argmin", [0, 0, 0, 1, 0, None]), ("argmax", [2, 2, 2, 1, 0, None]), ("median", [2, 2, 2, 4, 5, None]), ("product", [6, 6, 6, 16, 25, None]), ("p99", [2.98, 2.98, 2.98, 4, 5, None]), ("var", [2 / 3] * 3 + [0, 0, None]), ("std", [(2 / 3) ** 0.5] * 3 + [0, 0, None]),
    ],
)
def test_reduce(spark, statistic, expected):
    blocks = [raster(np.array(v, dtype=d), none=n, dtype=d) for v, n, d in STACK]
    got = [x for r in only(spark, combine.reduce_rasters(blocks, statistic)) for x in r]
    assert [None if x is None else float(x) for x in got] == pytest.approx(expected, abs=1e-6, nan_ok=True) if None not in expected else all((a is None) == (b is None) and (a is None or abs(float(a) - b) < 1e-6) for a, b in zip(got, expected))


@pytest.mark.parametrize("dtype,big", [("int64", 4 * 10**6), ("int32", 2 * 10**4), ("uint8", 250)])
def test_product_outgrows_integers(spark, dtype, big):
    a = raster([[big, 3]], none=0, dtype=dtype)
    # three values for rasters side by side, four for stamps at one place
    found = combine.Reduce("product", a, a, a)
    assert found.dtype == "float64" and only(spark, found) == [[float(big**3), 27.0]]
    stamped = spatial.Place(a, "EPSG:3857", (0, 0), [(0, 0)] * 4, "product")
    assert stamped.dtype == "float64" and only(spark, stamped, bbox=(0, 0, 2, 1), width=2, height=1, projection="EPSG:3857") == [[float(big**4), 81.0]]


def test_percentile_names():
    assert parse_percentile("p75") == 75 and parse_percentile("sum") is None
    with pytest.raises(ValueError):
        parse_percentile("p101")
    with pytest.raises(ValueError):
        combine.Reduce("nothing", raster([[1]]))


def test_group(spark):
    a = raster([[[1, 1]], [[2, 255]]])
    b = raster([[[255, 5]], [[6, 255]]], first=T0 + 3 * HOUR)
    got = values(spark, combine.Group(a, b), start=T0, stop=T0 + DAY)
    assert got == {T0: [[1, 1]], T0 + HOUR: [[2, None]], T0 + 2 * HOUR: [[None, None]], T0 + 3 * HOUR: [[None, 5]], T0 + 4 * HOUR: [[6, None]]}
    c = raster([[[9, 255]], [[255, 9]]])
    assert values(spark, combine.Group(a, c), start=T0, stop=T0 + DAY) == {T0: [[9, 1]], T0 + HOUR: [[2, 9]]}
    mixed = combine.Group(a, raster([[[3, 3]]] * 2, first=T0 + timedelta(minutes=30), delta=timedelta(minutes=7)))
    assert len(frames(spark, mixed, T0, T0 + DAY)) == 4 and mixed.timedelta is None
    assert only(spark, combine.Max(a, c), start=T0) == [[9, 1]]


def test_snap_shift_sum(spark, source):
    index = raster([[[0]]] * 3, first=T0 + timedelta(minutes=30), delta=HOUR)
    got = values(spark, temporal.Snap(source, index), bbox=(0, 0, 1, 1), width=1, height=1, start=T0, stop=T0 + DAY)
    assert [v[0][0] for v in got.values()] == [1, 7, None] and min(got) == T0 + timedelta(minutes=30)
    got = values(spark, temporal.Shift(source, HOUR), bbox=(0, 0, 1, 1), width=1, height=1, start=T0, stop=T0 + DAY)
    assert {t: v[0][0] for t, v in got.items()} == {T0 + HOUR: 1, T0 + 2 * HOUR: 7, T0 + 3 * HOUR: None}
    assert values(spark, temporal.TemporalSum(source), bbox=(0, 0, 1, 1), width=1, height=1, start=T0, stop=T0 + DAY) == {T0 + 2 * HOUR: [[8]]}


@pytest.mark.parametrize("statistic,expected", [("sum", [3, 0, 0]), ("count", [3, 3, 0]), ("min", [1, 0, None]), ("max", [1, 0, None]), ("mean", [1, 0, None]), ("median", [1, 0, None]), ("std", [0, 0, None]), ("var", [0, 0, None]), ("p75", [1, 0, None])])
def test_monthly(spark, row, statistic, expected):
    got = values(spark, temporal.TemporalAggregate(row, "M", statistic), start=T0, stop=datetime(2001, 1, 1))
    assert got == {datetime(2000, 1, 31): [expected]}


def test_weekly_and_gaps(spark, row):
    assert values(spark, temporal.TemporalAggregate(row, "W", "sum"), start=T0, stop=datetime(2001, 1, 1)) == {datetime(2000, 1, 2): [[2, 0, 0]], datetime(2000, 1, 9): [[1, 0, 0]]}
    half = temporal.TemporalAggregate(row, "12h", "sum")
    assert [v[0][0] for v in values(spark, half, start=T0, stop=T0 + DAY).values()] == [1, 0, 1]
    assert [v[0][0] for v in values(spark, temporal.TemporalAggregate(row, "12h", "mean"), start=T0, stop=T0 + DAY).values()] == [1, None, 1]
    whole = temporal.TemporalAggregate(row, None, "sum")
    assert not whole.temporal and values(spark, whole) == {T0 + 2 * DAY: [[3, 0, 0]]}


def test_local_days(spark):
    hours = raster([[[1]]] * 48, first=datetime(2000, 1, 1))
    got = values(spark, temporal.TemporalAggregate(hours, "D", "sum", timezone="Europe/Amsterdam"), start=datetime(1999, 1, 1), stop=datetime(2001, 1, 1))
    assert got == {datetime(1999, 12, 31, 23): [[23]], datetime(2000, 1, 1, 23): [[24]], datetime(2000, 1, 2, 23): [[1]]}


@pytest.mark.parametrize("frequency,expected", [("D", [1, 1, 1]), ("W", [1, 2, 1]), ("M", [1, 2, 3]), (None, [1, 2, 3])])
def test_cumulative(spark, row, frequency, expected):
    got = values(spark, temporal.Cumulative(row, "sum", frequency), start=T0, stop=T0 + 5 * DAY)
    assert [v[0] for v in got.values()] == [[k, 0, 0] for k in expected]
    assert only(spark, temporal.Cumulative(row, "count", "M")) == [[3, 3, 0]]


@pytest.mark.parametrize("direction,expected", [("backward", [1, 7, None]), ("forward", [1, None]), ("nearest", [1, 7])])
def test_resample(spark, source, direction, expected):
    got = values(spark, temporal.Resample(source, "90min", direction), bbox=(0, 0, 1, 1), width=1, height=1, start=T0, stop=T0 + DAY)
    assert [v[0][0] for v in got.values()] == expected and [*got] == [T0 + k * 1.5 * HOUR for k in range(len(expected))]


def test_stencils(spark):
    a = raster([[0, 2], [0, 0], [0, 0]])
    assert only(spark, spatial.Dilate(a, [2])) == [[2, 2], [0, 2], [0, 0]]
    assert only(spark, spatial.MovingMax(a, 3)) == [[2, 2], [2, 2], [0, 0]]
    flat = raster(np.full((6, 6), 5))
    assert only(spark, spatial.HillShade(flat), bbox=(1, 1, 5, 5), width=4, height=4) == [[180] * 4] * 4
    smooth = only(spark, spatial.Smooth(raster(np.full((40, 40), 6.0), dtype="float64"), 3), bbox=(15, 15, 17, 17), width=2, height=2)
    # cells beyond three sigma count as fill
    assert np.allclose(smooth, 6, atol=0.02)
    assert np.array(only(spark, spatial.MovingMax(raster(np.eye(9, dtype="uint8") * 3), 5)))[4, 4] == 3


def test_moving_max_circle(spark):
    data = np.zeros((11, 11), dtype="uint8")
    data[5, 5] = 9
    for size in (3, 5, 7):
        got = np.array(only(spark, spatial.MovingMax(raster(data), size)))
        y, x = np.mgrid[-5:6, -5:6]
        assert np.array_equal(got, np.where((x * x + y * y < size * size / 4), 9, 0))


def test_place(spark):
    a = raster([[1, 2], [3, 255]])
    request = dict(bbox=(0, 0, 4, 4), width=4, height=4)
    got = only(spark, spatial.Place(a, "EPSG:3857", (0, 0), [(0, 0), (1, 1)], "sum"), **request)
    assert got == [[0, 0, 0, 0], [0, 1, 2, 0], [1, 5, 0, 0], [3, 0, 0, 0]]
    assert only(spark, spatial.Place(a, "EPSG:3857", (0, 0), [(0, 0), (1, 1)]), **request)[2] == [1, 3, None, None]
    assert only(spark, spatial.Place(a, "EPSG:3857", (0, 0), [], "last"), **request) == [[None] * 4] * 4


def test_tiler_changes_nothing(spark, source):
    assert values(spark, spatial.RasterTiler(source, 3), start=T0) == values(spark, source, start=T0)


def test_views(source):
    view = temporal.TemporalAggregate((source + 2) * 3, "D", "sum")
    again = Block.from_json(view.to_json())
    assert again.token == view.token and type(again) is type(view)
    assert len(view.get_graph()) == 4
    assert (source + 2).token == (source + 2).token != (source + 3).token
    with pytest.raises(ValueError, match="unknown block class"):
        construct({"a": ["os.system", "ls"]}, "a")
    with pytest.raises(TypeError):
        construct({"a": [dict]}, "a")
    with pytest.raises(AttributeError):
        view.args = ()
    assert DummyBlock("x").token != DummyBlock("y").token


def test_compute_graph(spark, source):
    from cellframe.plans.block import compute

    view = (source + 2) * (source + 2)
    graph, name = view.get_compute_graph(spark, start=T0)
    assert len(graph) == 3 and {r["v"] for r in compute(graph, name)} == {9}


def test_same_source_never_joins(spark, source):
    view = (source + 2) * (source > 3).rasters[0] - source
    plan = view.get_data(spark, start=T0, stop=T0 + DAY)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_extent_and_grid():
    a, b = Extent((0, 0, 2, 2), "EPSG:3857"), Extent((1, 1, 3, 3), "EPSG:3857")
    assert a.intersection(b).bbox == (1, 1, 2, 2) and a.union(b).bbox == (0, 0, 3, 3) and a.buffered(1).bbox == (-1, -1, 3, 3)
    assert a.intersection(Extent((2, 0, 3, 2), "EPSG:3857")) is None
    back = Extent((155000, 463000, 156000, 464000), "EPSG:28992").transformed("EPSG:4326").transformed("EPSG:28992").bbox
    assert np.allclose(back, (155000, 463000, 156000, 464000), atol=15)
    g = Grid.from_bbox((0, 0, 4, 2), 4, 2, "EPSG:3857")
    assert g.index(0, 2) == (0, 0) and g.index(3.999, 0.001) == (1, 3) and g.bbox == (0, 0, 4, 2)
