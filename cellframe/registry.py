"""Registered queries over the driver's tables, and the SQL each must equal. One key for each operator.

Rasters are made of events: one frame a day, cells by user and event, values in cents, so that sums are whole numbers. Features are supplier boxes
and customer points; series are over line items. All queries read whole tables.
"""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from .functions import geometry as geo
from .operators import combine, elemwise, misc, series, spatial, temporal, vector, zonal
from .operators.text import ParseTextColumn
from .sources.geometry import GeometryWKTSource, TableFeatures
from .sources.raster import MemorySource, TableSource

CRS = "EPSG:3857"
T0, DAYS = datetime(2024, 1, 1), 30
T1 = T0 + timedelta(days=DAYS - 1)
DAY, HALF = timedelta(days=1), timedelta(hours=12)
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


# --- views ---


def _cells(df):
    return df.select("t", (F.col("user_id") % 10).cast("int").alias("i"), (F.col("event_id") % 10).cast("int").alias("j"), F.round(F.col("value") * 100).cast("long").alias("v")).groupBy("t", "i", "j").agg(F.sum("v").alias("v"))


def _events(spark, sf_dir, error=False, shift=timedelta(0)):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = df.filter(F.col("event_type") == "error") if error else df
    t = F.date_trunc("day", "ts").cast("timestamp_ntz")
    if shift:
        t = (t + F.expr(f"INTERVAL {int(shift.total_seconds())} SECONDS")).cast("timestamp_ntz")
    return TableSource(_cells(df.withColumn("t", t)), CRS, 1, (0, 10), (10, 10), T0 + shift, DAY, DAYS, "int64")


def ras_a(spark, sf_dir):
    return _events(spark, sf_dir)


def ras_b(spark, sf_dir):
    return _events(spark, sf_dir, error=True)


def ras_half(spark, sf_dir):
    return _events(spark, sf_dir, error=True, shift=HALF)


def zones(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    x, y, side = (F.col("s_suppkey") % 8).cast("double"), (F.col("s_nationkey") % 8).cast("double"), (1 + F.col("s_suppkey") % 3).cast("double")
    return TableFeatures(df.select(F.col("s_suppkey").alias("fid"), geo.box(x, y, x + side, y + side).alias("geom"), "s_acctbal", "s_name"), CRS)


def points(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    x, y = (F.col("c_custkey") % 100) / 10.0, (F.col("c_nationkey") * 4 % 100) / 10.0
    return TableFeatures(df.select(F.col("c_custkey").alias("fid"), geo.point(x, y).alias("geom"), "c_acctbal"), CRS)


def items(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    none = F.lit(None).cast(geo.TYPE)
    return TableFeatures(df.select(fid.alias("fid"), none.alias("geom"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"), CRS)


def texts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.lit("type = "), F.col("event_type"), F.lit("\nk="), F.regexp_extract("props", r'"k": (\d+)', 1), F.lit("\nbig="), F.when(F.col("value") > 10, "true").otherwise("false"))
    return TableFeatures(df.select(F.col("event_id").alias("fid"), F.lit(None).cast(geo.TYPE).alias("geom"), text.alias("description")), CRS)


# --- how a query is made ---

QUERIES: dict = {}
SQL: dict[str, str] = {}

AXIS = "SELECT TIMESTAMP '2024-01-01' + to_days(CAST(k AS INTEGER)) AS t FROM range(30) x(k)"
VIEWS = f"""
axis AS ({AXIS}),
grid AS (SELECT CAST(y.i AS INTEGER) AS i, CAST(x.j AS INTEGER) AS j FROM range(10) y(i), range(10) x(j)),
ev AS (SELECT date_trunc('day', ts) AS t, CAST(user_id % 10 AS INTEGER) AS i, CAST(event_id % 10 AS INTEGER) AS j, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
sa AS (SELECT t, i, j, CAST(sum(cents) AS BIGINT) AS v FROM ev GROUP BY t, i, j),
sb AS (SELECT t, i, j, CAST(sum(cents) AS BIGINT) AS v FROM ev WHERE event_type = 'error' GROUP BY t, i, j),
a AS (SELECT axis.t, grid.i, grid.j, sa.v FROM axis CROSS JOIN grid LEFT JOIN sa ON sa.t = axis.t AND sa.i = grid.i AND sa.j = grid.j),
b AS (SELECT axis.t, grid.i, grid.j, sb.v FROM axis CROSS JOIN grid LEFT JOIN sb ON sb.t = axis.t AND sb.i = grid.i AND sb.j = grid.j),
half AS (SELECT t + INTERVAL 12 HOUR AS t, i, j, v FROM b),
ab AS (SELECT a.t, a.i, a.j, a.v AS a, b.v AS b FROM a JOIN b ON a.t = b.t AND a.i = b.i AND a.j = b.j),
zones AS (SELECT s_suppkey AS fid, CAST(s_suppkey % 8 AS DOUBLE) AS x0, CAST(s_nationkey % 8 AS DOUBLE) AS y0, CAST(s_suppkey % 8 + 1 + s_suppkey % 3 AS DOUBLE) AS x1, CAST(s_nationkey % 8 + 1 + s_suppkey % 3 AS DOUBLE) AS y1, s_acctbal, s_name FROM supplier),
points AS (SELECT c_custkey AS fid, (c_custkey % 100) / 10.0::DOUBLE AS x, (c_nationkey * 4 % 100) / 10.0::DOUBLE AS y, c_acctbal FROM customer),
items AS (SELECT l_orderkey * 10 + l_linenumber AS fid, * FROM lineitem)
"""
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR"}


def _cast(kind: str, c: str = "v") -> str:
    return f"CAST(round({c}, 4) AS DOUBLE)" if kind == "double" else f"CAST({c} AS {SQL_TYPES[kind]})"


def _out(kind: str, c):
    # adding zero turns -0 into 0, as the texts of results would differ
    return F.round(c.cast("double"), 4) + 0.0 if kind == "double" else c.cast(kind)


def raster_query(name: str, kind: str, block, sql: str, **request) -> None:
    """block(spark, sf_dir) -> raster; sql gives t, i, j, v over VIEWS."""
    request = {"start": T0, "stop": T1 + DAY} | request

    def run(spark, sf_dir):
        df = block(spark, sf_dir).get_data(spark, **({"bbox": (0, 0, 10, 10), "width": 10, "height": 10, "projection": CRS} | request))
        return df.select("t", "i", "j", _out(kind, F.col("v")).alias("v"))

    QUERIES[name] = run
    SQL[name] = f"WITH {VIEWS} SELECT CAST(t AS TIMESTAMP) AS t, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {_cast(kind)} AS v FROM ({sql}) q"


def series_query(name: str, kind: str, block, sql: str) -> None:
    """block(items) -> series; sql is an expression over items."""

    def run(spark, sf_dir):
        return block(items(spark, sf_dir)).get_data(spark).select("fid", _out(kind, F.col("value")).alias("value"))

    QUERIES[name] = run
    SQL[name] = f"WITH {VIEWS} SELECT fid, {_cast(kind, f'({sql})')} AS value FROM items"


def table_query(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = f"WITH {VIEWS} {sql}"


# --- sources ---

raster_query("raster_memory_window", "bigint", ras_a, "SELECT t, i - 2 AS i, j + 1 AS j, v FROM a WHERE i BETWEEN 2 AND 6 AND j BETWEEN 0 AND 4 UNION ALL SELECT t, i - 2, 0, NULL FROM a WHERE i BETWEEN 2 AND 6 AND j = 0", bbox=(-1, 3, 5, 8), width=6, height=5)
raster_query("raster_latest", "bigint", ras_a, "SELECT * FROM a WHERE t = TIMESTAMP '2024-01-30'", start=None, stop=None)
raster_query("raster_nearest_time", "bigint", ras_a, "SELECT * FROM a WHERE t = TIMESTAMP '2024-01-11'", start=datetime(2024, 1, 10, 13), stop=None)
raster_query("raster_point", "bigint", ras_a, "SELECT t, 0 AS i, 0 AS j, v FROM a WHERE i = 4 AND j = 3", bbox=(3.5, 5.5, 3.5, 5.5), width=1, height=1)
raster_query("raster_coarse_window", "bigint", ras_a, "SELECT t, (i - 1) // 2 AS i, (j - 1) // 2 AS j, v FROM a WHERE i % 2 = 1 AND j % 2 = 1", width=5, height=5)


def _memory(spark, sf_dir):
    return MemorySource([[1, 2], [3, 255]], 255, CRS, 5, (0, 10))


raster_query("raster_array", "bigint", _memory, "SELECT TIMESTAMP '1970-01-01' AS t, i, j, CASE WHEN i < 5 AND j < 5 THEN 1 WHEN i < 5 THEN 2 WHEN j < 5 THEN 3 END AS v FROM grid", start=None, stop=None)


def _frames(mode):
    def run(spark, sf_dir):
        return ras_a(spark, sf_dir).get_data(spark, mode=mode, start=T0, stop=T1)

    return run


table_query("raster_time", _frames("time"), "SELECT CAST(t AS TIMESTAMP) AS t FROM axis")
table_query("raster_meta", _frames("meta"), "SELECT CAST(t AS TIMESTAMP) AS t, CAST(NULL AS VARCHAR) AS meta FROM axis")


def _features(block, *columns, **request):
    def run(spark, sf_dir):
        return block(spark, sf_dir).get_data(spark, **request).select("fid", *columns)

    return run


table_query("geom_source_bbox_limit", _features(zones, "s_name", geometry=(1.5, 1.5, 4.5, 4.5), limit=10), "SELECT fid, s_name FROM zones WHERE x0 <= 4.5 AND x1 >= 1.5 AND y0 <= 4.5 AND y1 >= 1.5 ORDER BY fid LIMIT 10")
table_query("geom_source_bbox", _features(zones, "s_name", geometry=(1.5, 1.5, 4.5, 4.5)), "SELECT fid, s_name FROM zones WHERE x0 <= 4.5 AND x1 >= 1.5 AND y0 <= 4.5 AND y1 >= 1.5")
table_query("geom_source_centroid", _features(zones, "s_name", geometry=(1, 1, 4, 4), mode="centroid"), "SELECT fid, s_name FROM zones WHERE (x0 + x1) / 2 >= 1 AND (x0 + x1) / 2 < 4 AND (y0 + y1) / 2 >= 1 AND (y0 + y1) / 2 < 4")
table_query("geom_source_extent", lambda spark, sf_dir: zones(spark, sf_dir).get_data(spark, mode="extent", geometry=(1.5, 1.5, 4.5, 4.5)), "SELECT min(x0) AS minx, min(y0) AS miny, max(x1) AS maxx, max(y1) AS maxy FROM zones WHERE x0 <= 4.5 AND x1 >= 1.5 AND y0 <= 4.5 AND y1 >= 1.5")
table_query("geom_source_filter_min_size", _features(zones, filters={"s_name": "Supplier#000000007"}, min_size=1.5), "SELECT fid FROM zones WHERE s_name = 'Supplier#000000007' AND (x1 - x0 >= 1.5 OR y1 - y0 >= 1.5)")
table_query("geom_source_min_size", _features(zones, min_size=1.5), "SELECT fid FROM zones WHERE x1 - x0 >= 1.5 OR y1 - y0 >= 1.5")
table_query("geom_source_wkt", lambda spark, sf_dir: GeometryWKTSource("POLYGON ((0 0, 4 0, 0 4, 0 0))", CRS).get_data(spark).select("fid", geo.area(F.col("geom")).alias("area")), "SELECT CAST(0 AS BIGINT) AS fid, CAST(8 AS DOUBLE) AS area")

# --- element-wise ---

ADD = {"add": ("bigint", elemwise.Add, "a + b"), "sub": ("bigint", elemwise.Subtract, "a - b"), "mul": ("bigint", elemwise.Multiply, "a * b"), "div": ("double", elemwise.Divide, "CASE WHEN b <> 0 THEN a::DOUBLE / b END")}
COMPARE = {"eq": (elemwise.Equal, "coalesce(a = b, false)"), "ne": (elemwise.NotEqual, "coalesce(a <> b, true)"), "gt": (elemwise.Greater, "coalesce(a > b, false)"), "ge": (elemwise.GreaterEqual, "coalesce(a >= b, false)"), "lt": (elemwise.Less, "coalesce(a < b, false)"), "le": (elemwise.LessEqual, "coalesce(a <= b, false)")}
LOGIC = {"and": (elemwise.And, "AND"), "or": (elemwise.Or, "OR"), "xor": (elemwise.Xor, "<>")}


def _two(cls):
    return lambda spark, sf_dir: cls(ras_a(spark, sf_dir), ras_b(spark, sf_dir))


def _one(make):
    return lambda spark, sf_dir: make(ras_a(spark, sf_dir))


def _logic(cls):
    return lambda spark, sf_dir: cls(ras_a(spark, sf_dir) > 2000, ras_b(spark, sf_dir) <= 3000)


for _n, (_kind, _cls, _sql) in ADD.items():
    raster_query(f"ras_{_n}", _kind, _two(_cls), f"SELECT t, i, j, {_sql} AS v FROM ab")
for _n, (_cls, _sql) in COMPARE.items():
    raster_query(f"ras_{_n}", "boolean", _two(_cls), f"SELECT t, i, j, {_sql} AS v FROM ab")
for _n, (_cls, _sql) in LOGIC.items():
    raster_query(f"ras_{_n}", "boolean", _logic(_cls), f"SELECT t, i, j, coalesce(a > 2000, false) {_sql} coalesce(b <= 3000, false) AS v FROM ab")
raster_query("ras_pow", "double", _one(lambda a: (a / 1000) ** 2), "SELECT t, i, j, pow(v / 1000.0, 2) AS v FROM a")
raster_query("ras_constant", "bigint", _one(lambda a: 100 - (a + 2) * 3), "SELECT t, i, j, 100 - (v + 2) * 3 AS v FROM a")
raster_query("ras_not", "boolean", _one(lambda a: ~(a > 2000)), "SELECT t, i, j, NOT coalesce(v > 2000, false) AS v FROM a")
raster_query("ras_isdata", "boolean", lambda s, d: elemwise.IsData(ras_b(s, d)), "SELECT t, i, j, v IS NOT NULL AS v FROM b")
raster_query("ras_isnodata", "boolean", lambda s, d: elemwise.IsNoData(ras_b(s, d)), "SELECT t, i, j, v IS NULL AS v FROM b")
raster_query("ras_fill", "bigint", _two(elemwise.FillNoData), "SELECT t, i, j, coalesce(b, a) AS v FROM ab")
raster_query("ras_exp", "double", _one(lambda a: elemwise.Exp(a / 100000)), "SELECT t, i, j, exp(v / 100000.0) AS v FROM a")
raster_query("ras_log", "double", _one(lambda a: elemwise.Log(a - 500)), "SELECT t, i, j, CASE WHEN v > 500 THEN ln(v - 500) END AS v FROM a")
raster_query("ras_log10", "double", _one(lambda a: elemwise.Log10(a - 500)), "SELECT t, i, j, CASE WHEN v > 500 THEN log10(v - 500) END AS v FROM a")

# --- masks and classes ---

raster_query("ras_clip", "bigint", _two(misc.Clip), "SELECT t, i, j, CASE WHEN b IS NOT NULL THEN a END AS v FROM ab")
raster_query("ras_mask", "bigint", _one(lambda a: misc.Mask(a, 7)), "SELECT t, i, j, CASE WHEN v IS NOT NULL THEN 7 END AS v FROM a")
raster_query("ras_maskbelow", "bigint", _one(lambda a: misc.MaskBelow(a, 2000)), "SELECT t, i, j, CASE WHEN v >= 2000 THEN v END AS v FROM a")
raster_query("ras_step", "bigint", _one(lambda a: misc.Step(a, 1, 5, 2000, 3)), "SELECT t, i, j, CASE WHEN v < 2000 THEN 1 WHEN v = 2000 THEN 3 WHEN v > 2000 THEN 5 END AS v FROM a")
raster_query("ras_classify", "bigint", _one(lambda a: misc.Classify(a, [1000, 2000, 5000])), "SELECT t, i, j, (v >= 1000)::INT + (v >= 2000)::INT + (v >= 5000)::INT AS v FROM a")
raster_query("ras_reclassify", "bigint", _one(lambda a: misc.Reclassify(misc.Classify(a, [1000, 2000, 5000]), [[0, 10], [2, 30]], True)), "SELECT t, i, j, CASE WHEN v < 1000 THEN 10 WHEN v >= 2000 AND v < 5000 THEN 30 END AS v FROM a")

# --- combined ---

raster_query("ras_group_aligned", "bigint", lambda s, d: combine.Group(ras_a(s, d), temporal.Shift(ras_b(s, d), DAY)), "SELECT x.t, grid.i, grid.j, coalesce(s.v, a.v) AS v FROM (SELECT t FROM axis UNION SELECT t + INTERVAL 1 DAY FROM axis) x CROSS JOIN grid LEFT JOIN a ON a.t = x.t AND a.i = grid.i AND a.j = grid.j LEFT JOIN b s ON s.t + INTERVAL 1 DAY = x.t AND s.i = grid.i AND s.j = grid.j")
raster_query("ras_group_mixed", "bigint", lambda s, d: combine.Group(ras_a(s, d), temporal.Resample(ras_half(s, d), "36h", "backward")), "SELECT x.t, x.i, x.j, max_by(x.v, x.r) FILTER (WHERE x.v IS NOT NULL) AS v FROM (SELECT *, 0 AS r FROM a UNION ALL SELECT l.t, half.i, half.j, half.v, 1 FROM (SELECT TIMESTAMP '2024-01-01' + to_hours(CAST(36 * k AS INTEGER)) AS t FROM range(1, 21) y(k)) l JOIN half ON half.t = (SELECT max(h.t) FROM half h WHERE h.t <= l.t)) x GROUP BY ALL")
raster_query("ras_max", "bigint", _two(combine.Max), "SELECT t, i, j, greatest(a, b) AS v FROM ab")


REDUCE = {
    "first": ("bigint", "min_by(v, r) FILTER (WHERE v IS NOT NULL)"), "last": ("bigint", "max_by(v, r) FILTER (WHERE v IS NOT NULL)"), "count": ("bigint", "count(v)"), "sum": ("bigint", "coalesce(sum(v), 0)"),
    "mean": ("double", "avg(v)"), "min": ("bigint", "min(v)"), "max": ("bigint", "max(v)"), "std": ("double", "stddev_pop(v)"), "var": ("double", "var_pop(v)"), "median": ("double", "median(v)"),
    "argmin": ("bigint", "arg_min(r, v * 10 + r) FILTER (WHERE v IS NOT NULL)"), "argmax": ("bigint", "arg_max(r, v * 10 - r) FILTER (WHERE v IS NOT NULL)"), "product": ("double", "product(v::DOUBLE)"), "p90": ("double", "quantile_cont(v, 0.9)"), "p25": ("double", "quantile_cont(v, 0.25)"),
}


def _reduce(statistic):
    # values in tens of euros keep products small
    return lambda s, d: combine.Reduce(statistic, *(misc.Step(r, 0, 0, -1) + r for r in (ras_b(s, d), ras_a(s, d), temporal.Shift(ras_b(s, d), timedelta(0)))))


for _n, (_kind, _sql) in REDUCE.items():
    raster_query(f"ras_reduce_{_n}", _kind, _reduce(_n), f"SELECT t, i, j, {_sql} AS v FROM (SELECT *, 0 AS r FROM b UNION ALL SELECT *, 1 FROM a UNION ALL SELECT *, 2 FROM b) x GROUP BY t, i, j")

# --- time ---

raster_query("tmp_shift", "bigint", _one(lambda a: temporal.Shift(a, 2 * DAY)), "SELECT t + INTERVAL 2 DAY AS t, i, j, v FROM a WHERE t + INTERVAL 2 DAY <= TIMESTAMP '2024-01-31'")
raster_query("tmp_snap", "bigint", lambda s, d: temporal.Snap(ras_half(s, d), ras_a(s, d)), "SELECT a.t, half.i, half.j, half.v FROM axis a JOIN half ON half.t = greatest(a.t - INTERVAL 12 HOUR, TIMESTAMP '2024-01-01 12:00')")
raster_query("tmp_sum", "bigint", _one(temporal.TemporalSum), "SELECT max(t) AS t, i, j, sum(v) AS v FROM a GROUP BY i, j")
TEMPORAL = {"sum": ("bigint", "coalesce(sum(v), 0)"), "count": ("bigint", "count(v)"), "min": ("bigint", "min(v)"), "max": ("bigint", "max(v)"), "mean": ("double", "avg(v)"), "median": ("double", "median(v)"), "std": ("double", "stddev_pop(v)"), "var": ("double", "var_pop(v)"), "p75": ("double", "quantile_cont(v, 0.75)")}


def _aggregate(statistic, frequency="7D", **kw):
    return lambda s, d: temporal.TemporalAggregate(ras_b(s, d), frequency, statistic, **kw)


WEEK = "TIMESTAMP '2024-01-01' + to_days(CAST(7 * (date_diff('day', TIMESTAMP '2024-01-01', t) // 7) AS INTEGER))"
for _n, (_kind, _sql) in TEMPORAL.items():
    raster_query(f"tmp_agg_{_n}", _kind, _aggregate(_n), f"SELECT {WEEK} AS t, i, j, {_sql} AS v FROM b GROUP BY ALL")
LATE = datetime(2024, 3, 1)
raster_query("tmp_agg_week", "bigint", _aggregate("sum", "W"), "SELECT date_trunc('week', t) + INTERVAL 6 DAY AS t, i, j, coalesce(sum(v), 0) AS v FROM b GROUP BY ALL", stop=LATE)
raster_query("tmp_agg_month_end", "bigint", _aggregate("sum", "ME"), "SELECT TIMESTAMP '2024-01-31' AS t, i, j, coalesce(sum(v), 0) AS v FROM b GROUP BY ALL", stop=LATE)
raster_query("tmp_agg_month_start", "bigint", _aggregate("max", "MS"), "SELECT TIMESTAMP '2024-01-01' AS t, i, j, max(v) AS v FROM b GROUP BY ALL", stop=LATE)
raster_query("tmp_agg_right", "bigint", _aggregate("sum", "2D", closed="right", label="right"), "SELECT TIMESTAMP '2024-01-01' + to_days(CAST(2 * ((date_diff('day', TIMESTAMP '2024-01-01', t) + 1) // 2) AS INTEGER)) AS t, i, j, coalesce(sum(v), 0) AS v FROM b GROUP BY ALL", stop=LATE)
raster_query("tmp_agg_gaps", "bigint", _aggregate("count", "12h"), "SELECT x.t, grid.i, grid.j, count(b.v) AS v FROM (SELECT TIMESTAMP '2024-01-01' + to_hours(CAST(12 * k AS INTEGER)) AS t FROM range(59) y(k)) x CROSS JOIN grid LEFT JOIN b ON b.t = x.t AND b.i = grid.i AND b.j = grid.j GROUP BY ALL")
raster_query("tmp_agg_tz", "bigint", lambda s, d: temporal.TemporalAggregate(ras_half(s, d), "W", "sum", timezone="America/New_York"), "SELECT date_trunc('week', t) + INTERVAL 6 DAY + INTERVAL 5 HOUR AS t, i, j, coalesce(sum(v), 0) AS v FROM b GROUP BY ALL", stop=LATE)
raster_query("tmp_agg_all", "bigint", _aggregate("sum", None), "SELECT max(t) AS t, i, j, coalesce(sum(v), 0) AS v FROM b GROUP BY i, j")
raster_query("tmp_cum_sum", "bigint", lambda s, d: temporal.Cumulative(ras_b(s, d), "sum"), "SELECT t, i, j, sum(coalesce(v, 0)) OVER (PARTITION BY i, j ORDER BY t) AS v FROM b")
raster_query("tmp_cum_count", "bigint", lambda s, d: temporal.Cumulative(ras_b(s, d), "count"), "SELECT t, i, j, count(v) OVER (PARTITION BY i, j ORDER BY t) AS v FROM b")
raster_query("tmp_cum_week", "bigint", lambda s, d: temporal.Cumulative(ras_b(s, d), "sum", "W"), "SELECT * FROM (SELECT t, i, j, sum(coalesce(v, 0)) OVER (PARTITION BY i, j, date_trunc('week', t) ORDER BY t) AS v FROM b) x WHERE t >= TIMESTAMP '2024-01-10'", start=datetime(2024, 1, 10))
for _n, _pick in (("backward", "(SELECT max(h.t) FROM half h WHERE h.t <= l.t)"), ("forward", "(SELECT min(h.t) FROM half h WHERE h.t >= l.t)"), ("nearest", "(SELECT arg_min(h.t, abs(date_diff('minute', h.t, l.t)) * 100000 + date_diff('day', TIMESTAMP '2024-01-01', h.t)) FROM half h)")):
    _range = {"backward": "range(1, 21)", "forward": "range(0, 20)", "nearest": "range(0, 21)"}[_n]
    raster_query(f"tmp_resample_{_n}", "bigint", (lambda n: lambda s, d: temporal.Resample(ras_half(s, d), "36h", n))(_n), f"SELECT l.t, half.i, half.j, half.v FROM (SELECT TIMESTAMP '2024-01-01' + to_hours(CAST(36 * k AS INTEGER)) AS t FROM {_range} y(k)) l JOIN half ON half.t = {_pick}", stop=LATE)

# --- space ---

NEAR = "JOIN (SELECT CAST(y.di AS INTEGER) AS di, CAST(x.dj AS INTEGER) AS dj FROM range(-2, 3) y(di), range(-2, 3) x(dj)) o ON"
raster_query("spa_dilate", "bigint", lambda s, d: spatial.Dilate(misc.Classify(ras_b(s, d), [1000, 2000, 5000]), [1, 3]), f"SELECT c.t, c.i, c.j, CASE WHEN bool_or(coalesce(n.k = 3, false)) THEN 3 WHEN bool_or(coalesce(n.k = 1, false)) THEN 1 ELSE any_value(c.k) END AS v FROM (SELECT t, i, j, (v >= 1000)::INT + (v >= 2000)::INT + (v >= 5000)::INT AS k FROM b) c {NEAR} abs(di) + abs(dj) <= 1 LEFT JOIN (SELECT t, i, j, (v >= 1000)::INT + (v >= 2000)::INT + (v >= 5000)::INT AS k FROM b) n ON n.t = c.t AND n.i = c.i + di AND n.j = c.j + dj GROUP BY c.t, c.i, c.j")
raster_query("spa_movingmax", "bigint", lambda s, d: spatial.MovingMax(ras_b(s, d), 5), f"SELECT c.t, c.i, c.j, max(n.v) AS v FROM b c {NEAR} di * di + dj * dj < 6.25 LEFT JOIN b n ON n.t = c.t AND n.i = c.i + di AND n.j = c.j + dj GROUP BY c.t, c.i, c.j")
_s = {(di, dj): f"coalesce(max(n.v) FILTER (WHERE di = {di} AND dj = {dj}), 0)" for di in (-1, 0, 1) for dj in (-1, 0, 1)}
_y = f"({_s[-1, -1]} + 2 * {_s[-1, 0]} + {_s[-1, 1]} - {_s[1, -1]} - 2 * {_s[1, 0]} - {_s[1, 1]})"
_x = f"({_s[-1, -1]} + 2 * {_s[0, -1]} + {_s[1, -1]} - {_s[-1, 1]} - 2 * {_s[0, 1]} - {_s[1, 1]})"
raster_query("spa_hillshade", "bigint", lambda s, d: spatial.HillShade(elemwise.FillNoData(ras_a(s, d) / 1000), 45, 315), f"SELECT t, i, j, CASE WHEN c <= 0 THEN 0 ELSE floor(255 * c) END AS v FROM (SELECT t, i, j, (sin(radians(45)) - cos(radians(45)) * 0.125 * sqrt(x * x + y * y) * sin(atan2(y, x) - radians(315))) / sqrt(1 + 0.015625 * (x * x + y * y)) AS c FROM (SELECT c.t, c.i, c.j, CAST(CAST({_y} AS FLOAT) AS DOUBLE) AS y, CAST(CAST({_x} AS FLOAT) AS DOUBLE) AS x FROM a c {NEAR} abs(di) <= 1 AND abs(dj) <= 1 LEFT JOIN (SELECT t, i, j, v / 1000.0::DOUBLE AS v FROM a) n ON n.t = c.t AND n.i = c.i + di AND n.j = c.j + dj GROUP BY c.t, c.i, c.j) g) h")
_g = "exp(-0.5 * k * k / 1.0)"
raster_query("spa_smooth", "double", lambda s, d: spatial.Smooth(ras_b(s, d) / 1, 3), "SELECT c.t, c.i, c.j, sum(coalesce(n.v, 0) * wi.w * wj.w) AS v FROM b c JOIN w wi ON true JOIN w wj ON true LEFT JOIN b n ON n.t = c.t AND n.i = c.i + wi.k AND n.j = c.j + wj.k GROUP BY c.t, c.i, c.j")
SQL["spa_smooth"] = SQL["spa_smooth"].replace("WITH ", f"WITH w0 AS (SELECT CAST(k AS INTEGER) AS k, {_g} AS e FROM range(-4, 5) y(k)), w AS (SELECT k, e / (SELECT sum(e) FROM w0) AS w FROM w0), ", 1)
PLACES = [(0, 0), (2, 1), (3, 3), (-4, 2)]
_moves = ", ".join(f"({k}, {-y}, {x})" for k, (x, y) in enumerate(PLACES))
for _n, _kind, _agg in (("last", "bigint", "max_by(p.v, p.r) FILTER (WHERE p.v IS NOT NULL)"), ("sum", "bigint", "coalesce(sum(p.v), 0)"), ("max", "bigint", "max(p.v)")):
    raster_query(f"spa_place_{_n}", _kind, (lambda n: lambda s, d: spatial.Place(ras_b(s, d), CRS, (0, 0), PLACES, n))(_n), f"SELECT axis.t, grid.i, grid.j, {_agg} AS v FROM axis CROSS JOIN grid LEFT JOIN (SELECT b.t, b.i + m.di AS i, b.j + m.dj AS j, b.v, m.r FROM b CROSS JOIN (VALUES {_moves}) m(r, di, dj)) p ON p.t = axis.t AND p.i = grid.i AND p.j = grid.j GROUP BY axis.t, grid.i, grid.j")
raster_query("til_raster", "bigint", _one(lambda a: spatial.RasterTiler(a, 3)), "SELECT * FROM a")

# --- features and rasters ---

INSIDE = "j >= x0 AND j < x1 AND 9.5 - i > y0 AND 9.5 - i < y1"
raster_query("ras_rasterize", "bigint", lambda s, d: zonal.Rasterize(zones(s, d), "fid"), f"SELECT TIMESTAMP '1970-01-01' AS t, i, j, max(fid) AS v FROM grid LEFT JOIN zones ON {INSIDE} GROUP BY i, j")
raster_query("ras_rasterize_mask", "boolean", lambda s, d: zonal.Rasterize(zones(s, d)), f"SELECT TIMESTAMP '1970-01-01' AS t, i, j, count(fid) > 0 AS v FROM grid LEFT JOIN zones ON {INSIDE} GROUP BY i, j")
raster_query("ras_rasterize_wkt", "boolean", lambda s, d: zonal.RasterizeWKT("POLYGON ((2.2 1.2, 8.2 1.2, 8.2 7.2, 2.2 7.2, 2.2 1.2))", CRS), "SELECT TIMESTAMP '1970-01-01' AS t, i, j, j + 0.5 > 2.2 AND j + 0.5 < 8.2 AND 9.5 - i > 1.2 AND 9.5 - i < 7.2 AS v FROM grid")
ZONAL = {"sum": "coalesce(sum(v), 0)", "count": "count(v)", "min": "min(v)", "max": "max(v)", "mean": "avg(v)", "median": "median(v)", "p75": "quantile_cont(v, 0.75)"}
AT = datetime(2024, 1, 10)


def _value(name="agg"):
    # results are 32-bit floats; whole cents of these tables are exact in them, other statistics are rounded to tens
    return F.round(F.col(name).cast("double"), -1).alias("agg")


def _zonal(block, name="agg"):
    def run(spark, sf_dir):
        return block(spark, sf_dir).get_data(spark, start=AT).select("fid", _value(name))

    return run


def _fsql(expr):
    return f"CAST(round(CAST(CAST({expr} AS FLOAT) AS DOUBLE), -1) AS DOUBLE) AS agg"


for _n, _sql in ZONAL.items():
    table_query(f"zonal_{_n}", _zonal((lambda n: lambda s, d: zonal.AggregateRaster(zones(s, d), ras_b(s, d), n))(_n)), f"SELECT fid, {_fsql(_sql)} FROM zones LEFT JOIN b ON b.t = TIMESTAMP '2024-01-10' AND {INSIDE} GROUP BY fid")
table_query("zonal_threshold", _zonal(lambda s, d: zonal.AggregateRasterAboveThreshold(zones(s, d), ras_a(s, d), "sum", threshold_name="s_acctbal")), f"SELECT fid, {_fsql('coalesce(sum(v), 0)')} FROM zones LEFT JOIN a ON a.t = TIMESTAMP '2024-01-10' AND v >= s_acctbal AND {INSIDE} GROUP BY fid")
table_query("zonal_points", _zonal(lambda s, d: zonal.AggregateRaster(points(s, d), ras_b(s, d), "sum")), f"SELECT fid, {_fsql('coalesce(sum(v), 0)')} FROM points LEFT JOIN b ON b.t = TIMESTAMP '2024-01-10' AND j = floor(x) AND i = floor(10 - y) GROUP BY fid")


def _small(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    x, y = (F.col("c_custkey") % 100) / 10.0 + 0.01, (F.col("c_nationkey") * 4 % 100) / 10.0 + 0.01
    return TableFeatures(df.select(F.col("c_custkey").alias("fid"), geo.box(x, y, x + 0.02, y + 0.02).alias("geom")), CRS)


table_query("zonal_small", _zonal(lambda s, d: zonal.AggregateRaster(_small(s, d), ras_b(s, d), "max")), f"SELECT fid, {_fsql('max(v)')} FROM points LEFT JOIN b ON b.t = TIMESTAMP '2024-01-10' AND j = floor(x + 0.02) AND i = floor(10 - (y + 0.02)) GROUP BY fid")


def _array(spark, sf_dir):
    df = zonal.AggregateRaster(zones(spark, sf_dir), ras_b(spark, sf_dir), "max").get_data(spark, start=T0, stop=T1)
    return df.select("fid", F.array_join(F.transform("agg", lambda v: F.coalesce(F.round(v.cast("double"), -1).cast("long").cast("string"), F.lit("-"))), ",").alias("agg"))


table_query("zonal_temporal_array", _array, f"SELECT fid, string_agg(coalesce(CAST(CAST(round(v, -1) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY t) AS agg FROM (SELECT fid, axis.t, CAST(CAST(max(v) AS FLOAT) AS DOUBLE) AS v FROM zones CROSS JOIN axis LEFT JOIN b ON b.t = axis.t AND {INSIDE} GROUP BY fid, axis.t) x GROUP BY fid")
# larger cells than asked for have the value at their centre, and count for what they cover
COARSE = """, z AS (SELECT min(x0) AS ax, min(y0) AS ay, max(x1) AS bx, max(y1) AS cy FROM zones),
s AS (SELECT *, CASE WHEN floor((bx - ax) * (cy - ay)) > 30 THEN ceil(sqrt(floor((bx - ax) * (cy - ay)) / 30.0)) ELSE 1.0 END::DOUBLE AS s FROM z),
w AS (SELECT s, floor(ax / s) * s AS gx, ceil(cy / s) * s AS gy, ceil(bx / s) * s AS hx, floor(ay / s) * s AS hy FROM s),
c AS (SELECT ci, cj, gx + (cj + 0.5) * s AS mx, gy - (ci + 0.5) * s AS my, s FROM w, range(20) y(ci), range(20) x(cj) WHERE gx + (cj + 0.5) * s < hx AND gy - (ci + 0.5) * s > hy),
n AS (SELECT fid, ci, cj FROM zones JOIN c ON mx >= x0 AND mx < x1 AND my >= y0 AND my < y1),
m AS (SELECT * FROM n UNION ALL SELECT fid, CAST(floor((gy - (y0 + y1) / 2) / s) AS BIGINT), CAST(floor(((x0 + x1) / 2 - gx) / s) AS BIGINT) FROM zones, w WHERE fid NOT IN (SELECT fid FROM n))
SELECT zones.fid, CAST(coalesce(count(a.v) * any_value(w.s * w.s), 0) AS DOUBLE) AS agg FROM zones CROSS JOIN w LEFT JOIN m ON m.fid = zones.fid LEFT JOIN c ON c.ci = m.ci AND c.cj = m.cj
LEFT JOIN a ON a.t = TIMESTAMP '2024-01-10' AND a.i = floor(10 - c.my) AND a.j = floor(c.mx) GROUP BY zones.fid"""


def _autoscale(spark, sf_dir):
    df = zonal.AggregateRaster(zones(spark, sf_dir), ras_a(spark, sf_dir), "count", max_pixels=30, auto_pixel_size=True).get_data(spark, start=AT)
    return df.select("fid", F.col("agg").cast("double").alias("agg"))


QUERIES["zonal_autoscale"] = _autoscale
SQL["zonal_autoscale"] = f"WITH {VIEWS} {COARSE}"

# --- feature tables ---


def _merge(how):
    def run(spark, sf_dir):
        left, right = zones(spark, sf_dir), points(spark, sf_dir)
        return vector.MergeGeometryBlocks(left, right, how).get_data(spark).select("fid", "s_name", "s_acctbal", "c_acctbal")

    return run


for _n, _how in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    table_query(f"geo_merge_{_n}", _merge(_n), f"SELECT coalesce(z.fid, p.fid) AS fid, s_name, s_acctbal, c_acctbal FROM zones z {_how} points p ON z.fid = p.fid")
table_query("geo_area", lambda s, d: vector.Area(zones(s, d), CRS).get_data(s), "SELECT fid, (x1 - x0) * (y1 - y0) AS value FROM zones")
table_query("geo_intersection_box", lambda s, d: vector.Intersection(zones(s, d)).get_data(s, geometry=(1.5, 1.5, 4.5, 4.5)).select("fid", F.round(geo.area(F.col("geom")), 4).alias("area")), "SELECT fid, round((least(x1, 4.5) - greatest(x0, 1.5)) * (least(y1, 4.5) - greatest(y0, 1.5)), 4) AS area FROM zones WHERE x0 < 4.5 AND x1 > 1.5 AND y0 < 4.5 AND y1 > 1.5")


def _corners(spark, sf_dir):
    """A quarter of each zone's side."""
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    x, y, side = (F.col("s_suppkey") % 8).cast("double"), (F.col("s_nationkey") % 8).cast("double"), (1 + F.col("s_suppkey") % 3) / 4
    return TableFeatures(df.select(F.col("s_suppkey").alias("fid"), geo.box(x, y, x + side, y + side).alias("geom")), CRS)


def _geometry_area(block):
    return lambda s, d: block(s, d).get_data(s).select("fid", F.round(geo.area(F.col("geom")), 4).alias("area"))


table_query("geo_difference", _geometry_area(lambda s, d: vector.Difference(zones(s, d), _corners(s, d))), "SELECT fid, round((x1 - x0) * (y1 - y0) * 15 / 16, 4) AS area FROM zones")
# a box less what lies beyond the line x + y = 11.5
BEYOND = " + ".join(f"{sign} * power(greatest({x} + {y} - 11.5, 0), 2) / 2" for sign, x, y in ((-1, "x1", "y1"), (1, "x0", "y1"), (1, "x1", "y0"), (-1, "x0", "y0")))
table_query(
    "geo_intersection_polygon",
    lambda s, d: vector.Intersection(zones(s, d)).get_data(s, geometry="POLYGON ((0 0, 11.5 0, 0 11.5, 0 0))").select("fid", F.round(geo.area(F.col("geom")), 4).alias("area")),
    f"SELECT fid, round((x1 - x0) * (y1 - y0) + {BEYOND}, 4) AS area FROM zones WHERE x0 + y0 < 11.5",
)
# a quarter circle of 16 segments has the area 16 / 2 * sin(pi / 32) times the square of its radius
table_query("geo_buffer", _geometry_area(lambda s, d: vector.Buffer(zones(s, d), 0.5, CRS)), "SELECT fid, round((x1 - x0) * (y1 - y0) + 2 * (x1 - x0) + 32 * sin(pi() / 32) * 0.25, 4) AS area FROM zones")
table_query("geo_buffer_extent", lambda s, d: vector.Buffer(zones(s, d), 0.5, CRS).get_data(s, mode="extent"), "SELECT min(x0) - 0.5 AS minx, min(y0) - 0.5 AS miny, max(x1) + 0.5 AS maxx, max(y1) + 0.5 AS maxy FROM zones")
table_query("geo_simplify", _geometry_area(lambda s, d: vector.Simplify(zones(s, d), 0.1)), "SELECT fid, round((x1 - x0) * (y1 - y0), 4) AS area FROM zones")
table_query("til_geometry", lambda s, d: vector.GeometryTiler(zones(s, d), 4, CRS).get_data(s, mode="centroid", geometry=(0, 0, 20, 20)).select("fid", "s_name"), "SELECT fid, s_name FROM zones")
table_query("txt_parse", lambda s, d: ParseTextColumn(texts(s, d), "description", {"k": "k", "type": "kind", "big": "big"}).get_data(s).select("fid", "k", F.col("k_num").alias("n"), "kind", F.col("big_bool").alias("big")), """SELECT event_id AS fid, regexp_extract(props, '"k": (\\d+)', 1) AS k, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS DOUBLE) AS n, event_type AS kind, value > 10 AS big FROM events""")

# --- series ---

Q, P, D, X = "l_quantity", "l_extendedprice", "l_discount", "l_tax"
BINARY = {
    "add": ("double", lambda f: f[Q] + f[D], f"{Q} + {D}"), "sub": ("double", lambda f: f[Q] - f[D], f"{Q} - {D}"), "mul": ("double", lambda f: f[Q] * f[X], f"{Q} * {X}"),
    "div": ("double", lambda f: f[Q] / f[X], f"CASE WHEN {X} = 0 THEN 'inf'::DOUBLE ELSE {Q} / {X} END"), "floordiv": ("double", lambda f: (f[Q] - 25) // 7, f"floor(({Q} - 25) / 7)"), "pow": ("double", lambda f: f[Q] ** 2, f"pow({Q}, 2)"),
    "mod": ("double", lambda f: (f[Q] - 25) % 7, f"({Q} - 25) - 7 * floor(({Q} - 25) / 7)"),
    "eq": ("boolean", lambda f: f[D] == f[X], f"{D} = {X}"), "ne": ("boolean", lambda f: f[D] != f[X], f"{D} <> {X}"), "gt": ("boolean", lambda f: f[D] > f[X], f"{D} > {X}"), "ge": ("boolean", lambda f: f[D] >= f[X], f"{D} >= {X}"),
    "lt": ("boolean", lambda f: f[D] < f[X], f"{D} < {X}"), "le": ("boolean", lambda f: f[D] <= f[X], f"{D} <= {X}"),
    "and": ("boolean", lambda f: (f[D] > 0.05) & (f[X] > 0.04), f"{D} > 0.05 AND {X} > 0.04"), "or": ("boolean", lambda f: (f[D] > 0.05) | (f[X] > 0.04), f"{D} > 0.05 OR {X} > 0.04"), "xor": ("boolean", lambda f: (f[D] > 0.05) ^ (f[X] > 0.04), f"({D} > 0.05) <> ({X} > 0.04)"), "not": ("boolean", lambda f: ~(f[D] > 0.05), f"NOT {D} > 0.05"),
    "where": ("double", lambda f: series.Where(f[Q], f[D] > 0.05, -1.0), f"CASE WHEN {D} > 0.05 THEN {Q} ELSE -1 END"), "mask": ("double", lambda f: series.Mask(f[Q], f[D] > 0.05, f[X]), f"CASE WHEN {D} > 0.05 THEN {X} ELSE {Q} END"),
    "round": ("double", lambda f: series.Round(f[Q] / 2), f"round_even({Q} / 2, 0)"), "interp": ("double", lambda f: series.Interp(f[Q], [10, 20, 40], [0, 100, 50], -1), f"CASE WHEN {Q} < 10 THEN -1 WHEN {Q} > 40 THEN 50 WHEN {Q} < 20 THEN ({Q} - 10) * 10 ELSE 100 - ({Q} - 20) * 2.5 END"),
    "choose": ("string", lambda f: series.Choose(f["l_linenumber"], f["l_returnflag"], f["l_linestatus"], "third"), "CASE l_linenumber WHEN 0 THEN l_returnflag WHEN 1 THEN l_linestatus WHEN 2 THEN 'third' END"),
    "classify": ("string", lambda f: series.Classify(f[Q], [10, 20, 40], ["low", "mid"]), f"CASE WHEN {Q} > 10 AND {Q} <= 20 THEN 'low' WHEN {Q} > 20 AND {Q} <= 40 THEN 'mid' END"), "classify_open": ("string", lambda f: series.Classify(f[Q], [10, 20], ["low", "mid", "high"], right=False), f"CASE WHEN {Q} < 10 THEN 'low' WHEN {Q} < 20 THEN 'mid' ELSE 'high' END"),
    "classify_cols": ("string", lambda f: series.ClassifyFromColumns(f, D, [X], ["under", "over"]), f"CASE WHEN {D} > {X} THEN 'over' ELSE 'under' END"), "get": ("double", lambda f: f[P], P),
}
for _n, (_kind, _make, _sql) in BINARY.items():
    series_query(f"fld_{_n}", _kind, _make, _sql)


def _set(spark, sf_dir):
    f = items(spark, sf_dir)
    return f.set("net", f[P] * (f[D] * -1 + 1), "year", 2024).get_data(spark).select("fid", "net", "year")


table_query("fld_set", _set, f"SELECT fid, {P} * ({D} * -1 + 1) AS net, CAST(2024 AS INTEGER) AS year FROM items")


def _set_joined(spark, sf_dir):
    z, p = zones(spark, sf_dir), points(spark, sf_dir)
    return z.set("both", z["s_acctbal"] + p["c_acctbal"], "other", p["c_acctbal"]).get_data(spark).select("fid", F.round("both", 2).alias("both"), "other")


table_query("fld_set_joined", _set_joined, "SELECT z.fid, round(s_acctbal + c_acctbal, 2) AS both, c_acctbal AS other FROM zones z LEFT JOIN points p ON z.fid = p.fid")

# --- sinks ---


def _written_features(spark, sf_dir):
    from .sources.geometry import GeometryFileSource
    from .sources.sinks import scratch

    url = scratch(spark, "features")
    zones(spark, sf_dir).to_file(spark, url, fields={"name": "s_name", "balance": "s_acctbal", "id": "fid"})
    return GeometryFileSource(url, None, "id").get_data(spark, limit=math.inf).select("fid", "name", "balance", F.round(geo.area(F.col("geom")), 4).alias("area"))


table_query("snk_geometry_roundtrip", _written_features, "SELECT fid, s_name AS name, s_acctbal AS balance, round((x1 - x0) * (y1 - y0), 4) AS area FROM zones")


def _written_raster(spark, sf_dir):
    from .sources.raster import ParquetSource
    from .sources.sinks import scratch

    url = scratch(spark, "raster")
    ras_b(spark, sf_dir).to_file(spark, url, tile_size=4, start=T0, stop=T1)
    return ParquetSource(url).get_data(spark, start=T0, stop=T1).select("t", "i", "j", F.col("v").cast("long").alias("v"))


table_query("snk_raster_tiles", _written_raster, "SELECT CAST(t AS TIMESTAMP) AS t, i, j, v FROM b")


# --- views ---


def _json(spark, sf_dir):
    from .plans.block import Block

    a = _memory(spark, sf_dir)
    return Block.from_json(((a + 2) * a).to_json()).get_data(spark).select("i", "j", F.col("v").cast("bigint").alias("v"))


table_query("view_json", _json, "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(v AS BIGINT) AS v FROM (VALUES (0, 0, 3), (0, 1, 8), (1, 0, 15), (1, 1, NULL)) x(i, j, v)")


def flagship(spark, sf_dir):
    """Weekly totals of large values."""
    view = temporal.TemporalAggregate(misc.MaskBelow(ras_a(spark, sf_dir), 2000), "W", "sum")
    return view.get_data(spark, start=T0, stop=LATE).select("t", "i", "j", F.col("v").cast("bigint").alias("v"))


table_query("flagship", flagship, "SELECT date_trunc('week', t) + INTERVAL 6 DAY AS t, i, j, CAST(coalesce(sum(CASE WHEN v >= 2000 THEN v END), 0) AS BIGINT) AS v FROM a GROUP BY ALL")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
