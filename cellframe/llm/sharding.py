"""Sharding by sampled splitters. DataFrame operations only.

Groups of equal texts stay together. Those that hold over BIG of a shard are few, at most shards / BIG: the largest first, each goes whole to the shard that has most room
left. One that fits nowhere has to be divided, and goes with the rest.

The rest is in the order of a hash of the text, then a hash of the id: equal texts are neighbours. A size-weighted sample of text hashes gives
quantile boundaries that cut this order into many ranges; texts of large groups are taken out of them and subdivided at the hashes of ids, so no range is overfull.
Records are put in order range by range, never as a whole: running bytes inside a range plus the bytes of all ranges before give each record's
place, and the shard is the one in whose remaining room that place falls; a small group goes where its middle falls. The sample
decides how the work is dealt, not the result.

The law is `bytes`: shards differ by about one record, or one small group, in size, if the groups leave room for that.

Defined results. A null text has size 1 and crc32 of nothing (0), like an empty one. A null id counts as an empty one. Repeated rows are told
apart by their place in the input. An empty table gives an empty table. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, lookup, written

#: Ranges at least and at most; between, about RANGE_ROWS rows make one. The sample has about PER_RANGE keys for each.
RANGES, MOST_RANGES, RANGE_ROWS = 512, 4096, 2_000_000
PER_RANGE = 24
#: A group of equal texts with over this part of a shard is placed on its own, before all others.
BIG = 0.001


def _hash(c: Column) -> Column:
    """60 bits of MD5, as SQL engines have it too."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")


def range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are <= key, by two steps over short arrays."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    coarse = F.array(*(F.lit(x) for x in splitters[step - 1 :: step]))
    fine = F.array(*(F.lit(x) for x in splitters))
    first = F.size(F.filter(coarse, lambda s: s <= key)) * step
    return first + F.size(F.filter(F.slice(fine, first + 1, step), lambda s: s <= key))


def splitters_of(rows: DataFrame, ranges: int, total: int) -> list[int]:
    """Boundaries of ranges of about equal bytes from a size-weighted sample of keys; the sample's size doesn't grow with the input."""
    if not total:
        return []
    draw = F.col("_h").cast("double") / F.lit(float(1 << 60))
    # a record of s bytes is drawn s * rate times on average
    hits = F.floor(F.col("size") * (ranges * PER_RANGE / total) + draw)
    sample = rows.select("_key", hits.alias("_n")).filter("_n > 0").groupBy("_key").agg(F.sum("_n").alias("_n"))
    at = [k / ranges for k in range(1, ranges)]
    found = sample.agg(F.percentile("_key", F.array(*(F.lit(x) for x in at)), F.col("_n").cast("int")).alias("at")).first()["at"]
    return sorted({int(x) for x in found or []})


def place_groups(groups: DataFrame, shards: int, room: float) -> DataFrame:
    """One row: left (the room left in each shard) and placed, structs of _key, _big (0 for the largest) and _own (the shard, -1 if it fits in none).

    groups has _key and _bytes, and at most shards / BIG rows."""
    some = groups.agg(F.array_sort(F.collect_list(F.struct((-F.col("_bytes")).alias("less"), F.col("_key").alias("_key")))).alias("_all"))

    def step(state, group):
        most = F.array_max(state["left"])
        at = F.when(most + group["less"] >= 0, F.array_position(state["left"], most) - 1).otherwise(F.lit(-1).cast("long"))
        left = F.transform(state["left"], lambda x, k: F.when(k == at, x + group["less"]).otherwise(x))
        return F.struct(left.alias("left"), F.concat(state["own"], F.array(at)).alias("own"))

    start = F.struct(F.array_repeat(F.lit(float(room)), shards).alias("left"), F.array().cast("array<long>").alias("own"))
    done = some.select("_all", F.aggregate("_all", start, step).alias("_done"))
    placed = F.transform(F.arrays_zip("_all", F.col("_done.own").alias("own")), lambda x, k: F.struct(x["_all"]["_key"].alias("_key"), k.alias("_big"), x["own"].cast("int").alias("_own"), (-x["_all"]["less"]).alias("_bytes")))
    return done.select(F.col("_done.left").alias("left"), placed.alias("placed"))


def shard(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, and _key, the hash of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), _hash(body).alias("_key"), _hash(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("_h"))
    rows = written(rows.withColumn("_uid", F.monotonically_increasing_id()), "shard")
    total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total, room = total or 0, (total or 0) / shards
    ranges = ranges or min(MOST_RANGES, max(RANGES, count // RANGE_ROWS))

    big = rows.groupBy("_key").agg(F.sum("size").alias("_bytes")).filter(F.col("_bytes") > BIG * room)
    big = written(place_groups(big, shards, room), "shard-big")
    left = big.first()["left"]
    big = big.select(F.explode("placed").alias("p")).select("p._key", "p._big", "p._own", F.ceil(F.col("p._bytes") * ranges / max(total, 1)).cast("int").alias("_parts"))
    # large groups are cells of their own, before all ranges
    rows = lookup(rows, written(big, "shard-groups"), ["_key"])
    rows = rows.withColumn("_range", F.coalesce(F.col("_big") - (1 << 30), range_of(F.col("_key"), splitters_of(rows, ranges, total))).cast("int"))
    rows = rows.withColumn("_part", F.coalesce(F.floor(F.col("_h").cast("double") / F.lit(float(1 << 60)) * F.col("_parts")), F.lit(0)).cast("int"))
    rows = rows.withColumn("_own", F.coalesce("_own", F.lit(-1))).withColumn("_bytes", F.when(F.col("_own") < 0, F.col("size")).otherwise(F.lit(0).cast("long")))

    cell = Window.partitionBy("_range", "_part").orderBy("_key", "_h", F.col("doc_id").asc_nulls_first(), "_uid")
    group = Window.partitionBy("_range", "_part", "_key")
    rows = rows.withColumn("_rank", F.row_number().over(cell)).withColumn("_before", F.sum("_bytes").over(cell) - F.col("_bytes"))
    rows = rows.withColumn("_group", F.sum("_bytes").over(group)).withColumn("_first", F.min("_before").over(group))
    rows = written(rows, "shard-order")
    order = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each cell, of which there are a bounded number
    cells = rows.groupBy("_range", "_part").agg(F.sum("_bytes").alias("_bytes"))
    cells = cells.select("_range", "_part", F.coalesce(F.sum("_bytes").over(order), F.lit(0)).alias("_offset"))
    rows = lookup(rows, written(cells, "shard-cells"), ["_range", "_part"])
    place = F.col("_offset") + F.when(F.col("_big").isNull(), F.col("_first") + F.col("_group") / 2).otherwise(F.col("_before") + F.col("size") / 2)
    bounds = F.array(*(F.lit(sum(left[: k + 1])) for k in range(shards)))
    among = F.least(F.lit(shards - 1), F.size(F.filter(bounds, lambda b: b <= place)))
    rows = rows.withColumn("shard", F.when(F.col("_own") >= 0, F.col("_own")).otherwise(among).cast("int"))
    # slots are counted inside cells, after those of the cells before
    per = rows.groupBy("shard", "_range", "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("shard").orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("shard", "_range", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    rows = lookup(rows, written(per, "shard-slots"), ["shard", "_range", "_part"])
    slot = F.col("_ahead") + F.row_number().over(Window.partitionBy("_range", "_part", "shard").orderBy("_rank")) - 1
    return rows.select("doc_id", "size", "text_crc32", "shard", slot.cast("long").alias("slot"), "_key")


def op6_sharding(spark, sf_dir):
    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same in DuckDB's SQL, by one order over all rows.
OP6_SQL = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce(text, '') AS body,
    ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
a AS (SELECT sum(size) AS total, sum(size) / 8 AS room FROM d),
g AS (SELECT k, bytes, row_number() OVER (ORDER BY bytes DESC, k) AS n FROM (SELECT k, sum(size) AS bytes FROM d GROUP BY k) x, a WHERE bytes > 0.001 * room),
w AS (
  SELECT CAST(0 AS BIGINT) AS n, [room, room, room, room, room, room, room, room] AS room, CAST(0 AS BIGINT) AS own FROM a
  UNION ALL
  SELECT g.n, CASE WHEN list_max(room) >= bytes THEN list_transform(room, lambda x, i: CASE WHEN i = list_position(room, list_max(room)) THEN x - bytes ELSE x END) ELSE room END,
    CASE WHEN list_max(room) >= bytes THEN list_position(room, list_max(room)) ELSE 0 END
  FROM w JOIN g ON g.n = w.n + 1),
b AS (SELECT list_transform(range(1, 9), lambda i: list_sum(room[1:i])) AS bounds FROM w ORDER BY n DESC LIMIT 1),
o AS (
  SELECT d.*, g.n, coalesce(w.own, 0) AS own, CASE WHEN coalesce(w.own, 0) = 0 THEN size ELSE 0 END AS bytes, row_number() OVER (ORDER BY coalesce(g.n, 1000000000), d.k, h, doc_id) AS place
  FROM d LEFT JOIN g ON g.k = d.k LEFT JOIN w ON w.n = g.n),
p AS (SELECT *, sum(bytes) OVER (ORDER BY place) - bytes AS before, sum(bytes) OVER (PARTITION BY k) AS grp FROM o),
q AS (SELECT *, CASE WHEN n IS NULL THEN min(before) OVER (PARTITION BY k) + grp / 2 ELSE before + size / 2 END AS middle FROM p),
s AS (SELECT *, CAST(CASE WHEN own > 0 THEN own - 1 ELSE least(7, len(list_filter(bounds, lambda x: x <= middle))) END AS INTEGER) AS shard FROM q, b)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(regexp_replace(hex(encode(body)), '(..)', '\\1,', 'g'), ',')[:-2], lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32,
  'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s, tab
"""
