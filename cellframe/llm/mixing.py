"""Mixing sources to target weights by Pareto order sampling. DataFrame operations only.

Each source gets a target in words. A document's expected copies are a preference of its size class (a long document is repeated
less readily than a short one) scaled so that the source's expected words equal its target, and never above the cap. Whole copies
are certain; the fractional part is the inclusion probability p of one more copy. Documents of a source are ranked by
(u / (1 - u)) / (p / (1 - p)), with u drawn from a hash of the document, and the first in rank get that copy as long as their words fit into what
the whole copies leave of the target: a sample of fixed size, in words, with unequal probabilities. What is then still missing is less than a document; of
the others the one nearest to it in size fills it, if that brings the source nearer to its target.

No source is ever sorted as a whole: ranks are cut into bins by value, bins are summed, and only the one bin of each source in
which the cut falls is put in order.

Defined results. A null or empty text has size 0 and taken 0. A null source is a source of its own, the last. Equal rows draw
alike; ties in rank go by doc_id, then size. An empty table gives an empty table. Columns of the input other than the id, text and
source are dropped, so clashing names cannot meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, lookup, row_back, whole_row, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BINS = 4096
#: Expected copies go with size to the power -1/4, by classes of a factor 2.
DAMPING = 0.25


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> the same with target. The budget (share of all sizes) is dealt by weight, weights repeating in the
    order of sources; a target stops at cap times its source's size and the excess goes to the others by weight, until none is above.

    A source is full if its cap per weight lies below the final level of budget per weight, so the full ones are a prefix in the order of
    cap per weight and the level follows from running sums; no loop is needed. Sources are few beside documents: their table is ordered in
    one task, with one row for each source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    one = Window.partitionBy(F.lit(0))
    rate = Window.orderBy("_rate", F.col("source").asc_nulls_last())
    before = rate.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    table = sizes.withColumn("_w", weight).withColumn("_total", F.sum("source_size").over(one)).withColumn("_rate", F.col("source_size") * F.lit(cap) / F.col("_w"))
    table = table.withColumn("_wsum", F.sum("_w").over(one)).withColumn("_left", F.col("_total") * F.lit(share) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0)))
    table = table.withColumn("_free", F.col("_wsum") - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # the level if exactly the sources before this one are full; it holds at the first that it doesn't fill
    level = F.min(F.when(F.col("_left") / F.col("_free") <= F.col("_rate"), F.struct("_rate", (F.col("_left") / F.col("_free")).alias("level")))).over(one)["level"]
    table = table.withColumn("_level", level)
    full = F.col("source_size") * F.lit(cap)
    return table.select("source", "source_size", F.when(F.col("_level").isNull(), full).otherwise(F.least(full, F.col("_level") * F.col("_w"))).alias("target"))


def expected_copies(classes: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, _class, _words, target) -> (source, _class, copies): copies = min(cap, c * preference), with c of each source such that expected words equal the target."""
    order = Window.partitionBy("source").orderBy("_class")
    down, up = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    t = classes.withColumn("_m", F.pow(F.lit(2.0), -DAMPING * F.col("_class")))
    c = (F.col("target") - cap * F.coalesce(F.sum("_words").over(down), F.lit(0))) / F.sum(F.col("_words") * F.col("_m")).over(up)
    t = t.withColumn("_c", F.when(F.col("target") > 0, c).otherwise(0.0))
    holds = F.min(F.when(F.col("_c") * F.col("_m") <= cap * (1 + 1e-12), F.struct("_class", "_c"))).over(Window.partitionBy("source"))["_c"]
    copies = F.when(holds.isNull(), cap).otherwise(F.least(F.lit(cap), holds * F.col("_m")))
    # rounding errors would make a certain copy a very likely one
    return t.select("source", "_class", F.when(F.abs(copies - F.round(copies)) < 1e-9, F.round(copies)).otherwise(copies).alias("_copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (int), taken (copies * size), and _hash (of the text) for joining texts back."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), u.alias("_u"), F.xxhash64(text).alias("_hash"))
    rows = written(rows.withColumn("_uid", F.monotonically_increasing_id()), "mix")
    rows = rows.withColumn("_class", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int"))

    classes = written(rows.groupBy("source", "_class").agg(F.sum("size").alias("_words")), "mix-classes")
    targets = written(source_targets(classes.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, cap), "mix-targets")
    plan = lookup(classes.filter("_words > 0"), targets, ["source"])
    plan = written(plan.select("source", "_class", "_words", "target").join(expected_copies(plan, cap).withColumnRenamed("source", "_s").withColumnRenamed("_class", "_k"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_k"))).drop("_s", "_k").withColumn("_whole", F.floor("_copies").cast("int")).withColumn("_p", F.col("_copies") - F.col("_whole")), "mix-plan")

    # what the whole copies leave of each target
    left = plan.groupBy("source").agg((F.first("target") - F.sum(F.col("_whole") * F.col("_words"))).alias("_need"))
    rows = lookup(rows, plan.select("source", "_class", "_whole", "_p"), ["source", "_class"])
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    ranked = rows.withColumn("_q", F.when((F.col("_p") > 1e-9) & (F.col("size") > 0), odds))
    ranked = ranked.withColumn("_bin", F.floor(F.col("_q") / (1 + F.col("_q")) * BINS).cast("int"))

    bins = ranked.filter("_bin is not null").groupBy("source", "_bin").agg(F.sum("size").alias("_words"))
    bins = bins.withColumn("_to", F.sum("_words").over(Window.partitionBy("source").orderBy("_bin")))
    cuts = lookup(bins, written(left, "mix-left"), ["source"])
    # the bin in which the cut falls, and the words that are still needed there; a source whose bins all fit has none
    cuts = cuts.groupBy("source").agg(F.min(F.when(F.col("_to") > F.col("_need"), F.struct("_bin", (F.col("_need") - F.col("_to") + F.col("_words")).alias("_rest")))).alias("_cut"), F.max("_need").alias("_need"))
    cuts = written(cuts.select("source", F.col("_cut._bin").alias("_cut"), F.col("_cut._rest").alias("_rest")), "mix-cuts")
    ranked = lookup(ranked, cuts, ["source"])
    order = Window.partitionBy("source").orderBy("_q", "doc_id", "size", "_uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranked.filter("_bin = _cut").withColumn("_to", F.sum("size").over(order)).withColumn("_extra", (F.col("_to") <= F.col("_rest")).cast("int"))
    gaps = inside.groupBy("source").agg((F.first("_rest") - F.coalesce(F.max(F.when(F.col("_extra") == 1, F.col("_to"))), F.lit(0))).alias("_gap"))
    outside = ranked.filter("_bin is null or _cut is null or _bin <> _cut").withColumn("_extra", F.when(F.col("_bin").isNull(), 0).when(F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut")), 1).otherwise(0))
    drawn = inside.drop("_to").unionByName(outside)
    # one more document where it brings the words nearer to the target
    others = lookup(drawn.filter("_extra = 0 and _bin is not null"), written(gaps, "mix-gaps"), ["source"])
    off = F.abs(F.col("size") - F.col("_gap"))
    fill = written(others.filter(off < F.col("_gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "_q", "_uid"))["_uid"].alias("_fill")), "mix-fill")
    drawn = lookup(drawn, fill, ["source"]).withColumn("_extra", F.col("_extra") + F.coalesce((F.col("_uid") == F.col("_fill")).cast("int"), F.lit(0)))
    out = lookup(drawn, targets, ["source"])
    copies = F.when(F.col("size") > 0, F.coalesce("_whole", F.lit(0)) + F.col("_extra")).otherwise(0).cast("int")
    return out.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "_hash")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mix takes it. Rows that repeat an id and text are one document: one of them is delivered, as often as all of them together are taken."""
    taken = mix(docs, **options).filter("copies > 0").groupBy(F.col("doc_id").alias("_id"), "_hash").agg(F.sum("copies").cast("int").alias("_copies"))
    taken = written(taken, "mix-taken")
    out = docs.select(whole_row(docs), F.col(options.get("doc_id", "doc_id")).alias("_i"), F.xxhash64(options.get("text", "text")).alias("_h"))
    again = written(out.groupBy("_i", "_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("_i").alias("_ri"), F.col("_h").alias("_rh")), "mix-repeats")
    if not again.isEmpty():
        repeats = F.col("_i").eqNullSafe(F.col("_ri")) & (F.col("_h") == F.col("_rh"))
        one = out.join(again, repeats, "left_semi").groupBy("_i", "_h").agg(F.first("_row").alias("_row"))
        out = out.join(again, repeats, "left_anti").select("_row", "_i", "_h").unionByName(one)
    out = out.join(taken, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*row_back(docs.columns))


def op3_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


#: The same in DuckDB's SQL, by windows over whole sources.
OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
    (('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
c AS (SELECT *, CAST(floor(log2(greatest(size, 1))) AS INT) AS k FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w
  FROM c GROUP BY source),
lv AS (
  SELECT *, source_size * 2.0 / w AS rate,
    (sum(source_size) OVER () * 1.5 - coalesce(sum(source_size * 2.0) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY source_size * 2.0 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT min_by(level, rate) FILTER (WHERE level <= rate) AS level FROM lv),
t AS (
  SELECT source, source_size, CASE WHEN final.level IS NULL THEN source_size * 2.0 ELSE least(source_size * 2.0, final.level * w) END AS target
  FROM lv, final),
cl AS (
  SELECT c.source, k, sum(size) AS words, any_value(target) AS target, pow(2.0, -0.25 * k) AS m
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source GROUP BY c.source, k HAVING sum(size) > 0),
cc AS (
  SELECT *, CASE WHEN target > 0 THEN (target - 2.0 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(words * m) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE 0 END AS c
  FROM cl),
ch AS (SELECT source, min_by(c, k) FILTER (WHERE c * m <= 2.0 * (1 + 1e-12)) AS c FROM cc GROUP BY source),
e AS (
  SELECT cc.source, cc.k, words, target, CASE WHEN ch.c IS NULL THEN 2.0 ELSE least(2.0, ch.c * m) END AS raw
  FROM cc JOIN ch ON cc.source IS NOT DISTINCT FROM ch.source),
p AS (
  SELECT *, floor(copies) AS whole, copies - floor(copies) AS p
  FROM (SELECT *, CASE WHEN abs(raw - round(raw)) < 1e-9 THEN round(raw) ELSE raw END AS copies FROM e)),
need AS (SELECT source, any_value(target) - sum(whole * words) AS need FROM p GROUP BY source),
q AS (
  SELECT c.doc_id, c.source, size, coalesce(whole, 0) AS whole, CASE WHEN p > 1e-9 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, need
  FROM c LEFT JOIN p ON c.source IS NOT DISTINCT FROM p.source AND c.k = p.k LEFT JOIN need n ON c.source IS NOT DISTINCT FROM n.source),
r AS (
  SELECT *, CASE WHEN q IS NOT NULL AND sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) <= need THEN 1 ELSE 0 END AS extra
  FROM q),
g AS (SELECT *, need - coalesce(sum(size * extra) OVER (PARTITION BY source), 0) AS gap FROM r),
f AS (
  SELECT *, row_number() OVER (PARTITION BY source, extra = 0 AND q IS NOT NULL AND abs(size - gap) < gap ORDER BY abs(size - gap), q) AS n
  FROM g)
SELECT f.doc_id, CAST(size AS BIGINT) AS size, t.source_size, CAST(t.target AS DOUBLE) AS target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE size * (whole + extra + CASE WHEN extra = 0 AND q IS NOT NULL AND abs(size - gap) < gap AND n = 1 THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source
"""
