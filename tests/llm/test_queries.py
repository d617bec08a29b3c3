"""The registered queries themselves: against their SQL, held-out rows, and what may not leak into a prediction."""

import math
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.llm import forest, langid, mixing, quality
from cellframe.llm.queries import ORACLE_SQL, QUERIES

from .conftest import words

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "op1_token_counts": {"doc_id", "tokens"}, "op2_langid": {"doc_id", "held_out", "lang_pred", "score"}, "op3_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op4_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}, "op5_line_dedup": {"doc_id", "text", "n_deleted"},
    "op6_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op7_simhash": {"doc_id", "fingerprint", "component_id"},
    "op8_quality": {"doc_id", "held_out", "score", "predicted"}, "op9_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"}, "op10_nearest": {"query_id", "rank", "vec_id", "score"},
}


def same(found):
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in found), key=str)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(ORACLE_SQL[name]).columns)
    assert same(df.select(*columns).collect()) == same(con.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_row_has_its_columns(spark, name):
    df = QUERIES[name](spark, DATA)
    assert COLUMNS[name] <= set(df.columns)
    key = {"op9_embedding_dedup": "vec_id", "op10_nearest": "query_id"}.get(name, "doc_id")
    table = "embeddings" if name in ("op9_embedding_dedup", "op10_nearest") else "documents"
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select("vec_id" if table == "embeddings" else "doc_id").collect()}
    got = df.collect()
    assert {r[key] for r in got} == ({i for i in ids if i % 50 == 0} if name == "op10_nearest" else ids)
    if name in ("op2_langid", "op8_quality"):
        by, rest = (5, 0) if name == "op2_langid" else (4, 2)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % by == rest) and 0 <= r["score"] <= 1 for r in got)


@needs_data
def test_held_out_rows_teach_nothing(spark, tmp_path):
    """Other languages and labels of held-out rows change no prediction, nor does a shuffled source."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs.withColumn("lang", F.when(crc % 5 == 0, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels.withColumn("quality", F.when(crc % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality"))).coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op2_langid", "op8_quality"):
        assert same(QUERIES[name](spark, DATA).collect()) == same(QUERIES[name](spark, str(tmp_path)).collect())


def plain_ftrl(rows, labels, buckets, epochs, alpha, beta, l1, l2):
    """One coordinate at a time, in dicts; the bias is coordinate `buckets` and isn't shrunk."""
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if i == buckets:
            return -zi * alpha / (beta + math.sqrt(ni))
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(ni)) / alpha + l2)

    for _ in range(epochs):
        for x, y in zip(rows, labels):
            x = x | {buckets: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_is_brute_force(spark):
    texts = [words(3 + k % 17, k, "abc") for k in range(60)] + ["", "a a B b 12 | \n"]
    labels = np.array([(k * 7) % 3 > 0 for k in range(62)], dtype=float)
    found = [quality.features(t, 256) for t in texts]
    got = quality.train(found, labels, 256, 3)
    expected = plain_ftrl([dict(zip(a.tolist(), v.astype(float).tolist())) for a, v in found], labels, 256, 3, quality.ALPHA, quality.BETA, quality.L1, quality.L2)
    assert [got[i] for i in range(257)] == pytest.approx([expected.get(i, 0.0) for i in range(257)], abs=1e-9)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    scores = {r["text"]: r["score"] for r in quality.score(df, got).collect()}
    w = got.astype(np.float32).astype(float)
    for t, (a, v) in zip(texts, found):
        assert scores[t] == pytest.approx(1 / (1 + math.exp(-(sum(w[i] * x for i, x in zip(a, v)) + w[256]))), abs=1e-9)


def test_repeated_ids_teach_alike(spark):
    rows = [(k % 20, words(20, k, "abcdef" if k % 2 else "efghij")) for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    fit = lambda part: quality.fit(spark.createDataFrame(part, "doc_id long, text string").repartition(5), labels)
    assert np.array_equal(fit(rows), fit(rows[::-1]))


def test_language_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "the cat", "x", "y", 3, "z")], "doc_id long, text string, _found string, _new string, score int, _row string")
    out = langid.identify(df, {"en": langid.top("the cat sat").tolist()})
    assert out.columns == ["doc_id", "text", "_found", "_new", "_row", "lang_pred", "score"]
    r = out.first()
    assert (r["_found"], r["_new"], r["_row"], r["lang_pred"]) == ("x", "y", "z", "en")


def test_repeated_rows_are_mixed_once(spark):
    """Equal rows are delivered as often as the mix takes them, in all."""
    rows = [(7, "four words of it", "a")] * 1000 + [(k, words(40, k), "b") for k in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(df).filter("source = 'a'").agg(F.sum("taken")).first()[0]
    out = mixing.mixed_texts(df)
    assert out.filter("source = 'a'").count() * 4 == taken and {tuple(r) for r in out.filter("source = 'a'").collect()} == {rows[0]}


def test_neighbours_of_a_repeated_id(spark):
    """Twelve vectors under one id are no reason to find fewer than five others."""
    r = np.random.default_rng(4)
    rows = [(50, r.normal(size=4).tolist()) for _ in range(12)] + [(k, r.normal(size=4).tolist()) for k in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.search(df, df.filter("vec_id % 50 = 0")).collect()
    assert len(got) == 60 and all(g["vec_id"] < 9 for g in got)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = sorted(round(float(s), 9) for _, q in rows[:12] for s in sorted((unit(q) @ unit(v) for _, v in rows[12:]), reverse=True)[:5])
    assert sorted(round(g["score"], 9) for g in got) == pytest.approx(want)
