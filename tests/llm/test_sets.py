"""Mixing, line dedup, sharding, near-duplicates, neighbours and the pipeline against plain versions, on odd rows and with a hot group."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cellframe.llm import common, forest, hnsw, linededup, minhash, mixing, sharding, simhash
from cellframe.llm.common import lookup, written
from cellframe.llm.components import components

from .conftest import words


def size_of(text):
    return len((text or "").encode().split())


# --- mixing ---


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Water filling by loop."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{k}" if k else None: r.choice([0, 1, 5, 50, 1000, 3]) for k in range(8)}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame([*sizes.items()], "source string, source_size long")).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix(spark, odd, none):
    rows = [(k, " ".join(["w"] * random.Random(k).randint(1, 90)), "hot" if k % 3 else f"s{k % 5}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 600
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 5
        assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] % r["size"] == 0 for r in mine)
        assert all(r["source_size"] == sum(x["size"] for x in mine) for r in mine)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns and texts.count() == sum(r["copies"] for r in got)
    out = mixing.mix(odd)
    assert out.count() == odd.count() and {r["size"] for r in out.filter("doc_id in (1, 2, 3)").collect()} == {0}
    assert mixing.mixed_texts(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed_texts(none).count() == 0


def test_inclusion_follows_size(spark):
    """Small documents are likelier to be repeated than long ones of the same source."""
    rows = [(k, " ".join(["w"] * (4 if k % 2 else 256)), "z") for k in range(4000)] + [(9999, " ".join(["w"] * 520_000), "b")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("source = 'z'")
    small, long = (out.filter(f"size = {n}").agg(F.avg("copies")).first()[0] for n in (4, 256))
    assert small > long


# --- line dedup ---


def plain_lines(text):
    """Lines by walking over the words: (line, white space after it)."""
    out, line = [], ""
    for word, space in re.findall(r"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)", text):
        line += word
        if word[-1] in ".!?" or set(space) - set(" \t") or len(line.split()) == linededup.LINE_WORDS:
            out.append((line, space))
            line = ""
        else:
            line += space
    return out + ([(line.rstrip(" \t"), line[len(line.rstrip(" \t")) :])] if line else [])


def plain_dedup(docs, least=20, run=3):
    """Every run of lines is held against all earlier places."""
    docs = sorted({(d, t) for d, t in docs if t}, key=lambda x: (x[0] is not None, x[0] or 0, np.uint64(xxhash.xxh64_intdigest(x[1], 42)).astype(np.int64)))
    earlier, out = set(), {}
    for d, t in docs:
        lines = plain_lines(t)
        hit = [False] * len(lines)
        for i in range(len(lines) - run + 1):
            piece = tuple(x for x, _ in lines[i : i + run])
            if piece in earlier:
                hit[i : i + run] = [True] * run
            earlier.add(piece)
        i, kept, gone = 0, t[: len(t) - len(t.lstrip(" \t\n\v\f\r"))], False
        while i < len(lines):
            j = i
            while j < len(lines) and hit[j] == hit[i]:
                j += 1
            body = "".join(x + y for x, y in lines[i:j])
            go = hit[i] and size_of(body) >= least
            gone |= go
            kept += "" if go else body
            i = j
        out[d, t] = kept if gone else t
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_is_brute_force(spark, seed):
    r = random.Random(seed)
    end = lambda: r.choice([" ", ". ", "! ", "?\n", "\n", "\n\n", "\t", " . "])
    pool = [words(r.choice([1, 2, 5, 9, 30]), k) for k in range(14)]
    passages = ["".join(r.choice(pool) + end() for _ in range(r.randint(3, 9))) for _ in range(5)]
    docs = []
    for d in range(40):
        text = [words(r.randint(1, 40), 1000 * d + k) + end() for k in range(r.randint(0, 5))]
        for _ in range(r.randint(0, 3)):
            # whole, or cut out of the middle
            p = r.choice(passages).split(" ")
            at = r.randint(0, len(text))
            text[at:at] = [" ".join(p if r.random() < 0.5 else p[r.randint(0, 6) : -r.randint(1, 6)]) + end()]
        docs.append((d, r.choice(["", " ", "\n"]) + "".join(text)))
    docs += [(100 + k, docs[3][1]) for k in range(5)] + [(200, "\n".join(["again and again"] * 60)), (201, "x " * 100), (7, docs[8][1])]
    got = {(x["doc_id"], x["was"]): x["text"] for x in linededup.dedup_lines(spark.createDataFrame([(d, t, t) for d, t in docs], "doc_id long, text string, was string")).collect()}
    expected = plain_dedup(docs)
    assert got == {(d, t): expected.get((d, t), t) for d, t in docs}
    assert sum(a != b for (_, a), b in expected.items()) > 10


def test_passages_go_and_clean_texts_stay(spark):
    sentences = [words(9, 70 + k).capitalize() + "." for k in range(6)]
    passage = " ".join(sentences)
    docs = [(k, words(30, k) + " " + passage + " " + words(30, 500 + k)) for k in range(20)] + [(100 + k, words(80, 900 + k) + "\nAll rights reserved.") for k in range(5)]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), counts=True).collect()}
    assert passage in got[0]["text"] and not any(sentences[2] in got[k]["text"] for k in range(1, 20))
    assert all(got[k]["n_deleted"] >= 40 and got[k]["text"].startswith(words(24, k)[:50]) for k in range(1, 20)) and all(got[d]["text"] == t for d, t in docs[20:])


def test_every_earlier_copy_counts(spark):
    """The tail of a run is found though the first document that holds its head goes on otherwise."""
    head, tail = "\n".join(words(12, k) for k in range(5)), words(5, 60)
    docs = [(1, head + "\nother end"), (2, head + "\n" + tail), (3, head + "\n" + tail), (4, words(7, 61) + "\n" + head + "\nother end")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: tail, 3: "", 4: words(7, 61) + "\n"}


def test_line_dedup_hot_keys(spark, monkeypatch):
    """Frequent keys take the broadcast path; the result is the same."""
    docs = [(k, words(30, 3) + ". " + words(40, 100 + k % 9) + ". " + words(30, 4)) for k in range(60)]
    want = plain_dedup(docs)
    monkeypatch.setattr(common, "HOT", 8)
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    got = {(r["doc_id"], r["was"]): r["text"] for r in linededup.dedup_lines(spark.createDataFrame([(d, t, t) for d, t in docs], "doc_id long, text string, was string")).collect()}
    assert got == want


def test_line_dedup_odd(spark, odd, none):
    out = linededup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    got = out.select("doc_id", "text").collect()
    assert [r["text"] for r in got if r["doc_id"] == 1] == [None] and [r["text"] for r in got if r["doc_id"] == 3] == [" \t\n "]
    # equal texts under two ids: the first stays, both of its rows
    assert [len(r["text"]) > 0 for r in got if r["doc_id"] == 5] == [True, True] and [r["text"] for r in got if r["doc_id"] == 6] == [""]
    assert [r["text"] for r in got if r["doc_id"] == 10] == [words(5, 6)]
    assert linededup.dedup_lines(none).count() == 0


# --- sharding ---


def plain_shards(docs, shards=8):
    import hashlib

    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    rows = sorted((h(t or ""), h("" if d is None else str(d)), d, len((t or "").encode()) + 1) for d, t in docs)
    total, group = sum(r[3] for r in rows), {}
    for r in rows:
        group[r[0]] = group.get(r[0], 0) + r[3]
    # large groups first, each to the emptiest shard, whole if it fits
    room, own, order = [total / shards] * shards, {}, {}
    for key, size in sorted(group.items(), key=lambda x: (-x[1], x[0])):
        if size > 0.001 * total / shards:
            order[key] = len(order)
            s = room.index(max(room))
            if room[s] >= size:
                own[key] = s
                room[s] -= size
    rows.sort(key=lambda r: (order.get(r[0], 1 << 40), r))
    before, first, out, slots = 0, {}, [], {}
    for r in rows:
        first.setdefault(r[0], before)
        before += 0 if r[0] in own else r[3]
    before = 0
    for k, _, d, size in rows:
        if k in own:
            s = own[k]
        else:
            place = before + size / 2 if k in order else first[k] + group[k] / 2
            s = min(shards - 1, sum(sum(room[: i + 1]) <= place for i in range(shards)))
            before += size
        slots[s] = slots.get(s, -1) + 1
        out.append((d, size, s, slots[s]))
    return out


def test_shards_are_brute_force_with_a_hot_group(spark):
    docs = [(k, words(random.Random(k).randint(0, 200), k)) for k in range(600)] + [(1000 + k, "the same text") for k in range(7000)] + [(9000 + k, words(30, 50)) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sharding.shard(df).collect()
    assert sorted((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in got) == sorted(plain_shards(docs))
    assert all(r["text_crc32"] == zlib.crc32(dict(docs)[r["doc_id"]].encode()) for r in got)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8
    # only the group that fits in no shard is divided
    where = {}
    for r in got:
        where.setdefault(dict(docs)[r["doc_id"]], set()).add(r["shard"])
    assert {t for t, s in where.items() if len(s) > 1} == {"the same text"}
    few = sharding.shard(df, shards=3, ranges=16).collect()
    assert sorted((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in few) == sorted(plain_shards(docs, 3))


def test_shards_odd(spark, odd, none):
    got = sharding.shard(odd).collect()
    assert len(got) == odd.count() and sum(r["size"] for r in got if r["doc_id"] == 1) == 1
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == [*range(sum(r["shard"] == s for r in got))]
    assert sharding.shard(none).count() == 0


def test_range_of(spark):
    splitters = sorted(random.Random(1).sample(range(1000), 37))
    df = spark.range(1000).select("id", sharding.range_of(F.col("id"), splitters).alias("r"))
    assert all(r["r"] == sum(s <= r["id"] for s in splitters) for r in df.collect())


# --- near-duplicates ---


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr("cellframe.llm.components.ONE_TASK", one_task)
    _components(spark)


def _components(spark):
    r = random.Random(5)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(100)] + [(5000, 5000 + k) for k in range(1, 200)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_golay_code():
    w = simhash.codewords()
    assert min(bin(int(x)).count("1") for x in w[1:]) == 7 and len(set(w.tolist())) == 4096
    assert (simhash.quotient(w) == np.arange(4096)).all() and not simhash.syndrome(w).any()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 23, 2000)
    for flips in range(3):
        b = a.copy()
        for k in range(len(b)):
            for bit in rng.choice(23, flips, replace=False):
                b[k] ^= 1 << int(bit)
        x, y = simhash.golay_indices(a), simhash.golay_indices(b)
        assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist()))
    for k in range(50):
        near = {i for i, c in enumerate(w.tolist()) if bin(c ^ int(a[k])).count("1") <= 4}
        assert set(simhash.golay_indices(a[k : k + 1])[0].tolist()) == near


def plain_fingerprint(text):
    import xxhash

    w = [x.decode() for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints():
    for text in [None, "", " \t", "One", "a b", "a b c", "A  b\nC d", "É é ß", words(400, 3), "x " * 70_000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def plain_components(found):
    """{fingerprint: smallest id} by comparing all pairs."""
    prints = sorted({f for _, f in found})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    low = {}
    for d, f in found:
        if d is not None:
            low[find(f)] = min(d, low.get(find(f), d))
    return {f: low.get(find(f)) for f in prints}


def test_links_in_hot_buckets(spark):
    """Many fingerprints around one centre make buckets too large for pairs; others are scattered."""
    r = random.Random(2)
    centre = r.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(400)} | {r.getrandbits(64) for _ in range(200)}
    for f in [*prints][:80]:
        prints.add(f ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
    signed = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(sorted(prints))]
    nodes = written(spark.createDataFrame([(f,) for _, f in signed], "fp long"), "test")
    of = {x["node"]: x["component"] for x in components(simhash.links(nodes)).collect()}
    expected = plain_components([(k, f % (1 << 64)) for k, f in signed])
    groups = {}
    for _, f in signed:
        groups.setdefault(of.get(f, f), set()).add(expected[f % (1 << 64)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected.values()))


def test_large_ids_beside_nulls(spark):
    """Ids over 2**53 are exact even where others are null."""
    from cellframe.llm import packing, token_counts

    ids = [2**53 + 1, None, -(2**62) - 1]
    df = spark.createDataFrame([(d, f"text {k}") for k, d in enumerate(ids)], "doc_id long, text string")
    for out in (simhash.near_duplicates(df), packing.pack(df), token_counts.token_counts(df)):
        assert sorted([r["doc_id"] for r in out.collect()], key=repr) == sorted(ids, key=repr)


def test_near_duplicates_odd(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = [(d, plain_fingerprint(t)) for d, t in texts]
    expected = plain_components(found)
    assert sorted((repr(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in got) == sorted((repr(d), f, expected[f]) for d, f in found)
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns and kept.count() == len({expected[f] if expected[f] is not None else f"f{f}" for _, f in found})
    assert simhash.near_duplicates(none).count() == 0 and simhash.representatives(none).count() == 0


# --- vectors ---


def vectors(n, dim, seed, copies=0, near=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x = np.concatenate((x, np.repeat(x[:1], copies, axis=0), x[1:2] + 0.005 * rng.normal(size=(near, dim))))
    return x.astype(np.float32)


ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [1.0] * 15 + [None], 1), (9004, [1.0] * 15 + [float("nan")], 1), (9005, [1.0] * 15 + [float("inf")], 1), (9006, [1.0] * 16, None), (9007, [], 1), (9008, [1.0] * 8, 1), (None, [1.0] * 16, 1), (9010, [1e30] * 16, 1), (9010, [1e-30] * 16, 1)]


@pytest.mark.parametrize("shard,block", [(8192, 2048), (200, 90)])
def test_embedding_links_are_brute_force(spark, shard, block):
    x = vectors(700, 16, 3, copies=60, near=150)
    rows = [(k, v.tolist(), k % 2 if k < 700 else 0) for k, v in enumerate(x)] + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).withColumn("node", F.lit(2))
    got = hnsw.near_duplicates(df, shard=shard, block=block).collect()
    ok = [(d, np.array(v, float), lab) for d, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    n, comp = {}, {}
    parent = [*range(len(ok))]

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    unit = [(v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for _, v, _ in ok]
    for i in range(len(ok)):
        for j in range(i):
            if ok[i][2] == ok[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                n[i], n[j] = n.get(i, 0) + 1, n.get(j, 0) + 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    for i, (d, _, _) in enumerate(ok):
        if d is not None:
            comp[find(i)] = min(d, comp.get(find(i), d))
    expected = {(d, n.get(i, 0), comp.get(find(i)) if d is not None else None) for i, (d, _, _) in enumerate(ok)}
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got if (r["vec_id"], r["n_links"]) != (r["component_id"], 0) or r["vec_id"] in {d for d, _, _ in ok}} >= expected - {(None, 2, None)}
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] in (9001, 9002, 9003, 9004, 9005, 9006, 9007, 9008):
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True)
        assert r["vec_id"] is None or r["kept"] == (r["vec_id"] == r["component_id"])


def test_embedding_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hnsw.near_duplicates(none).count() == 0 and forest.search(none, none).count() == 0


def test_graph_recall_and_storage():
    x = hnsw.unit(vectors(1500, 24, 4).astype(float))
    g = hnsw.Graph(x)
    again = hnsw.Graph.load(g.dump(), x)
    q = x[::10]
    ids, _ = again.search(q, 64)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :5]
    recall = np.mean([len(set(a[:5]) & set(b)) / 5 for a, b in zip(ids.tolist(), truth.tolist())])
    assert recall > 0.9 and (ids[:, 0] == np.arange(0, 1500, 10)).all()
    for n in (1, 2, 5):
        assert (hnsw.Graph(x[:n]).search(x[:n], 3)[0][:, 0] == np.arange(n)).all()


def test_neighbours_recall(spark):
    x = vectors(1500, 16, 6, copies=200)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("ids", F.lit(1)).withColumn("block", F.lit(1))
    got = {}
    for r in forest.search(df, df.filter("vec_id % 50 = 0"), block=400, query_block=9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    u = hnsw.unit(x.astype(float))
    hits = total = 0
    for q in range(0, len(x), 50):
        s = u @ u[q]
        s[q] = -9
        order = sorted(range(len(x)), key=lambda k: (-round(s[k], 12), k))[:5]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and q not in [m[1] for m in mine]
        assert all(abs(m[2] - s[m[1]]) < 1e-9 for m in mine if m[1] < len(x)) and [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        hits += len({m[1] for m in mine} & set(order))
        total += 5
    assert hits / total >= 0.9
    # the hot vector's copies: ties to smaller ids
    assert [m[1] for m in sorted(got[0])] == [1500, 1501, 1502, 1503, 1504]
    assert not {9001, 9002, 9003, 9004, 9005, 9007, 9008} & {m[1] for ms in got.values() for m in ms}


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], round(r["score"], 6)) for r in forest.search(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1, 0.707107), (2, 2, 0.0)]


def test_prefixes_are_brute_force():
    x = hnsw.unit(vectors(300, 8, 9).astype(float))
    f = forest.Forest.load(forest.Forest(x, trees=3, bits=20).dump())
    h = forest.strings(x, 3, 20)
    q = hnsw.unit(vectors(10, 8, 10).astype(float))
    hq = forest.strings(q, 3, 20)
    for k, rows in enumerate(f.candidates(q, 40)):
        same = [[20 - int(int(a) ^ int(b)).bit_length() for a in h[t]] for t, b in enumerate(hq[:, k])]
        depth = max(d for d in range(21) if sum(s >= d for tree in same for s in tree) >= 40)
        assert rows.tolist() == sorted({i for tree in same for i, s in enumerate(tree) if s >= depth})


# --- near-duplicates of the pipeline ---


def edited(text, edits, seed):
    r, out = random.Random(seed), text.split()
    for k in r.sample(range(len(out)), edits):
        out[k] = f"edit{seed}x{k}"
    return " ".join(out)


def similar_components(texts, similarity=0.8):
    """The smallest index that links reach, by all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    of = [*range(len(sets))]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if of[i] != of[j] and len(a & b) >= similarity * len(a | b):
                x, y = sorted((of[i], of[j]))
                of = [x if k == y else k for k in of]
    return of


def test_near_dedup_stage_finds_edited_copies(spark):
    bases = [words(200, 1000 + k) for k in range(30)]
    texts = bases + [edited(b, 1 + k % 12, k) for k, b in enumerate(bases)]
    texts += [edited(words(300, 5000), 3, 100 + k) for k in range(120)] + [edited(words(300, 5000), 9, 300 + k) for k in range(60)]
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    of = similar_components(texts)
    assert 31 < len(set(of)) < 120
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    assert sorted(got) == sorted(set(of))


def test_large_buckets_are_all_pairs(spark, monkeypatch):
    base = words(150, 1)
    texts = [edited(base, 1 + k % 9, k) for k in range(60)]
    texts += [edited(texts[k], 6, 100 + k) for k in range(20)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(minhash, "SMALL", 2)
    of = similar_components(texts)
    for rounds in (0, 6):
        monkeypatch.setattr(minhash, "ROUNDS", rounds)
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == dict(enumerate(of))


def test_minhash_odd(spark, odd, none):
    assert minhash.near_duplicates(odd).count() == odd.count() and minhash.near_duplicates(none).count() == 0
    kept = simhash.representatives(odd, shingle=5, similarity=0.8)
    assert kept.columns == odd.columns and sum(1 for r in kept.collect() if not (r["text"] or "").strip()) == 1


# --- shared parts and the pipeline ---


def test_lookup_both_ways(spark, monkeypatch):
    big = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k long, x string")
    table = written(spark.createDataFrame([(1, 10), (None, 20)], "k long, y int"), "test")
    expected = {("a", 10), ("b", 20), ("c", None)}
    assert {(r["x"], r["y"]) for r in lookup(big, table, ["k"]).collect()} == expected
    monkeypatch.setattr("cellframe.llm.common.BROADCAST_ROWS", 0)
    assert {(r["x"], r["y"]) for r in lookup(big, table, ["k"]).collect()} == expected


@pytest.fixture(scope="module")
def sf_dir(spark, odd, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    good = [(100 + k, words(120, 100 + k), "en", f"s{k % 3}", 5) for k in range(60)]
    junk = [(300 + k, words(50, 300 + k).replace(" ", " | "), "en", "s0", 5) for k in range(40)]
    copies = [(500 + k, words(120, 100), "en", "s1", 5) for k in range(10)]
    docs = spark.createDataFrame(good + junk + copies, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd.select(*docs.columns)).withColumns({c: F.lit("clash") for c in ("score", "_row", "n_deleted", "fp", "copies")})
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(d[0], 1, 0) for d in good[::2]] + [(d[0], 0, 0) for d in junk[::2]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start, columns, kept = docs.count(), docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "test")
        if name != "packing":
            assert docs.columns == columns and {r["score"] for r in docs.select("score").distinct().collect()} <= {"clash"}
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    good = {100 + k for k in range(60)}
    assert good <= set(kept["quality classifier"]) and not set(range(300, 340)) & set(kept["quality classifier"])
    assert good <= set(kept["line dedup"]) and not set(range(500, 510)) & set(kept["line dedup"]) and good <= set(kept["near-dedup"])
    assert len(kept["near-dedup"]) == len({(k, kept["near-dedup"][:k].count(d)) for k, d in enumerate(kept["near-dedup"])}) < start
    assert set(kept["mixing"]) <= set(kept["near-dedup"]) and set(kept["packing"]) == set(kept["mixing"])
    assert docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_stages_on_nothing_and_odd(spark, sf_dir, odd, none):
    for docs in (none, odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            assert docs is odd or out.count() == 0
            out.collect()


def test_stages_are_brute_force(spark, sf_dir):
    """Each stage against a plain version on its own input."""
    from cellframe.llm import quality

    from .test_queries import plain_ftrl

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    stage = dict(corpus_pipeline.STAGES)

    order = {r["doc_id"]: r["o"] for r in docs.select("doc_id", F.xxhash64(F.lit("quality"), F.col("doc_id").cast("string")).alias("o")).collect()}
    learnt = sorted({(order[d], d, t) for d, t in rows(docs) if d in labels and zlib.crc32(str(d).encode()) % 4 != 2})
    sparse = lambda t: dict(zip(*(x.tolist() for x in quality.features(t))))
    w = plain_ftrl([sparse(t) for _, _, t in learnt], [labels[d] for _, d, _ in learnt], quality.BUCKETS, quality.EPOCHS, quality.ALPHA, quality.BETA, quality.L1, quality.L2)
    score = lambda t: quality.sigmoid(sum(w.get(i, 0.0) * v for i, v in sparse(t).items()) + w[quality.BUCKETS])
    good = written(stage["quality classifier"](spark, docs, sf_dir), "test")
    assert sorted(rows(good), key=str) == sorted((x for x in rows(docs) if score(x[1]) >= 0.7), key=str)

    cut = plain_dedup(rows(good))
    lines = written(stage["line dedup"](spark, good, sf_dir), "test")
    assert sorted(rows(lines), key=str) == sorted(((d, cut.get((d, t), t)) for d, t in rows(good) if cut.get((d, t), t) == t or cut[d, t].split()), key=str)

    near = written(stage["near-dedup"](spark, lines, sf_dir), "test")
    texts = sorted({(d is None, d or 0, t or "") for d, t in rows(lines)})
    of = similar_components([t for _, _, t in texts])
    assert sorted((d or 0 for d, _ in rows(near))) == sorted(texts[k][1] for k in set(of))

    mixed = written(stage["mixing"](spark, near, sf_dir), "test")
    copies = {(r["doc_id"], r["_hash"]): r["copies"] for r in mixing.mix(near).collect()}
    assert mixed.count() == sum(copies.values())

    packed = stage["packing"](spark, mixed, sf_dir).collect()
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and r["offset"] + r["length"] <= 2048
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(r["doc_id"] or 0 for r in packed if r["piece"] == 0) == sorted(d or 0 for d, _ in rows(mixed))


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50
