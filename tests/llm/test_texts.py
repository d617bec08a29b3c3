"""Token counts, language, quality, packing: defined results and comparisons with plain versions."""

import zlib

import numpy as np
import pytest


from cellframe.llm import langid, packing, quality, token_counts
from cellframe.llm.tokenizer import byte_bpe, vocabulary, word_bpe

from .conftest import words


@pytest.fixture(scope="module")
def bpe():
    return word_bpe(vocabulary("word_bpe_49k.json"))


def test_word_bpe_is_the_library(bpe):
    texts = [words(50, k) for k in range(20)] + ["", " ", "It's DON'T we'Ll 3rd 42", "naïve ÀÉÎ ß œ", "漢字 mixed ☃ text", "a\x01b", "Σίσυφος ΣΑΣ", "é é", "x" * 300, "!!!???...", "a b c", "’s it’s", "<|endoftext|> x", "tab\tnew\r\nline\x0bfeed\x1c"]
    for t in texts:
        assert bpe.encode(t).tolist() == bpe.slow.encode(t, add_special_tokens=False).ids, t


def test_each_token_gives_itself(bpe):
    """What makes an encoder of ranks agree with one of pairs: no token is out of reach of its own merges."""
    import json

    model = json.load(open(vocabulary("word_bpe_49k.json"), encoding="utf-8"))["model"]
    rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}

    def merged(parts):
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in rank:
                break
            a, b, out, i = parts[best], parts[best + 1], [], 0
            while i < len(parts):
                if i < len(parts) - 1 and (parts[i], parts[i + 1]) == (a, b):
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    for token in model["vocab"]:
        if not token.startswith("<|"):
            body = token.removesuffix("</w>")
            parts = [*body]
            if body != token:
                parts[-1] += "</w>"
            assert merged(parts) == [token]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_is_brute_force(rule):
    b = byte_bpe(vocabulary("byte_bpe_50k.tiktoken"))
    for text in ["one two\nthree\n\n four  \n", "é\n漢字\U0001f600\n x", "a", "\n\n\n", words(40, 1) + "\n" + words(30, 2)]:
        for parts in ([text], [text, None, "tail\nof", ""]):
            field, number, start, end, tokens, crossing = token_counts.attribute(parts, b.encode, b.lengths, "\n", rule)
            whole = "".join(p or "" for p in parts)
            ids = b.encode(whole)
            assert tokens.sum() == len(ids) and start[0] == 0 and end[-1] == len(whole) and (start[1:] == end[:-1]).all()
            at, count = 0, np.zeros(len(end), int)
            raw = whole.encode()
            for i in ids:
                lo, hi = len(raw[:at].decode("utf-8", "ignore")), None
                at += b.lengths[i]
                hi = lo + max(1, len(raw[:at].decode("utf-8", "ignore")) - lo)
                over = [max(0, min(hi, e) - max(lo, s)) for s, e in zip(start, end)]
                k = over.index(max(over)) if rule == "most" else next(n for n, o in enumerate(over) if o)
                count[k] += 1
            assert (count == tokens).all()


def test_extreme_texts(bpe, monkeypatch):
    from cellframe.llm.tokenizer import ByteBPE

    b = ByteBPE(vocabulary("byte_bpe_50k.tiktoken"))
    texts = ["a" + " " * n + t for n in (11, 12, 40) for t in ("", "b", "\n", "\u00a0x", "!")] + ["\n \t" * 9 + "x", " " * 30]
    plain = [b.fast.encode_ordinary(t) for t in texts]
    import re

    monkeypatch.setattr(ByteBPE, "_long", re.compile(ByteBPE._long.pattern.replace("10000", "12")))
    assert [b.encode(t).tolist() for t in texts] == plain
    monkeypatch.undo()
    for t in (" " * 1_500_000 + "x", "a" * 500_000, "\n" * 200_000, "\u6f22" * 100_000):
        ids = b.encode(t)
        assert b.lengths[ids].sum() == len(t.encode())
        bpe.encode(t)


def test_crossing_tokens_go_by_the_rule():
    lengths = np.array([4, 3])
    out = lambda rule: token_counts.attribute(["a\nbcdef"], lambda t: np.array([0, 1]), lengths, "\n", rule)[4].tolist()
    assert out("most") == [1, 1] and out("first") == [1, 1]
    lengths = np.array([5, 2])
    assert token_counts.attribute(["a\nbcdef"], lambda t: np.array([0, 1]), lengths, "\n", "most")[4].tolist() == [0, 2]


def test_token_counts_odd(spark, odd, none):
    rows = token_counts.token_counts(odd).collect()
    assert {r["doc_id"] for r in rows} == {*range(1, 12), None}
    assert [(r["start"], r["end"], r["tokens"]) for r in rows if r["doc_id"] == 2] == [(0, 0, 0)]
    assert sum(r["tokens"] for r in rows if r["doc_id"] == 4) > 180_000
    assert token_counts.token_counts(none).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(odd, rule="last")
    two = token_counts.token_counts(odd, fields=("lang", "text")).filter("doc_id = 7").collect()
    assert [(r["field"], r["start"], r["end"]) for r in two] == [("lang", 0, 2), ("text", 2, 3)]


def test_language(spark, odd, none):
    en, de = ["the cat and the dog sat there with them", "then they went to the other house"], ["der hund und die katze sitzen dort", "dann gingen sie in das andere haus"]
    docs = spark.createDataFrame([(k, t, lang) for lang, ts in (("en", en), ("de", de)) for k, t in enumerate(ts)] + [(9, "lost", None)], "doc_id long, text string, lang string")
    profiles = langid.learn(docs)
    assert sorted(profiles) == ["de", "en"]
    asked = spark.createDataFrame([(1, "there the and with"), (2, "und der die das"), (3, None), (4, "123 !?"), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(asked, profiles).collect()}
    assert [got[k]["lang_pred"] for k in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[3]["score"] == 0
    out = langid.identify(odd, langid.learn(odd))
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert langid.learn(none) == {} and langid.identify(none, {}).count() == 0
    assert {r["lang_pred"] for r in langid.identify(asked, {}).collect()} == {"und"}


def test_out_of_place_is_brute_force():
    profiles = {lang: langid.top(words(300, k, a), 50).tolist() for k, (lang, a) in enumerate((("x", "abcde"), ("y", "cdefg")))}
    known = np.unique(np.concatenate([*map(np.array, profiles.values())]))
    ranks = np.full((len(known), 2), 50)
    for k, p in enumerate(profiles.values()):
        ranks[np.searchsorted(known, p), k] = np.arange(len(p))
    mine = langid.top(words(40, 9, "abcfg"), 50)
    expected = [sum(abs(p.index(g) - k) if g in p else 50 for k, g in enumerate(mine.tolist())) / (50 * len(mine)) for p in profiles.values()]
    assert langid.distances(mine, known, ranks, 50) == pytest.approx(expected)


def test_grams_of_words():
    text = "Ab, ab"
    gram = lambda s: sum(ord(c) << 21 * (len(s) - 1 - k) for k, c in enumerate(s))
    expected = ["a", "b", "a", "b", " a", "ab", "b ", " a", "ab", "b ", " ab", "ab ", " ab", "ab "]
    assert sorted(langid.grams(text).tolist()) == sorted(map(gram, expected))


def labelled(spark, n=300):
    rows = [(k, ("menu | home | " + words(20, k)).replace(" ", " | ") if k % 3 == 0 else words(60, k)) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(n)] + [(1, None, 0), (None, 1, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    weights = quality.fit(docs.filter("doc_id % 4 <> 2"), labels)
    held = quality.score(docs.filter("doc_id % 4 = 2"), weights).collect()
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 3 != 0) for r in held]
    assert np.mean(right) > 0.95
    again = quality.fit(docs.filter("doc_id % 4 <> 2").repartition(7), labels)
    assert np.array_equal(weights, again)
    assert np.count_nonzero(quality.fit(docs, labels, sample=5)) < np.count_nonzero(weights)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (5, 0), (8, 1)], "doc_id long, quality int")
    weights = quality.fit(odd, labels)
    out = quality.score(odd, weights)
    rows = out.select("doc_id", "text", "score").collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    bias = quality.sigmoid(weights[-1])
    assert all(r["score"] == pytest.approx(bias, abs=1e-6) for r in rows if not (r["text"] or "").strip(" \t"))
    assert quality.score(none, weights).count() == 0
    assert quality.score(odd, quality.fit(none, labels)).first()["score"] == 0.5
    one = quality.fit(odd, labels.filter("quality = 1"))
    assert quality.score(odd, one).first()["score"] > 0.99


def test_sparse_score_is_dot_product():
    at, v = quality.features("a b a | |", 1 << 10)
    assert v @ v == pytest.approx(1) and (np.diff(at) > 0).all() and len(quality.features("")[0]) == 0


def brute_pieces(docs, bpe, limit):
    out = {}
    for d, t in docs:
        ids = np.append(bpe.encode(t), np.uint32(0)).astype("<u4")
        for k, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            out.setdefault((d, k, at, len(part), zlib.crc32(part.tobytes())), 0)
            out[d, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    return out


@pytest.mark.parametrize("limit", [16, 2048])
def test_packing_round_trip(spark, odd, bpe, limit):
    got = packing.pack(odd, limit=limit).collect()
    pieces = {}
    for r in got:
        key = r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]
        pieces[key] = pieces.get(key, 0) + 1
    assert pieces == brute_pieces([(r["doc_id"], r["text"]) for r in odd.collect()], bpe, limit)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit


def test_packing_with_ids_and_none(spark, odd, none, bpe):
    assert packing.pack(none).count() == 0
    ids = {}
    for r in sorted(packing.pack(odd, limit=64, with_ids=True).filter("doc_id = 9").collect(), key=lambda r: r["piece"]):
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
    text = odd.filter("doc_id = 9").first()["text"]
    assert ids[9] == [*bpe.encode(text).tolist(), 0]


@pytest.mark.parametrize("seed", range(4))
def test_fit_holds_all_and_few(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(1 / (20 + 60 * seed), 5000), 256)
    counts = np.bincount(lengths, minlength=257)
    plan = packing.fit(counts, 256)
    held = np.zeros(257, int)
    for n, what in plan:
        assert sum(l * k for l, k in what) <= 256
        for l, k in what:
            held[l] += n * k
    assert np.array_equal(held, counts)
    assert sum(n for n, _ in plan) <= 1.01 * -(-lengths.sum() // 256) + 1


def test_nnls_solves():
    rows = np.array([[3, 1, 0, 0], [2, 2, 0, 0], [4, 0, 0, 0]])
    counts = np.array([0, 5, 8, 5, 7], float)
    x = packing.nnls(rows, counts, 3000)
    assert x == pytest.approx([5, 4, 7], abs=0.05) and (x >= 0).all()
