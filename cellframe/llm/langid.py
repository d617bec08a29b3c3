"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams, of one to three characters, in order of frequency. Texts are lower-cased; letters
stand for themselves and whatever lies between words for one blank, which n-grams have at their ends only. Language profiles
are counted over all texts to learn from. A document's own most frequent n-grams are compared to each language's by the out-of-place
distance: the sum over them of how far the ranks differ, and the profile's length where a language lacks one.

N-grams are exact 64-bit numbers (21 bits a character), so counting is sorting of numbers. Counts are added up inside each task
first; what is shuffled and collected depends on alphabets and languages, not on the corpus.

Defined results. A null text or one without letters is `und` with score 0. Rows with a null language teach nothing. If nothing can be learnt
every text is `und`. Ties in rank go by n-gram, ties in distance by name of the language. Repeated rows count each and get the same result. An empty
table gives an empty table. Other columns stay as they are; columns named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, documents, row_back, whole_row

PROFILE = 400
UNKNOWN = "und"
_BLANK = 32
#: Distinct counts that a task holds before it hands them on.
HELD = 1_000_000


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str | None) -> np.ndarray:
    """All n-grams of a text, as numbers, unordered; empty if it has no letters."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    is_letter = letters()[c]
    if not is_letter.any():
        return np.zeros(0, dtype=np.int64)
    c = np.concatenate(([_BLANK], np.where(is_letter, c, _BLANK), [_BLANK]))
    c = c[np.concatenate(([True], (c[1:] != _BLANK) | (c[:-1] != _BLANK)))]
    blank = c == _BLANK
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[~blank[1:-1]]
    return np.concatenate((c[~blank], two, three))


def top(text: str | None, length: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first."""
    g, n = np.unique(grams(text), return_counts=True)
    return g[np.argsort(-n, kind="stable")[:length]]


def distances(ranked: np.ndarray, known: np.ndarray, ranks: np.ndarray, length: int) -> np.ndarray:
    """Out-of-place distance to each language as a part of the greatest. known: sorted n-grams; ranks: [n-gram, language], `length` where it lacks one."""
    at = np.minimum(np.searchsorted(known, ranked), len(known) - 1)
    rank = np.where((known[at] == ranked)[:, None], ranks[at], length)
    place = np.arange(len(ranked))[:, None]
    return np.where(rank == length, length, np.abs(rank - place)).sum(axis=0) / (length * len(ranked))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang, g, n):
        if lang in held:
            g, n = np.concatenate((held[lang][0], g)), np.concatenate((held[lang][1], n))
        u, at = np.unique(g, return_inverse=True)
        held[lang] = u, np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)

    def give():
        for lang, (g, n) in held.items():
            yield pd.DataFrame({"lang": lang, "gram": g, "n": n})
        held.clear()

    for b in batches:
        for lang, texts in b.groupby("lang", sort=True)["text"]:
            waiting, size = [], 0
            for t in texts:
                waiting.append(grams(t))
                size += len(waiting[-1])
                if size > 2_000_000:
                    add(lang, *np.unique(np.concatenate(waiting), return_counts=True))
                    waiting, size = [], 0
            if waiting:
                add(lang, *np.unique(np.concatenate(waiting), return_counts=True))
        if sum(len(g) for g, _ in held.values()) > HELD:
            yield from give()
    yield from give()


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", length: int = PROFILE) -> dict[str, list[int]]:
    """Profiles by language: `length` n-grams each, most frequent first, from all rows."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= length)
    found: dict[str, list] = {}
    for r in ranked.collect():  # `length` rows for each language
        found.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {k: [g for _, g in sorted(v)] for k, v in sorted(found.items())}


def identify(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", length: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score: the nearest language, and how much farther the next one is (0.5: as near; 1: no distance or no other)."""
    names = np.array([*sorted(profiles), UNKNOWN], dtype=object)
    known = np.unique(np.concatenate([np.array(p, dtype=np.int64) for p in profiles.values()])) if profiles else np.zeros(0, np.int64)
    ranks = np.full((len(known), len(names) - 1), length, dtype=np.int64)
    for k, name in enumerate(names[:-1]):
        ranks[np.searchsorted(known, profiles[name]), k] = np.arange(len(profiles[name]))

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            pred, score = np.full(len(s), len(names) - 1), np.zeros(len(s))
            for i, t in enumerate(s):
                mine = top(t, length)
                if len(mine) and len(known):
                    d = distances(mine, known, ranks, length)
                    pred[i] = k = int(np.argmin(d))
                    other = np.delete(d, k)
                    score[i] = 1.0 if not len(other) or other.min() == 0 == d[k] else other.min() / (other.min() + d[k])
            yield pd.DataFrame({"lang_pred": names[pred], "score": score})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(whole_row(docs), of(F.col(text)).alias("_new"))
    return found.select(*row_back(kept), "_new.lang_pred", "_new.score")


def op2_langid(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = crc32_of("doc_id") % 5 == 0
    profiles = learn(docs.filter(~held))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")
