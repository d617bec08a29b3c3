"""Line dedup by winnowing over line hashes. DataFrame operations only.

A line ends at a newline, after a word that ends in a full stop, an exclamation or a question mark, and after LINE_WORDS words at the latest: passages repeat inside the
long lines of prose, seldom as whole ones. A passage of lines repeats if RUN consecutive lines of it do, word for word; white space at line ends doesn't matter. Of
50 words, however they are cut out of a text, 28 at least lie in whole lines, and these are RUN lines or more: so a repeated passage of 50 words is always
met, but where a text has no line or sentence end for over LINE_WORDS words before it, and is cut elsewhere in the copies.

1. Two neighbouring lines have a hash. The least hash of each window over the pairs of RUN lines is a fingerprint: what RUN equal lines stand for has the same in
   every document, so documents that share no fingerprint, with others or inside, hold no repeated run and go no further.
2. Positions that share a fingerprint are joined; a match is extended to both sides over all RUN lines in a row that agree, with any earlier place: each such piece is joined to the
   first place (smallest id, then line) that holds it, never to all others.
3. Pieces that overlap or touch are one run. The later copies of runs with min_words words or more are deleted, the first is kept.

A piece or fingerprint that is everywhere is one row of a bounded broadcast table (the most frequent ones), so it lands in no single task.

Defined results. A null or empty text has no lines and stays as it is. Rows with the same id and text are one document. A null id comes first. A copy may overlap the passage
that it repeats. Texts differ only by whole lines, with the white space after them, taken out; a text of which all lines are deleted is empty but for white space before its first
word. A text without deleted lines comes back unchanged. An empty table gives an empty table. Other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, documents, row_back, split_hot, whole_row, written

LINE_WORDS = 12
#: Lines that a repeated run has at least.
RUN = 3
#: Words that a repeated run has at least.
MIN_WORDS = 20
SPACE = r"[\x20\x09-\x0D]"
#: A line (group 1) and the white space after it.
LINE = rf"((?:[^\x20\x09-\x0D]*[^.!?\x20\x09-\x0D][\x20\x09]+){{0,{LINE_WORDS - 1}}}{WORD}){SPACE}*"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(_id, _th, hashes): the hashes of the lines of each text that has RUN of them; _th is the hash of the text."""
    hashes = F.transform(F.regexp_extract_all(F.col(text), F.lit(LINE), F.lit(1)), lambda line: F.xxhash64(line))
    rows = docs.filter(F.length(text) > 0).select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th"), hashes.alias("hashes"))
    return rows.filter(F.size("hashes") >= RUN)


def _neighbours(items: Column, of) -> Column:
    """of(item, next item) for all but the last."""
    return F.zip_with(F.slice(items, 1, F.size(items) - 1), F.slice(items, 2, F.size(items) - 1), of)


def fingerprints(found: DataFrame) -> DataFrame:
    """(_id, _th, prints, again): the least hash of each window of RUN lines, once each, and whether two lines are repeated inside."""
    pairs = found.select("_id", "_th", _neighbours(F.col("hashes"), lambda a, b: F.xxhash64(a, b)).alias("_pairs"))
    least = _neighbours(F.col("_pairs"), lambda a, b: F.least(a, b))
    return pairs.select("_id", "_th", F.array_distinct(least).alias("prints"), (F.size(F.array_distinct("_pairs")) < F.size("_pairs")).alias("again"))


def candidates(found: DataFrame) -> DataFrame:
    """(_id, _th) of the documents that share a fingerprint or hold one twice."""
    prints = written(fingerprints(found), "line-prints")
    each = prints.select("_id", "_th", F.explode("prints").alias("_print"))
    shared = written(each.groupBy("_print").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "line-shared")
    parts = [part.select("_id", "_th") for part in split_hot(each, shared, "_print", "_n")]
    return written(parts[0].union(parts[1]).union(prints.filter("again").select("_id", "_th")).distinct(), "line-candidates")


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(_id, _th, runs): the line numbers, from 0, of the first and last lines of repeated runs, which neither overlap nor touch."""
    found = written(lines(docs, text, doc_id), "lines")
    wanted = candidates(found).select(F.col("_id").alias("_i"), F.col("_th").alias("_t"))
    found = found.join(wanted, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left_semi")
    pieces = _neighbours(_neighbours(F.col("hashes"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x, y: F.xxhash64(x["a"], x["b"], y["b"]))
    pieces = written(found.select("_id", "_th", F.posexplode(pieces).alias("pos", "piece")), "line-pieces")
    place = F.struct(F.col("_id").isNotNull().alias("has_id"), "_id", "_th", "pos")
    first = pieces.groupBy("piece").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    first = written(first, "line-first")
    later = [part.filter(place != F.col("_first")).select("_id", "_th", "pos") for part in split_hot(pieces, first, "piece", "_n")]
    # the places of a document, in order; a run ends where the next piece begins beyond the line after this one's end
    at = later[0].union(later[1]).groupBy("_id", "_th").agg(F.array_sort(F.collect_set("pos")).alias("_at"))
    ends = F.filter("_at", lambda p, k: ~F.coalesce(F.get("_at", k + 1) <= p + RUN, F.lit(False)))
    starts = F.filter("_at", lambda p, k: (k == 0) | ~F.coalesce(F.get("_at", F.greatest(k - 1, F.lit(0))) >= p - RUN, F.lit(False)))
    return at.select("_id", "_th", F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("first"), (e + RUN - 1).alias("last"))).alias("runs"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """docs with the later copies of repeated runs taken out of the text; with counts, also n_deleted, the words taken out."""
    runs = written(repeated(docs, text, doc_id), "line-runs")
    runs = runs.select(F.col("_id").alias("_i"), F.col("_th").alias("_t"), "runs")
    # most corpora have runs in very many documents, so texts are dealt by their keys at every size; runs
    # are hashed, so that texts need no sorting
    rows = docs.select(whole_row(docs), F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_th"))
    rows = rows.join(runs.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left")
    body = F.col("_row").getField(text)

    # what lies between the runs: from the end of each to the start of the next
    ends = F.concat(F.array(F.lit(-1)), F.transform("runs", lambda r: r["last"]))
    starts = lambda parts: F.concat(F.transform("runs", lambda r: r["first"]), F.array(F.size(parts)))

    def joined(parts: Column, first: Column, count: Column) -> Column:
        return F.array_join(F.slice(parts, first, count), "")

    def split(parts: Column) -> Column:
        """Structs of a kept part, the run after it, and the run's words; the last has no run."""
        kept = F.zip_with(ends, starts(parts), lambda e, s: joined(parts, e + 2, s - e - 1))
        cut = F.transform("runs", lambda r: joined(parts, r["first"] + 1, r["last"] - r["first"] + 1))
        return F.zip_with(kept, cut, lambda k, c: F.struct(k.alias("kept"), c.alias("run"), F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).alias("words")))

    found = F.when(F.col("runs").isNotNull(), let(F.regexp_extract_all(body, F.lit(LINE), F.lit(0)), split))
    rows = rows.select("_row", found.alias("_found"))
    # runs of few words stay
    fresh = F.array_join(F.transform("_found", lambda x: F.concat(x["kept"], F.when(x["words"] < min_words, F.coalesce(x["run"], F.lit(""))).otherwise(""))), "")
    gone = F.coalesce(F.aggregate("_found", F.lit(0), lambda n, x: n + F.when(x["words"] < min_words, 0).otherwise(x["words"])), F.lit(0))
    before = F.regexp_extract(body, f"^{SPACE}*", 0)
    out = row_back(docs.columns, **{text: F.when(gone > 0, F.concat(before, fresh)).otherwise(body)})
    if counts:
        out.append(gone.cast("long").alias("n_deleted"))
    return rows.select(*out)


def op5_line_dedup(spark, sf_dir):
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), counts=True)


#: The same from the definition, in DuckDB's SQL: a line goes if it lies in RUN lines that stand at an earlier place as well, in a run of enough words.
OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, u, length(u) AS n, unnest(u) AS line, generate_subscripts(u, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '(?:[^\x20\x09-\x0D]*[^.!?\x20\x09-\x0D][\x20\x09]+){0,11}[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS u FROM documents WHERE length(text) > 0)),
t AS (SELECT doc_id, pos, n, line, rtrim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
p AS (SELECT *, CASE WHEN pos <= n - 2 THEN [bare, lead(bare, 1) OVER d, lead(bare, 2) OVER d] END AS piece FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, piece IS NOT NULL AND row_number() OVER (PARTITION BY piece ORDER BY doc_id, pos) > 1 AS again FROM p),
g AS (SELECT *, again OR coalesce(lag(again, 1) OVER d, false) OR coalesce(lag(again, 2) OVER d, false) AS hit FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, hit ORDER BY pos) AS run FROM g),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM r),
x AS (SELECT *, hit AND sum(words) OVER (PARTITION BY doc_id, hit, run) >= 20 AS gone FROM w),
y AS (SELECT doc_id, coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept, coalesce(sum(words) FILTER (WHERE gone), 0) AS n_deleted FROM x GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n_deleted > 0 THEN regexp_extract(d.text, '^[\x20\x09-\x0D]*') || kept ELSE d.text END AS text, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted
FROM documents d LEFT JOIN y ON d.doc_id = y.doc_id
"""
