"""Token counts of fields and sections by offset-mapped attribution.

A document is its fields, one after the other; it is encoded once, as a whole, so counts are those of the text a model would read. A
section is a part of a field that ends with a separator (or the field's end); sections cover the document without gaps. Tokens
are matched to sections by an interval join of character spans: both lists are in order, so it is a search, not a comparison of all
with all. A character that several tokens share counts for each of them.

A token inside one section counts there. A token that crosses a boundary goes, by the rule `most`, to the section that
holds most of its characters, the earlier on a tie; by `first`, to the section of its first character.

Defined results. A null or empty document has one section without characters and tokens. A null field is an empty one. Rows are treated one by
one, so repeated rows give repeated results, and a null id stays null. An empty table gives an empty table. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_columns, ids_back
from .tokenizer import byte_bpe, vocabulary

SEPARATOR = "\n"
RULES = ("most", "first")


def attribute(parts: Sequence[str | None], encode, lengths: np.ndarray, separator: str = SEPARATOR, rule: str = "most"):
    """Arrays of field, section in field, start and end (characters of the document), tokens, and tokens that crossed a boundary."""
    raw = [(p or "").encode("utf-8", "surrogatepass") for p in parts]
    whole = b"".join(raw)
    sep = separator.encode()
    ends, field, number, at = [], [], [], 0
    for k, r in enumerate(raw):
        cut = 0
        n = 0
        while cut < len(r):
            found = r.find(sep, cut)
            cut = len(r) if found < 0 else found + len(sep)
            ends.append(at + cut), field.append(k), number.append(n)
            n += 1
        at += len(r)
    if not ends:
        ends, field, number = [0], [0], [0]
    byte = np.frombuffer(whole, dtype=np.uint8)
    # characters begun before each byte
    begun = np.concatenate(([0], np.cumsum((byte & 0xC0) != 0x80)))
    ends = np.array(ends)
    char_ends = begun[ends]
    count, crossed = np.zeros(len(ends), dtype=np.int64), np.zeros(len(ends), dtype=np.int64)
    if len(whole):
        stop = np.cumsum(lengths[encode(whole.decode("utf-8", "surrogatepass"))])
        start = np.concatenate(([0], stop[:-1]))
        # spans in characters: from the one that holds the first byte to the one that holds the last
        start, stop = begun[start + 1] - 1, begun[stop]
        first, last = np.searchsorted(char_ends, start, side="right"), np.searchsorted(char_ends, stop - 1, side="right")
        over = np.flatnonzero(first != last)
        to = first
        for t in over:
            if rule == "most":
                bounds = np.concatenate(([start[t]], char_ends[first[t] : last[t]], [stop[t]]))
                to[t] = first[t] + int(np.argmax(np.diff(bounds)))
        count = np.bincount(to, minlength=len(ends))
        crossed = np.bincount(to[over], minlength=len(ends))
    return np.array(field), np.array(number), np.concatenate(([0], char_ends[:-1])), char_ends, count, crossed


def token_counts(docs: DataFrame, fields: Sequence[str] = ("text",), doc_id: str = "doc_id", separator: str = SEPARATOR, rule: str = "most", vocab: str | None = None) -> DataFrame:
    """One row per document and section: doc_id, field (name), section (from 0 in its field), start, end, tokens, crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not separator:
        raise ValueError("separator is empty")
    vocab = vocab or vocabulary("byte_bpe_50k.tiktoken")
    names = np.array(fields, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(vocab)
        for b in batches:
            texts = [b[f"f{k}"] for k in range(len(names))]
            # a batch's sections are handed on in bounded pieces, as a text may have very many
            ids, found, held = [], [], 0
            for d, missing, *parts in zip(b["doc_id"].tolist(), b["_no_id"].tolist(), *texts):
                found.append(attribute(parts, bpe.encode, bpe.lengths, separator, rule))
                ids.append((d, missing, len(found[-1][0])))
                held += ids[-1][2]
                if held > 100_000:
                    yield frame(ids, found)
                    ids, found, held = [], [], 0
            if ids:
                yield frame(ids, found)

    def frame(ids, found):
        field, section, start, end, tokens, crossing = (np.concatenate(c) for c in zip(*found))
        doc = ids_back([d for d, _, _ in ids], [m for _, m, _ in ids]).repeat([n for _, _, n in ids])
        return pd.DataFrame({"doc_id": doc, "field": names[field], "section": section.astype(np.int32), "start": start, "end": end, "tokens": tokens, "crossing": crossing})

    rows = docs.select(*id_columns(doc_id), *(F.col(c).alias(f"f{k}") for k, c in enumerate(fields)))
    return rows.mapInPandas(run, "doc_id long, field string, section int, start long, end long, tokens long, crossing long")


def op1_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir))
