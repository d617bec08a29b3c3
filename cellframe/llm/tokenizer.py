"""Tokenizers from public vocabulary files, loaded once for each Python process. Paths are parameters; nothing is trained or copied."""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordBPE:
    """Ids exactly as the library `tokenizers` gives for a word-level BPE file (NFC, lower case, words by pattern, ends of words marked).

    Texts of Latin letters and common signs go through a byte-pair encoder of ranks, which is several times faster: the end of a word is
    byte 1, whose merges with the byte before it come first, and the other merges keep their order. A merge by ranks joins any two
    neighbours that make a token, a merge by pairs only that token's pair. Both agree if each token, encoded alone, gives itself: what
    lies between a token's ends has then been merged as it would be alone, and alone the last pair is the token's own. A test verifies this for
    the file. All other texts go to the library. Strings of special tokens are ordinary text.
    """

    END = "</w>"
    #: Letters and digits below this code point are told apart here as the library does.
    LIMIT = 0x250

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        of_char = byte_alphabet()
        of_byte = {b: c for c, b in of_char.items()}
        ranks, ids = {}, []

        def put(piece: bytes, token: str) -> None:
            if piece not in ranks:
                ranks[piece] = len(ids)
                ids.append(vocab[token])

        for b in range(256):
            put(bytes([b, 1]), of_byte[b] + self.END)
        for b in range(256):
            put(bytes([b]), of_byte[b])
        for pair in model["merges"]:
            token = "".join(pair if isinstance(pair, list) else pair.split(" "))
            body = token.removesuffix(self.END)
            put(bytes(of_char[c] for c in body) + b"\x01" * (body != token), token)
        self.ids = np.array(ids, dtype="<u4")
        self.fast = tiktoken.Encoding("words", pat_str="[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={})
        kinds = {k: "".join(chr(c) for c in range(self.LIMIT) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^\\s{kinds['L']}{kinds['N']}]+")
        # control characters and rare signs are left to the library
        self.plain = re.compile(f"[\t\n\r -~\xa0-{chr(self.LIMIT - 1)}‐-‧€]*")

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return self.ids[:0]
        if self.plain.fullmatch(text):
            text = unicodedata.normalize("NFC", text).lower()
            if words := self.words.findall(text):
                return self.ids[self.fast.encode_to_numpy("\x01".join(words) + "\x01")]
            return self.ids[:0]
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level files: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE of ranks, with the length in bytes of each id, so that spans follow from one encoding."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for piece, rank in ranks.items():
            self.lengths[rank] = len(piece)
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    #: Runs of white space beyond this length are too deep for the pattern's look-ahead.
    LONG = 10_000
    _long = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)

    def encode(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for m in self._long.finditer(text):
            # the pattern takes a run whole at the end of a text, and else leaves its last sign to what follows
            end = m.end() if m.end() == len(text) else m.end() - 1
            parts += [self.fast.encode_ordinary(text[at : m.start()]), self.fast._encode_single_piece(text[m.start() : end])]
            at = end
        parts.append(self.fast.encode_ordinary(text[at:]))
        return np.array(parts[0] if len(parts) == 1 else [i for p in parts for i in p], dtype=np.int64)


@lru_cache(4)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


@lru_cache(4)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)
