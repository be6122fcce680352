"""Token counts of whole texts by a map-side two-tier lookup.

A byte-level BPE tokenizer never merges across pre-tokens, so a text's count is the sum of its pre-tokens' lengths. Tier 1
is one broadcast hash table (a bounded number of frequent pre-tokens and their lengths); tier 2 is each worker's cache of
what it has encoded itself. No pre-token is ever shuffled and a document is read once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.columns import col

#: Bounds of tier 1, whatever the input: pre-tokens kept, bytes of one, documents looked at for choosing them.
TABLE_ENTRIES, ENTRY_BYTES, SAMPLE_DOCS = 60_000, 64, 400
#: Entries a worker caches beyond tier 1 before it starts anew.
CACHE_ENTRIES = 300_000
#: Code points from which on a text's pre-tokens aren't listed at once.
LONG_TEXT = 1 << 20


def _ranges(keep) -> str:
    """A regex class body of the code points whose category satisfies ``keep``."""
    out, start, limit = [], None, 0x110000
    for point in range(limit + 1):
        inside = point < limit and keep(unicodedata.category(chr(point)))
        if inside and start is None:
            start = point
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}" + (f"-\\U{point - 1:08x}" if point - 1 > start else ""))
            start = None
    return "".join(out)


@lru_cache(1)
def pre_token_pattern() -> re.Pattern:
    """The byte-level pre-tokenizer's split, with letters, numbers and white space written out as classes."""
    letter, number = _ranges(lambda c: c[0] == "L"), _ranges(lambda c: c[0] == "N")
    space = r"\t-\r \x85\xa0  -     　"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class _Unassigned(Exception):
    """A code point that this Python's Unicode tables don't know yet: the library must judge the text."""


class LengthTable(dict):
    """pre-token -> number of tokens; what is missing is encoded and, unless it is long, kept up to a bound of entries."""

    def __init__(self, frequent: dict[str, int], tokenizer, bound: int = CACHE_ENTRIES) -> None:
        super().__init__(frequent)
        self.frequent, self.tokenizer, self.most = frequent, tokenizer, len(frequent) + bound

    def __missing__(self, piece: str) -> int:
        if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece):
            raise _Unassigned
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) > ENTRY_BYTES:
            return n
        if len(self) >= self.most:
            self.clear()
            self.update(self.frequent)
        self[piece] = n
        return n


def _open(spec: bytes):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_buffer(spec)


def _checked(spec: bytes) -> list[str]:
    """The special strings of a byte-level BPE file; other kinds of tokenizers aren't sums over pre-tokens."""
    kind = json.loads(spec)
    pre = kind.get("pre_tokenizer") or {}
    added = kind.get("added_tokens", [])
    if kind.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or kind["model"].get("type") != "BPE":
        raise ValueError("count_tokens needs a byte-level BPE tokenizer without normalizer or prefix space")
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
        raise ValueError("added tokens that strip or match single words aren't supported")
    return [a["content"] for a in added]


def frequent_lengths(docs: DataFrame, spec: bytes, text_col: str = "text", entries: int = TABLE_ENTRIES, sample_docs: int = SAMPLE_DOCS) -> dict[str, int]:
    """Tier 1: the most frequent pre-tokens of at most ``sample_docs`` documents. It decides speed only, never a count."""
    split, seen = pre_token_pattern().findall, Counter()
    for (text,) in docs.select(col(text_col).alias("text")).where(F.length("text").between(1, 20_000)).take(sample_docs):
        seen.update(split(text))
    known = [p for p, _ in seen.most_common(entries) if len(p.encode()) <= ENTRY_BYTES and not any(unicodedata.category(c) == "Cn" for c in p)]
    encoded = _open(spec).encode_batch(known, add_special_tokens=False)
    return {p: len(e.ids) for p, e in zip(known, encoded, strict=True)}


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``), one row per row of ``docs``.

    A null text counts as empty (0, 0, false). Null and repeated ids are passed through row by row. Special strings inside
    texts are one token each, as the library reads them by default. Other columns of ``docs`` are not read. A text takes time
    in proportion to its length; a very long one isn't listed at once.
    """
    with open(tokenizer_file, "rb") as f:
        spec = f.read()
    special = _checked(spec)
    shared = docs.sparkSession.sparkContext.broadcast((spec, frequent_lengths(docs, spec, text_col)))
    cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, frequent = shared.value
        tokenizer = _open(spec)
        table, pattern = LengthTable(frequent, tokenizer), pre_token_pattern()

        def pieces(part: str):
            """The pre-tokens: at once, or one by one for a very long text."""
            return pattern.findall(part) if len(part) < LONG_TEXT else (m[0] for m in pattern.finditer(part))

        def tokens(text: str) -> int:
            try:
                parts = cut.split(text) if cut and any(s in text for s in special) else (text,)
                return sum(sum(map(table.__getitem__, pieces(part))) for part in parts) + len(parts) - 1
            except _Unassigned:
                return len(tokenizer.encode(text, add_special_tokens=False).ids)

        for batch in batches:
            size, total = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                size.append(len(text) if text.isascii() else len(text.encode()))
                total.append(tokens(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array([n > limit for n in total], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(col(id_col), col(text_col)).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
