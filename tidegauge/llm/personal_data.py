"""Personal data: fixed base patterns, then bootstrapped contextual extraction.

The base patterns give seed entities. The words around seeds and around other identifier-like tokens are lexical patterns;
Spark holds the graph of patterns and instances and scores it in rounds: a pattern is as good as the share of its distinct
instances that are believed, an instance as good as its trusted patterns together. Tokens and runs of numbers with blanks
that trusted patterns vouch for, and that are of the same family of signs as a seed of the kind, become further spans. Base
spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.shared import materialise
from tidegauge.llm.columns import col
from tidegauge.llm.textbytes import chunks

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; distinct believed instances that a pattern needs; its least precision; an instance's least score.
ROUNDS, MIN_SUPPORT, MIN_PRECISION, MIN_SCORE = 3, 4, 0.8, 0.9
#: A context word of more code points than this is no lexical pattern of its own: all of them count as one word.
CONTEXT, LONG_WORD = 64, "…"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile("[0-9@]")
_WORD = re.compile(r"\S+")
_RUN = re.compile(r"\+?\(?[0-9][\x20().0-9-]*[0-9]")
_EDGE = ".,;:!?\"'()[]{}|<>#*$&%=-+"
_MARKS = np.zeros(256, bool)
_MARKS[[*range(0x30, 0x3A), 0x40]] = True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, walking from one @ to the next: linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def passes_luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted; failing matches are dropped without another try."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(n) <= 3 and int(n) <= 255 for n in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and passes_luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def family(value: str) -> str:
    """What a value is made of: "@" between signs, digits without letters ("9"), or digits and letters ("a9"), or neither ("a")."""
    if "@" in value[1:-1]:
        return "@"
    letters, digits = any(map(str.isalpha, value)), any(c in "0123456789" for c in value)
    return "a" * letters + "9" * digits


def word_edges(text: str) -> tuple[list[int], list[int]]:
    """Where the words of a text begin and end."""
    edges = [m.span() for m in _WORD.finditer(text)]
    return [a for a, _ in edges], [b for _, b in edges]


def contexts(text: str, start: int, end: int, edges: tuple[list[int], list[int]] | None = None) -> list[str]:
    """Lexical patterns of a mention: its left word, two left words, right word, and left and right word.

    A word that touches the mention counts up to it. Words are whole, those of more than CONTEXT code points are LONG_WORD.
    """
    starts, ends = edges or word_edges(text)

    def plain(a: int, b: int) -> str:
        if b - a > CONTEXT:
            return LONG_WORD
        return re.sub("[0-9]+", "0", text[a:b].lower()).strip(_EDGE) or text[a : min(b, a + 4)]

    before, after = bisect_left(starts, start), bisect_right(ends, end)
    left = [plain(starts[k], min(ends[k], start)) for k in range(max(0, before - 2), before)]
    right = [plain(max(starts[after], end), ends[after])] if after < len(starts) else []
    out = [f"L {left[-1]}"] if left else []
    out += [f"LL {left[0]} {left[1]}"] if len(left) == 2 else []
    out += [f"R {right[0]}"] if right else []
    return out + ([f"LR {left[-1]} {right[0]}"] if left and right else [])


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what looks like an identifier and meets no base span, by start, outer ones first.

    Tokens, maximal runs of digits, blanks, brackets, dots and hyphens, and what the card and phone patterns match but drop,
    if they hold an @ or at least four digits, as any seed does (an ip has four numbers).
    """
    found = set()
    for m in (m for m in _WORD.finditer(text) if _MARK.search(text, *m.span())):
        a = m.start() + len(m[0]) - len(m[0].lstrip(_EDGE))
        found.add((a, m.end() - (len(m[0]) - len(m[0].rstrip(_EDGE))), m.start(), m.end()))
    for pattern in (_RUN, _CARD, *([_PHONE] if "+" in text else [])):
        found.update((m.start(), m.end(), m.start(), m.end()) for m in pattern.finditer(text))
    taken, out, k = [], set(), 0
    for a, _, b in sorted(spans):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for a, b, first, last in sorted(found, key=lambda c: c[2]):
        while k < len(taken) and taken[k][1] <= first:
            k += 1
        if a < b and not (k < len(taken) and taken[k][0] < last):
            value = text[a:b]
            if "@" in value or sum(c in "0123456789" for c in value) >= 4:
                out.add((a, b))
    return sorted(out, key=lambda c: (c[0], -c[1]))


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds (kind 0-3) and other candidates (kind -1), with their contexts.

    ``root`` is the start of the outermost candidate around one, ``inner`` lists the contexts that it shares with it.
    """
    more = candidates(text, spans)
    edges = word_edges(text) if spans or more else ([], [])
    out = [{"kind": kind, "start": a, "end": b, "value": text[a:b], "family": family(text[a:b]), "contexts": contexts(text, a, b, edges), "root": a, "inner": []} for a, kind, b in spans]
    root, until, around = -1, -1, []
    for a, b in more:
        own = contexts(text, a, b, edges)
        inside = b <= until
        if not inside:
            root, until, around = a, b, own
        out.append({"kind": -1, "start": a, "end": b, "value": text[a:b], "family": family(text[a:b]), "contexts": own, "root": root, "inner": [c for c in own if c in around] if inside else []})
    return out


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("family", pa.string()), ("contexts", pa.list_(pa.string())), ("root", pa.int32()), ("inner", pa.list_(pa.string()))])
_SCHEMA = "doc_id {}, text_key long, spans array<struct<start int, kind int, end int>>, mentions array<struct<kind int, start int, end int, value string, family string, contexts array<string>, root int, inner array<string>>>"


def base_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text), spans, mentions: one row per row of ``docs``; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, key, spans, found = batch.column(1), [], [], []
            for first, last, data, offsets in chunks(texts):
                total = np.concatenate([[0], np.cumsum(_MARKS[data])])
                marked = total[offsets[1:]] > total[offsets[:-1]]
                for r in range(last - first):
                    if not marked[r]:
                        key.append(0), spans.append([]), found.append([])
                        continue
                    raw = data[offsets[r] : offsets[r + 1]].tobytes()
                    text = raw.decode()
                    own = base_spans(text)
                    key.append(int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True))
                    spans.append([{"start": a, "kind": k, "end": b} for a, k, b in own])
                    found.append(mentions(text, own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(found, pa.list_(_MENTION))], names=["doc_id", "text_key", "spans", "mentions"])

    return docs.select(col(id_col), col(text_col)).mapInArrow(run, _SCHEMA.format(docs.schema[id_col].dataType.simpleString()))


def believed_values(mentioned: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_precision: float = MIN_PRECISION, min_score: float = MIN_SCORE) -> DataFrame:
    """value, kind: the instances beyond the seeds that trusted patterns vouch for, after ``rounds`` rounds.

    ``mentioned`` has kind (-1: no seed), value, family, contexts. The graph holds each (pattern, value) once, so a value or
    a context that stands in a third of all documents counts once. A candidate inside another one doesn't count as a further
    instance of the patterns that they share.
    """
    marked = mentioned.select("value", "family", "inner", F.explode("contexts").alias("pattern")).withColumn("inside", F.array_contains("inner", F.col("pattern")))
    edges = materialise(marked.groupBy("value", "family", "pattern").agg(F.min("inside").alias("inside")), "pii-edges")
    counted = edges.where("not inside")
    seeds = materialise(mentioned.where("kind >= 0").select("value", "kind", "family").distinct(), "pii-seeds")
    families = seeds.select("kind", "family").distinct()
    width = counted.groupBy("pattern").agg(F.countDistinct("value").alias("n"))
    believed = seeds.select("value", "kind").distinct()
    for _ in range(rounds):
        scored = counted.join(believed, "value").groupBy("pattern", "kind").agg(F.countDistinct("value").alias("support")).where(F.col("support") >= min_support)
        trusted = scored.join(width, "pattern").withColumn("precision", F.col("support") / F.col("n")).where(F.col("precision") >= min_precision)
        doubt = F.sum(F.log(F.lit(1.0) - F.least(F.col("precision"), F.lit(0.999))))
        found = edges.join(trusted.select("pattern", "kind", "precision"), "pattern").join(F.broadcast(families), ["kind", "family"]).groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score")).where(F.col("score") >= min_score)
        fresh = found.join(seeds.select("value").distinct(), "value", "left_anti")
        best = fresh.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        believed = materialise(seeds.select("value", "kind").distinct().unionByName(best), "pii-believed")
    return believed.join(seeds.select("value").distinct(), "value", "left_anti")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base, spans, added: one row per row of ``docs``.

    ``base`` and ``spans`` list kind:start:end by start, then kind, in code points; ``added`` counts the spans beyond the
    base, of which none lies within another. Null and empty texts have none. Rows with a null or repeated id are kept apart by their text.
    Other columns are not read. A text takes time in proportion to its length; only a text with a digit or an @ is looked at.
    """
    base = materialise(base_table(docs, id_col, text_col), "pii-base")
    mentioned = base.select("doc_id", "text_key", F.explode("mentions").alias("m")).select("doc_id", "text_key", "m.*")
    extra = believed_values(mentioned).withColumnRenamed("kind", "new_kind")
    nested = mentioned.where("kind < 0").join(extra, "value").groupBy("doc_id", "text_key", "root").agg(F.collect_set(F.struct("start", F.col("new_kind").alias("kind"), "end")).alias("near"))
    outer = F.filter("near", lambda s: ~F.exists("near", lambda t: (t["start"] <= s["start"]) & (t["end"] >= s["end"]) & (t["end"] - t["start"] > s["end"] - s["start"])))
    more = nested.withColumn("near", outer).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("near")).alias("more"))
    more = more.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "more")
    joined = base.drop("mentions").join(more, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    names = F.array(*map(F.lit, KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    whole = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "more")))
    return joined.select("doc_id", *map(count, range(4)), listed(F.col("spans")).alias("base"), listed(whole).alias("spans"), F.coalesce(F.size("more"), F.lit(0)).alias("__size")).withColumn("added", F.greatest("__size", F.lit(0)).cast("long")).drop("__size")
