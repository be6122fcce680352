"""Exact set-similarity join of documents' word n-grams by partitioning the universe of tokens.

Sets of like size form a band. Two sets of a band with Jaccard similarity t or more differ in at most H tokens, so if the
token universe is hashed into segments worth more than H in all, they agree on some segment: an untouched segment is worth
one, a segment that may lack one token (its one-deletion neighbourhood is indexed too) is worth two. For each band the
cheaper allocation is taken, by the signatures it makes and the chance meetings these cause.

A band with H + 1 + s segments of worth one has s to spare: any two similar sets agree on s + 1 segments, so each set leaves
out s of its own, the least ones in an order that depends on a segment and its content alone. Of the segments that two sets
agree on, the greatest stands above s others in both, so both keep it. The order puts segments of few uncommon tokens first:
empty ones, and those that only hold tokens which very many documents have.

Equal sets are one node from the start. Nodes that share a signature form a group; rather than all its pairs, a group
tests one node of each component against one of its leading component, round by round. What is still in different components after
that is paired by ``crowded_pairs``: all pairs of a small group, those that share a rare token of a crowded one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm import textbytes
from tidegauge.llm.columns import col
from tidegauge.llm.components import connected_components
from tidegauge.llm.crowded_pairs import CROWDED, Near, open_pairs
from tidegauge.llm.textbytes import fold_ascii, gram_hashes, mix64, span_hashes, words
from tidegauge.shared import materialise

#: Words of a shingle; least similarity in hundredths.
SHINGLE, PERCENT = 4, 85
#: Most rounds of testing between components before remaining pairs are tested; a round without a link ends them too.
HUB_ROUNDS = 2
#: Rows up to which a table of ids is broadcast (16 MB); a larger one is joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of text that a Python worker takes at once; its arrays hold some forty bytes for each.
CHUNK_BYTES = 1 << 18
#: 64-bit words of a set's parity sketch.
SKETCH_WORDS = 8
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
#: What a kept segment of one token costs, in signatures, as many documents may have that token.
LIGHT_COST = 16
#: Common tokens: texts of the sample (and characters of the longest of these), the share of them, at least, that have such a
#: token, and how many such tokens are told to all workers. They decide costs only, never a link.
SAMPLE_TEXTS, SAMPLE_CHARS, COMMON_SHARE, COMMON_TOKENS = 2_000, 100_000, 0.005, 65_536


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``high`` tokens, and larger ones that can link with these.

    With ``deletions`` a segment is worth two, else one; ``spare`` segments of each set are left out.
    """

    low: int
    high: int
    segments: int
    deletions: bool
    spare: int


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return textbytes.chunks(texts, CHUNK_BYTES)


def _excess(mean: float, spread: float, spare: int) -> float:
    """The mean of what exceeds ``spare``, for a number around ``mean``."""
    if spread <= 0:
        return max(0.0, mean - spare)
    z = (spare - mean) / spread
    beyond = 0.5 * math.erfc(z / math.sqrt(2))
    return spread * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) + (mean - spare) * beyond


def _allocation(low: int, high: int, percent: int) -> Band:
    """The cheaper of segments worth one, with the best number of spare ones, and of segments worth two."""
    most = (100 - percent) * (high + 100 * high // percent) // (100 + percent)
    if not most:
        return Band(low, high, 0, False, 0)
    light = lambda n, tokens: math.exp(-low / n) * sum((low / n) ** j / math.factorial(j) for j in range(tokens + 1))
    double = most // 2 + 1
    plans = [(high + double + 2 * LIGHT_COST * double * light(double, 2), 0, Band(low, high, double, True, 0))]
    for spare in sorted({most * i // 16 for i in range(33)}):
        n = most + 1 + spare
        share = light(n, 1)
        kept = _excess(n * share, math.sqrt(n * share * (1 - share)), spare)
        plans.append((most + 1 + LIGHT_COST * kept, spare, Band(low, high, n, False, spare)))
    return min(plans, key=lambda p: p[:2])[2]


@lru_cache(8)
def bands(percent: int = PERCENT, limit: int = 1 << 31) -> tuple[Band, ...]:
    out, low = [], 1
    while low < limit:
        high = max(low, 100 * low // percent)
        out.append(_allocation(low, high, percent))
        low = high + 1
    return tuple(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of each row's distinct shingles, sorted; rows of fewer than k words have their whole sequence as one."""
    data = fold_ascii(data)
    starts, ends, row = words(data, offsets)
    if not len(starts):
        return row, np.zeros(0, np.uint64)
    value = span_hashes(data, starts, ends)
    full = gram_hashes(value, k)
    inside = row[: len(full)] == row[k - 1 :] if len(full) else np.zeros(0, bool)
    rows, tokens = [row[: len(full)][inside]], [full[inside]]
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    for n in range(1, k):
        short = first[count[row[first]] == n]
        if len(short):
            rows.append(row[short])
            tokens.append(gram_hashes(value, n)[short] ^ np.uint64(n))
    row, token = np.concatenate(rows), np.concatenate(tokens)
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (token[1:] != token[:-1])]
    return row[new], token[new]


def set_keys(row: np.ndarray, token: np.ndarray, rows: int, clashes: tuple[np.ndarray, ...] = (), bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each row's set, its node and a further hash, both of 64 bits (0 for an empty set).

    The node is a hash of ``bits`` bits. ``clashes`` lists nodes that different sets were found to share: these take another
    hash, list by list.
    """
    size = np.bincount(row, minlength=rows)
    halves = []
    for salt in (0x51, 0xA7C3):
        total = np.r_[np.uint64(0), np.cumsum(mix64(token ^ mix64(np.array([salt], np.uint64))), dtype=np.uint64)]
        end = np.cumsum(size)
        halves.append(mix64(total[end] - total[end - size] + size.astype(np.uint64)))
    node, half = halves
    node = node >> np.uint64(64 - bits)
    for shared in clashes:
        node = np.where(np.isin(node.view(np.int64), shared), mix64(node ^ mix64(half)), node)
    return size, *(np.where(size > 0, h, 0).view(np.int64) for h in (node, half))


def parity_sketches(row: np.ndarray, token: np.ndarray, rows: int) -> np.ndarray:
    """rows x SKETCH_WORDS: of the tokens that fall on each bit, whether they are odd in number.

    Each token in which two sets differ turns one bit, so they differ in no fewer tokens than their sketches in bits.
    """
    bits = 64 * SKETCH_WORDS
    count = np.bincount(row * bits + ((token >> np.uint64(7)) % np.uint64(bits)).astype(np.int64), minlength=rows * bits)
    return np.packbits((count & 1).astype(np.uint8).reshape(rows, bits), axis=1).view(np.int64)


def _like_sizes(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _may_link(n: str, m: str, s: list[str], t: list[str], percent: int) -> Column:
    """Whether two sets can be similar enough by their sizes and sketches; exact: no pair that links fails it."""
    n, m = F.col(n), F.col(m)
    apart = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(s, t, strict=True)), F.lit(0))
    return _like_sizes(n, m, percent) & ((100 + percent) * apart <= (100 - percent) * (n + m))


def signatures(row: np.ndarray, token: np.ndarray, size: np.ndarray, percent: int = PERCENT, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of each set, for its own band and for the band below where a smaller partner can stand there.

    ``common`` lists tokens, sorted, that very many sets have.
    """
    plan = bands(percent)
    low = np.array([b.low for b in plan])
    high, segments, deletions, spare = (np.array([getattr(b, n) for b in plan]) for n in ("high", "segments", "deletions", "spare"))
    own = np.searchsorted(low, np.maximum(size, 1), "right") - 1
    below = np.maximum(own - 1, 0)
    rare = np.ones(len(token), bool)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, token), len(common) - 1)] != token
    out_rows, out = [], []
    for band, live in ((own, size > 0), (below, (size > 0) & (own > 0) & (100 * high[below] >= percent * size))):
        m = np.where(live, segments[band], 0)
        base = np.cumsum(m) - m
        used = m[row] > 0
        r, t = row[used], token[used]
        if not len(r):
            continue
        slot = base[r] + ((t >> np.uint64(20)) % m[r].astype(np.uint64)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, r, t, uncommon = slot[order], r[order], mix64(t[order]), rare[used][order]
        heads = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        content, filled, few = np.zeros(int(m.sum()), np.uint64), np.bincount(slot, minlength=int(m.sum())), np.bincount(slot[uncommon], minlength=int(m.sum()))
        content[slot[heads]] = np.add.reduceat(t, heads)
        owner = np.repeat(np.arange(len(m)), m)
        tag = mix64((band[owner].astype(np.uint64) << np.uint64(40)) + (np.arange(len(owner)) - base[owner]).astype(np.uint64) + np.uint64(1))
        # The order of a set's segments: uncommon tokens, tokens, a hash of the content, and the segment's number.
        worth = np.minimum(few, 15).astype(np.uint64) << np.uint64(60) | np.minimum(filled, 15).astype(np.uint64) << np.uint64(56) | mix64(content) >> np.uint64(8)
        ranked = np.lexsort((worth, owner))
        keep = ranked[np.arange(len(owner)) - base[owner] >= spare[band][owner]]
        out_rows.append(owner[keep])
        out.append(mix64(content[keep] ^ tag[keep]))
        near = deletions[band[r]]
        out_rows.append(r[near])
        out.append(mix64((content[slot[near]] - t[near]) ^ tag[slot[near]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_rows), np.concatenate(out)


def document_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, clashes: tuple[np.ndarray, ...] = (), bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, node, half, s0, ...: each document's set size, the two halves of its set's hash, its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                found = shingle_sets(data, offsets, k)
                size, a, b = set_keys(*found, last - first, clashes, bits)
                sketch = [pa.array(np.ascontiguousarray(c)) for c in parity_sketches(*found, last - first).T]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(size, pa.int64()), pa.array(a), pa.array(b), *sketch], names=["doc_id", "n_shingles", "node", "half", *SKETCH])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, node long, half long, " + ", ".join(f"{c} long" for c in SKETCH))


def named_sets(texts: DataFrame, k: int = SHINGLE, bits: int = 64, table: Callable[..., DataFrame] = document_keys) -> tuple[DataFrame, tuple[np.ndarray, ...]]:
    """``table`` (by default document_keys) of the texts such that different sets have different nodes, and the clashes that this took.

    Of n sets some n * n / 2 ** 65 pairs clash (270 of 10 ** 11 sets); only these few nodes come to the driver.
    """
    clashes: tuple[np.ndarray, ...] = ()
    while True:
        keys = materialise(table(texts, k=k, clashes=clashes, bits=bits), "set-keys")
        shared = keys.groupBy("node").agg(F.min("half").alias("low"), F.max("half").alias("high")).where("low != high")
        found = shared.select("node").toArrow()["node"].to_numpy()
        if not len(found):
            return keys, clashes
        clashes = (*clashes, found)


def common_tokens(texts: DataFrame, rows: int, k: int = SHINGLE, text_col: str = "text") -> np.ndarray:
    """Tokens, sorted, that COMMON_SHARE of some SAMPLE_TEXTS of the ``rows`` texts have, COMMON_TOKENS of them at most."""
    every = max(1, rows // SAMPLE_TEXTS)
    picked = texts.select(text_col).where(F.length(text_col) <= SAMPLE_CHARS).where(F.pmod(F.xxhash64(text_col), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(0)):
                row, token = shingle_sets(data, offsets, k)
                _, node, _ = set_keys(row, token, last - first)
                once = np.zeros(last - first, bool)
                once[np.unique(node, return_index=True)[1]] = True
                yield pa.RecordBatch.from_arrays([pa.array(token[once[row]].view(np.int64))], names=["token"])

    counted = picked.mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    least = max(8, math.ceil(COMMON_SHARE * min(rows, SAMPLE_TEXTS)))
    held = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(COMMON_TOKENS).select("token").toArrow()
    return np.sort(held["token"].to_numpy().view(np.uint64))


def shared_signatures(docs: DataFrame, text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, clashes: tuple[np.ndarray, ...] = (), bits: int = 64, common: np.ndarray | None = None) -> DataFrame:
    """signature, node: the signatures that at least two different nodes have, each (signature, node) once.

    Each chunk of texts emits a (signature, node) once however many copies it holds, so a signature's rows are bounded by
    its different nodes and the number of chunks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for first, last, data, offsets in chunks(batch.column(0)):
                row, token = shingle_sets(data, offsets, k)
                size, node, _ = set_keys(row, token, last - first, clashes, bits)
                fresh = np.array([n not in seen and not seen.add(n) for n in node.tolist()], bool) & (size > 0)
                kept = fresh[row]
                owner, signature = signatures(row[kept], token[kept], np.where(fresh, size, 0), percent, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(node[owner])], names=["signature", "node"])

    rows = docs.select(text_col).mapInArrow(run, "signature long, node long")
    # One shuffle of the signatures is what the disk allows; counting first and joining then takes three times as much.
    same = Window.partitionBy("signature")
    met = rows.withColumn("low", F.min("node").over(same)).withColumn("high", F.max("node").over(same)).where("low != high")
    return met.select("signature", "node").distinct()


def shared_only(rows: DataFrame) -> DataFrame:
    """signature, node: each once, of the signatures that at least two different nodes have.

    Signatures are counted first, then their rows are picked by a join, whose crowded signatures Spark can split.
    """
    met = rows.groupBy("signature").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("signature")
    return rows.join(met, "signature").select("signature", "node").distinct()


def verified(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sets have 100 * intersection >= percent * union. ``texts``: node, text."""
    one, other = texts.select(F.col("node").alias("a"), F.col("text").alias("__a")), texts.select(F.col("node").alias("b"), F.col("text").alias("__b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lambda row, token: mix64(token ^ mix64(row.astype(np.uint64) + np.uint64(1)))
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(3)):
                part = batch.slice(first, last - first)
                row, token = shingle_sets(data, offsets, k)
                held = [(r + at, t) for at, end, d, o in chunks(part.column(2)) for r, t in [shingle_sets(d, o, k)]]
                other_row, other_token = (np.concatenate(x) for x in zip(*held, strict=True))
                common = np.bincount(row[np.isin(code(row, token), code(other_row, other_token))], minlength=len(part))
                either = np.bincount(row, minlength=len(part)) + np.bincount(other_row, minlength=len(part)) - common
                keep = (common > 0) & (100 * common >= percent * either)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in part.columns[:2]], names=["a", "b"])

    return pairs.join(other, "b").join(one, "a").select("a", "b", "__a", "__b").mapInArrow(run, "a long, b long")


def _texts_of(joined: DataFrame, k: int, clashes: tuple[np.ndarray, ...] = (), bits: int = 64) -> DataFrame:
    """node, text of the rows whose text really has the node's set: an id that several texts share brings the others along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_numpy()
            for first, last, data, offsets in chunks(batch.column(1)):
                node = set_keys(*shingle_sets(data, offsets, k), last - first, clashes, bits)[1]
                yield batch.slice(first, last - first).filter(pa.array(node == wanted[first:last]))

    return joined.select("node", "text").mapInArrow(run, "node long, text string").groupBy("node").agg(F.first("text").alias("text"))


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


Screen = Callable[[DataFrame], DataFrame]


def by_sketches(marks: DataFrame, percent: int = PERCENT) -> Screen:
    """Leaves out pairs that can't link by size and sketch (``marks``: node, n, s0, ...)."""
    theirs = [f"t{i}" for i in range(SKETCH_WORDS)]
    other = marks.select(F.col("node").alias("b"), F.col("n").alias("m"), *(F.col(c).alias(d) for c, d in zip(SKETCH, theirs, strict=True)))
    return lambda pairs: pairs.join(other, "b").join(marks.withColumnRenamed("node", "a"), "a").where(_may_link("n", "m", SKETCH, theirs, percent)).select("a", "b")


def near_by_sketches(percent: int = PERCENT) -> Near:
    """The same in a join that has both sides' size, s0, ... at hand."""
    return lambda mine, theirs: _may_link(mine[0], theirs[0], mine[1:], theirs[1:], percent)


def tokens_of(texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """node, token: the set of each row of ``texts`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                row, token = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(row)), pa.array(token.view(np.int64))], names=["node", "token"])

    return texts.select("node", "text").mapInArrow(run, "node long, token long")


def linked_nodes(shared: DataFrame, sizes: DataFrame, texts: DataFrame, screen: Screen, k: int = SHINGLE, percent: int = PERCENT, rounds: int = HUB_ROUNDS, crowded: int = CROWDED, near: Near | None = None) -> DataFrame:
    """node, component of all nodes of ``shared`` (signature, node), linked where sets are similar enough.

    ``sizes`` has each node's set size n; ``screen`` leaves out pairs (a, b) that can't link before texts are fetched, ``near``
    some of them by n and further columns of ``sizes`` in the join that makes them.
    """
    parts = shared.select("node").distinct().join(sizes.select("node", "n"), "node").withColumn("component", F.col("node"))
    links, tested = None, None
    for turn in range(rounds):
        # A component's envoy differs from signature to signature and from round to round.
        envoys = shared.join(parts, "node").groupBy("signature", "component").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", "signature", F.lit(turn)) if turn else F.col("node")).alias("envoy"))
        lead = envoys.groupBy("signature").agg(F.min(F.struct("component", "envoy")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("signature", "lead")
        alike = envoys.join(lead, "signature").where("component != lead.component").where(_like_sizes(F.col("lead.envoy.n"), F.col("envoy.n"), percent))
        pairs = _untested(alike.select(F.col("lead.envoy.node").alias("x"), F.col("envoy.node").alias("y")), tested, screen)
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = materialise(verified(pairs, texts, k, percent), "links")
        if not found.limit(1).count():
            break
        links = found if links is None else links.unionByName(found)
        parts = _merged(parts, found)
    placed = materialise(shared.join(parts, "node"), "placed")
    still = placed.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("signature")
    left = materialise(placed.join(still, "signature"), "open")
    if left.limit(1).count():
        pairs = _untested(open_pairs(left, tokens_of(texts, k), percent, crowded, sizes.withColumnRenamed("n", "size") if near else None, near), tested, screen)
        found = materialise(verified(pairs, texts, k, percent), "links")
        links = found if links is None else links.unionByName(found)
    return parts if links is None else _joined(parts, links)


def _untested(pairs: DataFrame, tested: DataFrame | None, screen: Screen) -> DataFrame:
    """Each pair (a < b) once, without those of ``tested`` and those that can't link."""
    pairs = screen(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return materialise(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")


def _component_links(parts: DataFrame, links: DataFrame) -> DataFrame:
    """a, b: the different components that ``links`` (a, b: nodes) join, a < b."""
    one, other = parts.select(F.col("node").alias("a"), F.col("component").alias("x")), parts.select(F.col("node").alias("b"), F.col("component").alias("y"))
    return links.join(one, "a").join(other, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` after each component took the least one that it is linked with, and that one's least in turn.

    Chains of links may need more rounds than this one; what stays apart is joined by ``_joined`` in the end.
    """
    lower = _component_links(parts, links).groupBy(F.col("b").alias("component")).agg(F.min("a").alias("into"))
    beyond = lower.select(F.col("component").alias("into"), F.col("into").alias("beyond"))
    lower = lower.join(beyond, "into", "left").select("component", F.coalesce("beyond", "into").alias("into"))
    return materialise(parts.join(lower, "component", "left").select("node", "n", F.coalesce("into", "component").alias("component")), "parts")


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` with all components joined that ``links`` connect."""
    between = materialise(_component_links(parts, links), "between")
    if not between.limit(1).count():
        return parts
    whole = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("into"))
    return materialise(parts.join(whole, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "parts")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links), one row per row of ``docs``.

    Words are runs without white space, A-Z lower-cased. Texts without words, empty and null texts have an empty set and
    link with nothing. Rows with a null id keep their set size and have no component; nothing is linked through them. Rows
    that repeat an id keep one row each, and the id's sets are linked through it only if they are similar. Other columns are
    not read. A text is held whole by one worker at a time, some fifty bytes a character.
    """
    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    keys, clashes = named_sets(texts, k, bits)
    usable = texts.where("doc_id is not null")
    common = common_tokens(usable, keys.count(), k)
    shared = materialise(shared_signatures(usable, "text", k, percent, clashes, bits, common), "signatures")
    # Copies are one row a task before the shuffle, so no node has many.
    marks = one_per_node(keys, SKETCH).join(shared.select("node").distinct(), "node", "left_semi")
    marks = materialise(marks, "marks")
    return grouped(keys.drop(*SKETCH), marks, shared, usable, by_sketches(marks.drop("doc_id"), percent), k, percent, clashes, bits, near_by_sketches(percent))


def one_per_node(keys: DataFrame, more: list[str]) -> DataFrame:
    """node, doc_id (the least), n and the columns ``more`` of each node that a row with an id has."""
    return keys.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in more))


def grouped(keys: DataFrame, marks: DataFrame, shared: DataFrame, texts: DataFrame, screen: Screen, k: int, percent: int, clashes: tuple[np.ndarray, ...], bits: int, near: Near | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of ``keys`` (doc_id, n_shingles, node, half), linked among the nodes of ``shared``.

    ``marks`` has node, doc_id and n of these nodes, ``texts`` the doc_id and text of all rows with an id.
    """
    leaders = marks.select("node", "doc_id")
    held = materialise(_texts_of(texts.join(_few(leaders), "doc_id"), k, clashes, bits), "texts")
    parts = linked_nodes(shared, marks.drop("doc_id"), held, screen, k, percent, near=near)
    least = parts.join(leaders, "node").groupBy("component").agg(F.min("doc_id").alias("part_id"))
    classes = keys.where("n_shingles > 0 and doc_id is not null").groupBy("node", "half").agg(F.min("doc_id").alias("least"))
    named = materialise(classes.join(parts.join(least, "component").select("node", "part_id"), "node", "left").select("node", "half", F.coalesce("part_id", "least").alias("component_id")), "classes")
    out = keys.join(named, ["node", "half"], "left")
    found = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"))


#: The groups of near-duplicates in DuckDB's SQL: all pairs that share a shingle, and all that links reach.
_GROUPS_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(a[p + 1 : p + $K], ' ') AS k
  FROM (SELECT doc_id, a, unnest(range(0, greatest(len(a) - $K + 1, least(len(a), 1)))) AS p FROM texts)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y USING (k) WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 85 * (s.n + t.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM texts UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a)
SELECT t.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.component_id$MORE
FROM texts t LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) m USING (doc_id)
"""
OP7_SQL = _GROUPS_SQL.replace("$K", "4").replace("$MORE", "")
OP11_SQL = _GROUPS_SQL.replace("$K", "5").replace("$MORE", ", t.doc_id = m.component_id AS kept")
