"""Benchmark decontamination by pigeonhole edit matching.

An item of m normalised characters may differ in k = floor(m * error rate) edits. Cut into k + 1 pieces, at least one piece
stands unchanged in any passage within k edits. One Aho-Corasick automaton over the pieces of a block of items finds the
pieces in a text. The pieces of an item are the leaves of a binary tree: of a passage within k edits, some piece stands
there whose every ancestor of n pieces has at most n - 1 edits. So a hit climbs from its piece to the whole item, and Myers'
bit-parallel distance decides at each step, exactly; most hits end at the first step. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tidegauge.llm.columns import col, fresh, mapped_in_arrow

ERROR_RATE = 0.1
#: Characters of items that one broadcast block holds; more items mean more blocks, not a larger one.
BLOCK_CHARS = 1 << 20

_WORD = re.compile(r"[^\W_]+")
#: Latin-1 letters and digits as they are, all other bytes as blanks.
_LATIN = bytes(c if _WORD.match(chr(c)) else 0x20 for c in range(256))


def normalised(text: str) -> str:
    """Lower-cased runs of letters and digits, one blank around each."""
    text = text.lower()
    try:
        runs = text.encode("latin-1").translate(_LATIN).split()
    except UnicodeEncodeError:
        return " ".join(["", *_WORD.findall(text), ""])
    return b" ".join([b"", *runs, b""]).decode("latin-1")


class Pattern:
    """Myers' bit-parallel distance of a pattern to the substrings of a text."""

    def __init__(self, pattern: str) -> None:
        self.size = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, budget: int, any_end: bool = False) -> tuple[int, int] | None:
        """(distance, end) of the closest substring within ``budget`` edits, the first such end; with ``any_end``, of some."""
        mask, full, top = self.masks.get, (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score, best, room = full, 0, self.size, None, budget
        for end, c in enumerate(text, 1):
            eq = mask(c, 0)
            diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | ~(diagonal | plus) & full
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1 & full, down << 1 & full
            plus = down | ~(diagonal | up) & full
            minus = up & diagonal
            if score <= room:
                best, room = (score, end), score - 1
                if any_end or not score:
                    break
        return best


def best_match(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of ``text`` closest to ``pattern`` within ``budget`` edits, the first such end."""
    return Pattern(pattern).best(text, budget)


class Item:
    """An item's pattern, its pieces (begin, end) and, for each piece, its ancestors below the whole from the piece up.

    ``beside`` has for each piece what its nearest ancestor holds besides, as begin, end, edits and one part more than edits.
    """

    def __init__(self, item: int, pattern: str, budget: int) -> None:
        self.item, self.pattern, self.budget, self.whole = item, pattern, budget, Pattern(pattern)
        at = [len(pattern) * i // (budget + 1) for i in range(budget + 2)]
        self.pieces = list(zip(at, at[1:], strict=False))
        self.above: list[list[tuple[int, int, int, Pattern]]] = [[] for _ in self.pieces]
        self.beside: list[tuple[int, int, int, list[str]] | None] = [None] * len(self.pieces)
        open_nodes = [(0, budget + 1)]
        while open_nodes:
            low, high = open_nodes.pop()
            if high - low < 2:
                continue
            middle, edits = (low + high) // 2, high - low - 1
            if edits < budget:
                node = (at[low], at[high], edits, Pattern(pattern[at[low] : at[high]]))
                for piece in range(low, high):
                    self.above[piece].insert(0, node)
            for piece, alone, a, b in ((low, middle - low == 1, at[middle], at[high]), (middle, high - middle == 1, at[low], at[middle])):
                if alone:
                    cut = [a + (b - a) * i // (edits + 1) for i in range(edits + 2)]
                    self.beside[piece] = a, b, edits, [pattern[x:y] for x, y in zip(cut, cut[1:], strict=False)]
            open_nodes += [(low, middle), (middle, high)]


class ItemIndex:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE) -> None:
        self.items: list[Item] = []
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for item, text in items:
            core = normalised(text).strip()
            if not core:
                continue
            budget = int(len(core) * error_rate)
            self.items.append(Item(item, core if budget else f" {core} ", budget))
            for n, (a, b) in enumerate(self.items[-1].pieces):
                pieces.setdefault(self.items[-1].pattern[a:b], []).append((len(self.items) - 1, n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None, first_only: bool = False) -> dict[int, tuple[int, int]]:
        """item -> (distance, end in the normalised text) of its best match; with ``first_only``, of any one item."""
        if not text or not self.items:
            return {}
        flat, tried, found = normalised(text), set(), {}
        for last, (size, places) in self.automaton.iter(flat):
            for k, piece, offset in places:
                start = last - size + 1 - offset
                if (k, start) in tried:
                    continue
                own = self.items[k]
                if start >= 0 and flat.startswith(own.pattern, start):
                    hit = 0, start + len(own.pattern)
                elif not own.budget or not self._climbs(own, piece, flat, start):
                    continue
                else:
                    low = max(0, start - own.budget)
                    near = own.whole.best(flat[low : max(0, start + len(own.pattern) + own.budget)], own.budget)
                    hit = (near[0], low + near[1]) if near else None
                tried.add((k, start))
                if hit and (own.item not in found or hit < found[own.item]):
                    found[own.item] = hit
                    if first_only:
                        return found
        return found

    @staticmethod
    def _climbs(own: Item, piece: int, flat: str, start: int) -> bool:
        """Whether each ancestor of the piece stands around it within its share of the edits.

        Of the parts beside the piece, one more than there are edits, some must stand there unchanged: a quick test first.
        """
        a, b, edits, parts = own.beside[piece]
        around = flat[max(0, start + a - edits) : max(0, start + b + edits)]
        if not any(part in around for part in parts):
            return False
        for a, b, budget, pattern in own.above[piece]:
            if not pattern.best(flat[max(0, start + a - budget) : max(0, start + b + budget)], budget, any_end=True):
                return False
        return True


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one on the driver at a time. Null and empty items match nothing."""
    usable = items.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(id_col, text_col)
    chars = usable.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = -(-chars // block_chars)
    for block in range(n):
        yield [tuple(r) for r in usable.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == block).distinct().collect()]


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, end_pos: each item that stands in a text within its error budget, at its best place.

    Texts and items are compared as lower-case letters and digits with single blanks; an item too short for one edit must
    stand there exactly, as whole words. Null and empty texts match nothing. ``end_pos`` counts normalised characters.
    Repeated rows of ``docs`` give repeated rows, rows with a null id null ids; items with a null id are left out. Other
    columns are not read. A text takes time in proportion to its length and to the pieces that stand in it.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, distance int, end_pos int"
    out = spark.createDataFrame([], schema)
    for k, block in enumerate(item_blocks(items, item_id_col, item_text_col)):
        shared = spark.sparkContext.broadcast((block, error_rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*shared.value)
            for batch in batches:
                rows = [(r, item, distance, end) for r, text in enumerate(batch.column(1)) for item, (distance, end) in index.matches(text.as_py()).items()]
                at, item, distance, end = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, item_type), pa.array(distance, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "item_id", "distance", "end_pos"])

        item_type = pa.string() if item_kind == "string" else pa.int32() if item_kind == "int" else pa.int64()
        part = docs.select(col(id_col), col(text_col)).mapInArrow(run, schema)
        out = part if k == 0 else out.unionByName(part)
    return out


def mark_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, flag: str | None = None) -> DataFrame:
    """``docs`` with a boolean last: whether any item stands in the text (see ``find_items``). One row per row, all columns.

    The column is called ``flag``, or by a name that ``docs`` hasn't, whatever its columns are called. Null and empty texts,
    and any text without items, are false.
    """
    flag = flag or fresh(docs, "__contaminated")[0]
    out, at = docs.withColumn(flag, F.lit(False)), docs.columns.index(text_col)
    for block in item_blocks(items, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast((block, error_rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(*shared.value)
            for batch in batches:
                before = batch.column(batch.num_columns - 1).to_pylist()
                marks = [b or bool(index.matches(t.as_py(), first_only=True)) for b, t in zip(before, batch.column(at), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, pa.bool_())], schema=batch.schema)

        out = mapped_in_arrow(out, run, StructType([*docs.schema.fields, StructField(flag, BooleanType())]))
    return out
