"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

No piece of the vocabulary holds the space mark after another character, nor a character that only stands alone, so no
merge crosses the border before a run of space marks or around such a character. A text is therefore cut there into words;
the words a worker has not met lately are laid out as one flat numpy array of symbols and merged together, round by round.
Words of very many symbols, as texts without spaces have them, would take a round for nearly every merge; they are merged
one by one from a heap of pairs instead, in the same order.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm.columns import col
from tidegauge.llm.textbytes import chunks

MARK = "▁"
#: Words a worker remembers at most, characters of the longest of these, and bytes of texts whose new words are merged together.
CACHE_WORDS, CACHED_CHARS, ROUND_BYTES = 200_000, 256, 1 << 19
#: Symbols from which on a word is merged from a heap.
LONG_WORD = 512

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PieceModel:
    """The merge table of a vocabulary: (left symbol, right symbol) -> (rank, merged symbol), as sorted arrays.

    Symbols are piece ids, or the vocabulary size plus the code point for a character that is no piece.
    """

    def __init__(self, pieces: list[str], scores: np.ndarray, kinds: np.ndarray) -> None:
        self.size, self.pieces = len(pieces), pieces
        normal = [i for i in range(self.size) if kinds[i] == 0]
        self.ids = {pieces[i]: i for i in normal}
        self.byte_ids = {int(pieces[i][1:-1], 16): i for i in range(self.size) if kinds[i] == 1}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        if len(self.byte_ids) != 256:
            raise ValueError("a vocabulary with byte fallback is needed")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        order = np.unique(-scores[normal], return_inverse=True)[1]
        rank = dict(zip(normal, order.tolist(), strict=True))
        symbol = lambda s: self.ids.get(s, self.size + ord(s) if len(s) == 1 else -1)
        rows = [(a, b, rank[i], i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := symbol(p[:k])) >= 0 and (b := symbol(p[k:])) >= 0]
        a, b, r, m = np.array(rows, np.int64).reshape(-1, 4).T
        keys = a << 32 | b
        at = np.argsort(keys)
        self.keys, self.ranks, self.merged, self.table = keys[at], r[at], m[at], None
        self._hash_pairs()
        # A rank is safe if all its pairs may merge at once: one piece has it, and no pair with that piece ranks better.
        best = np.full(self.size, np.iinfo(np.int64).max)
        for side in (a, b):
            inside = side < self.size
            np.minimum.at(best, side[inside], r[inside])
        self.safe = np.ones(int(order.max(initial=0)) + 2, bool)
        np.logical_and.at(self.safe, order, best[normal] > order)
        self.safe[: order.max(initial=0) + 1] &= np.bincount(order, minlength=int(order.max(initial=0)) + 1) == 1
        joined = set("".join(p for p in self.ids if len(p) > 1))
        self.splits_lines = "\n" not in joined
        # By id, the last for a character that is no piece.
        self.digits = [*map(str, range(self.size)), ""]
        self.spoken = [*(p.replace(MARK, " ") for p in pieces), ""]
        self.digit_sizes, self.spoken_sizes = np.array([len(d) + 1 for d in self.digits]), np.array(list(map(len, self.spoken)))
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if self.splits_lines else f"{MARK}*[^{MARK}]+|{MARK}+")

    def _hash_pairs(self) -> None:
        """The merge table as a hash table with open addressing: slot_keys (-1: free), slots (where the pair is), probes needed."""
        self.slot_bits = max(8, int(np.ceil(np.log2(4 * max(len(self.keys), 1)))))
        mask = (1 << self.slot_bits) - 1
        self.slot_keys, self.slots = np.full(mask + 1, -1, np.int64), np.zeros(mask + 1, np.int64)
        open_pairs, self.probes = np.arange(len(self.keys)), 0
        slot = ((self.keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        while len(open_pairs):
            self.probes += 1
            free = self.slot_keys[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.slot_keys[taken], self.slots[taken] = self.keys[open_pairs[placed]], open_pairs[placed]
            left = np.ones(len(open_pairs), bool)
            left[placed] = False
            open_pairs, slot = open_pairs[left], (slot[left] + 1) & mask

    @classmethod
    def load(cls, spec: bytes) -> PieceModel:
        return cls(*read_pieces(spec))

    def words(self, text: str) -> list[str]:
        """The words of a text: space marks for spaces and one in front, unless the text is empty."""
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all ``words``, flat, and where each word's begin (one more than words)."""
        long = [len(w) >= LONG_WORD for w in words]
        if not any(long):
            return self._merge_rounds(words)
        flat, begins = self._merge_rounds([w for w, x in zip(words, long, strict=True) if not x])
        parts, at = [], 0
        for word, x in zip(words, long, strict=True):
            parts.append(self._merge_heap(word) if x else flat[begins[at] : begins[at + 1]])
            at += not x
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _merge_heap(self, word: str) -> np.ndarray:
        """Final symbols of one word: the best pair, of equal ones the leftmost, merges first."""
        symbols = self._symbols(word)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, found = self._pairs(symbols, np.zeros(n, np.int64), -1)
        at = np.flatnonzero(rank >= 0)
        symbols, heap = symbols.tolist(), list(zip(rank[at].tolist(), at.tolist(), symbols[at].tolist(), symbols[at + 1].tolist(), self.merged[found[at]].tolist(), strict=True))
        heapq.heapify(heap)
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        pair = self.table.get
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = merged, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if x := pair(merged << 32 | symbols[j]):
                    heapq.heappush(heap, (x[0], i, merged, symbols[j], x[1]))
            h = before[i]
            if h >= 0 and (x := pair(symbols[h] << 32 | merged)):
                heapq.heappush(heap, (x[0], h, symbols[h], merged, x[1]))
        return np.array([s for s in symbols if s >= 0], np.int64)

    def _symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        seen, back = np.unique(points, return_inverse=True)
        return np.array([self.ids.get(chr(c), self.size + c) for c in seen.tolist()], np.int64)[back]

    def _merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` in rounds over all words at once: in each, every word merges its pairs of least rank."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self._symbols("".join(words))
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        none = len(self.safe) - 1
        rank, found = self._pairs(symbols, word, none)
        while len(symbols):
            edges = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, edges)
            sizes = np.diff(np.r_[edges, len(word)])
            least_here = np.repeat(least, sizes)
            over = least_here == none
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                live = ~over
                symbols, word, rank, found, least_here = symbols[live], word[live], rank[live], found[live], least_here[live]
                if not len(symbols):
                    break
            chosen = self._leftmost(np.flatnonzero(rank == least_here), least_here, word)
            symbols[chosen] = self.merged[found[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            # Only pairs of a merged symbol with a neighbour are new.
            new = np.zeros(len(symbols), bool)
            new[chosen] = True
            symbols, word, rank, found, new = symbols[keep], word[keep], rank[keep], found[keep], new[keep]
            new[:-1] |= new[1:]
            at = np.flatnonzero(new)
            rank[at], found[at] = self._looked_up(symbols, word, at, none)
        flat, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbols, done_words))
        order = np.argsort(owner, kind="stable")
        return flat[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def _looked_up(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each symbol ``at`` with its right neighbour in the word, or ``none``, and where the merge table has the pair."""
        rank, found = np.full(len(at), none), np.zeros(len(at), np.int64)
        pair = np.flatnonzero(at + 1 < len(symbols))
        pair = pair[word[at[pair]] == word[at[pair] + 1]]
        key = symbols[at[pair]] << 32 | symbols[at[pair] + 1]
        slot = ((key.view(np.uint64) * _SPREAD) >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        for _ in range(self.probes):
            held = self.slots[slot]
            place = self.slot_keys[slot]
            hit = place == key
            rank[pair[hit]], found[pair[hit]] = self.ranks[held[hit]], held[hit]
            more = ~hit & (place >= 0)
            if not more.any():
                break
            pair, key, slot = pair[more], key[more], (slot[more] + 1) & ((1 << self.slot_bits) - 1)
        return rank, found

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each symbol with its right neighbour in the word, or ``none``, and where the merge table has the pair."""
        return self._looked_up(symbols, word, np.arange(len(symbols)), none)

    def _leftmost(self, best: np.ndarray, least_here: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of the positions with their word's least rank: all that don't overlap, from the left, or only the first of the word."""
        first = np.r_[True, word[best[1:]] != word[best[:-1]]]
        run = np.r_[True, np.diff(best) != 1] | first
        start = np.maximum.accumulate(np.where(run, np.arange(len(best)), 0))
        apart = (np.arange(len(best)) - start) % 2 == 0
        return best[np.where(self.safe[least_here[best]], apart, first)]

    def ids_of(self, symbols: list[int]) -> list[int]:
        """Symbols as ids; a character that is no piece becomes the ids of its UTF-8 bytes."""
        if not symbols or max(symbols) < self.size:
            return symbols
        return list(chain.from_iterable((s,) if s < self.size else [self.byte_ids[b] for b in chr(s - self.size).encode()] for s in symbols))

    def encode(self, text: str) -> list[int]:
        flat, _ = self.merge(self.words(text))
        return self.ids_of(flat.tolist())

    def surface(self, ids: list[int]) -> str:
        """Text of ids with space marks as spaces; bytes that aren't UTF-8 become U+FFFD, one each."""
        out, pending = [], bytearray()
        for i in [*ids, -1]:
            if i in self.bytes_of:
                pending.append(self.bytes_of[i])
                continue
            at = 0
            while at < len(pending):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(pending[at : at + k]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    k = 1
                    out.append("�")
                at += k
            pending.clear()
            if i >= 0:
                out.append(self.spoken[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the one space that stands for the mark put in front when encoding."""
        text = self.surface(ids)
        return text[1:] if ids and self.pieces[ids[0]].startswith(MARK) else text


def read_pieces(spec: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pieces, scores and kinds (0 normal, 1 byte, 2 other) of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=spec)
    n = model.get_piece_size()
    kinds = np.array([1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0 for i in range(n)])
    return [model.id_to_piece(i) for i in range(n)], np.array([model.get_score(i) for i in range(n)], np.float32), kinds


class Codec:
    """A worker's memory of words: word -> (ids as text, surface), in two generations.

    When the younger generation is full it becomes the older one, which goes; words met again meanwhile are young again. So
    frequent words stay and the memory is bounded. Words of more than CACHED_CHARS characters aren't kept.
    """

    def __init__(self, model: PieceModel, bound: int = CACHE_WORDS) -> None:
        self.model, self.bound = model, bound // 2
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def learn(self, words: set[str]) -> list[str]:
        """Makes the younger generation have all ``words``. Returns those to be forgotten after use, as they are too long."""
        new = words - self.young.keys()
        if len(self.young) + len(new) > self.bound:
            self.old, self.young = self.young, {}
            new = words
        again = new & self.old.keys()
        self.young.update((w, self.old[w]) for w in again)
        new = list(new - again)
        if new:
            self._encode(new)
        return [w for w in new if len(w) > CACHED_CHARS]

    def _encode(self, words: list[str]) -> None:
        """Puts the words into the younger generation."""
        model = self.model
        flat, begins = model.merge(words)
        known = np.minimum(flat, model.size)
        ids, spoken = ",".join(map(model.digits.__getitem__, known.tolist())), "".join(map(model.spoken.__getitem__, known.tolist()))
        ids_at, spoken_at = (np.r_[0, np.cumsum(size[known])][begins].tolist() for size in (model.digit_sizes, model.spoken_sizes))
        for k, word in enumerate(words):
            self.young[word] = ids[ids_at[k] : ids_at[k + 1] - 1], spoken[spoken_at[k] : spoken_at[k + 1]]
        # Words with a character that is no piece hold bytes.
        for k in np.unique(np.searchsorted(begins, np.flatnonzero(known == model.size), "right") - 1).tolist():
            own = model.ids_of(flat[begins[k] : begins[k + 1]].tolist())
            self.young[words[k]] = ",".join(map(str, own)), model.surface(own)

    def run(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids joined by commas, decoded text) of each text."""
        cut = [self.model.words(t) for t in texts]
        long, known = self.learn(set(chain.from_iterable(cut))), self.young
        for words in cut:
            told = list(map(known.__getitem__, words))
            decoded = "".join([t[1] for t in told])
            yield ",".join([t[0] for t in told]), decoded[1:] if words and words[0][0] == MARK else decoded
        for word in long:
            del known[word]


def encode_decode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ``ids`` array<int>, ``decoded`` on request), one row per row of ``docs``.

    A null text counts as empty: no ids, and an empty text decoded. Null and repeated ids are passed through. Other columns
    of ``docs`` are not read. A text takes time in proportion to its length, one without spaces a little more (a heap).
    """
    with open(model_file, "rb") as f:
        parts = docs.sparkSession.sparkContext.broadcast(read_pieces(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(PieceModel(*parts.value))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for whole in batches:
            for first, last, *_ in chunks(whole.column(1), ROUND_BYTES):
                batch = whole.slice(first, last - first)
                out: list[list] = [[] for _ in range(5)]
                for ids, decoded in codec.run([t or "" for t in batch.column(1).to_pylist()]):
                    for column, value in zip(out, (ids.count(",") + 1 if ids else 0, sha(ids), sha(decoded), [*map(int, ids.split(","))] if with_ids and ids else [], decoded if with_ids else ""), strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)][: 5 if with_ids else 3]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(col(id_col), col(text_col)).mapInArrow(run, schema)
