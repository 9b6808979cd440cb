"""Benchmark decontamination with spaced-seed hashing.

Texts become word sequences in lower case.  Fixed masks read some places of a window and ignore the others,
so a window still meets its test item when a word at an ignored place was substituted.  Test
hashes are joined with those of every window of every document; around each hit the two
sequences are laid over each other and the longest stretch whose words agree for ``percent`` per cent,
with agreeing ends, is measured.  A stretch of ``min_words`` words (the whole item, if shorter) confirms an overlap.
Every stretch that the rule confirms at 80 per cent holds a seed, wherever its substitutions lie.

The test side is broadcast in blocks of at most ``block_words`` words; more items mean more blocks.

Cases: null or empty texts have no words and never overlap; items of fewer than ``shortest`` words are
too short to tell and are left out; rows that repeat an item_id are different items of one name; repeated
rows give repeated results only once per doc_id and item; documents with a null doc_id count as one; an
empty table (of documents or of tests) gives no rows; further columns are ignored.  Texts and items may be of any length:
words are hashed in slices, and a laid pair of sequences is measured in time and memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsmith.llm.common import text_or_empty
from roundsmith.llm.words import NO_WORD, WordHasher, slices

#: Places that count (1) and are ignored (0). The second group serves items of fewer than ten words.
MASKS = ("11111", "111011", "11001011")
SHORT_MASKS = ("1111", "11011", "10111", "11101")
_M = np.uint64(0x9E3779B97F4A7C15)
#: Signs beyond ASCII that part words.
_SIGNS = r"[\x{2000}-\x{206F}\x{3000}-\x{3003}\x{3008}-\x{3020}\x{A0}\x{A1}\x{AB}\x{B7}\x{BB}\x{BF}]"


def _places(mask: str) -> list[int]:
    return [p for p, c in enumerate(mask) if c == "1"]


def seed_hashes(ids: np.ndarray, begin: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the counting places of the windows that begin at ``begin``."""
    h = np.full(len(begin), len(mask), np.uint64)
    for p in _places(mask):
        h = (h ^ ids[begin + p].astype(np.uint64)) * _M
        h ^= h >> np.uint64(29)
    return h


def best_stretch(same: np.ndarray, percent: int) -> tuple[int, int, int]:
    """(begin, end, agreeing) of the longest stretch with agreeing ends and ``percent`` agreement."""
    hits = np.flatnonzero(same)
    if len(hits) == 0:
        return 0, 0, 0
    # With s(i) = 100 * agreeing - percent * length up to i, a stretch (a, b] is fit if s(b) >= s(a).
    s = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
    # Only a begin below all before it, and an end above all after it, can bound the longest stretch.
    low, high = s[hits], s[hits + 1]
    begins = np.flatnonzero(low < np.concatenate([[np.iinfo(np.int64).max], np.minimum.accumulate(low)[:-1]]))
    ends = np.flatnonzero(high > np.concatenate([np.maximum.accumulate(high[::-1])[::-1][1:], [np.iinfo(np.int64).min]]))[::-1]
    # Ends from the last one backwards grow in height; the first that is high enough is the furthest.
    at = ends[np.searchsorted(high[ends], low[begins])]
    k = int((hits[at] - hits[begins]).argmax())
    a, b = int(begins[k]), int(at[k])
    return int(hits[a]), int(hits[b]) + 1, b - a + 1


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.replace_substring_regex(texts, pattern=_SIGNS, replacement=" "))


class Items:
    """The test side: the words' hashes, item sequences, and each mask's sorted seeds."""

    def __init__(self, items: list[tuple[int, str]], shortest: int, few: int = 10):
        hashes, first = WordHasher(NO_WORD).column(_lower(pa.array([t or "" for _, t in items], pa.string())))
        self.words, ids = np.unique(hashes, return_inverse=True)
        ids = ids.astype(np.int32)
        self.items = [(item_id, ids[a:b]) for (item_id, _), a, b in zip(items, first[:-1], first[1:]) if b - a >= shortest]
        self.seeds = []
        for mask in MASKS + SHORT_MASKS:
            h, item, at = [], [], []
            for i, (_, own) in enumerate(self.items):
                begin = np.arange(len(own) - len(mask) + 1)
                if len(begin) and (len(own) < few or mask in MASKS):
                    h.append(seed_hashes(own, begin, mask)), item.append(np.full(len(begin), i)), at.append(begin)
            if not h:
                continue
            h, item, at = map(np.concatenate, (h, item, at))
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[h >> np.uint64(44)] = True
            self.seeds.append((mask, h[order], item[order], at[order], bits))

    def laid(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct (document, item, first word of the document that lies on the item's first), from all hits."""
        held = np.flatnonzero(ids >= 0)
        stop = np.repeat(first[1:], np.diff(first))
        found = []
        for mask, hashes, item, at, bits in self.seeds:
            begin = held[held + len(mask) <= stop[held]] if len(held) else held
            for p in _places(mask)[1:]:
                begin = begin[ids[begin + p] >= 0]
            h = seed_hashes(ids, begin, mask)
            some = bits[h >> np.uint64(44)]
            begin, h = begin[some], h[some]
            a, b = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            n = b - a
            of = np.repeat(np.arange(len(n)), n)
            seed = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + a[of]
            doc = np.searchsorted(first, begin[of], "right") - 1
            found.append(np.unique(np.column_stack([doc, item[seed], begin[of] - first[doc] - at[seed]]), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def overlaps(self, texts: pa.Array, percent: int, min_words: int) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item_id, first word in the text, first word in the item, length, agreeing words), the longest of each row and item."""
        hashes, first = WordHasher(NO_WORD).column(_lower(texts))
        if len(hashes) == 0 or len(self.words) == 0:
            return []
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        ids = np.where(self.words[at] == hashes, at, -1).astype(np.int32)
        best: dict[tuple[int, int], tuple] = {}
        for row, i, shift in self.laid(ids, first).tolist():
            item_id, seq = self.items[i]
            own = ids[first[row]:first[row + 1]]
            lo, hi = max(0, -shift), min(len(seq), len(own) - shift)
            a, b, agree = best_stretch(own[lo + shift:hi + shift] == seq[lo:hi], percent)
            if b - a >= min(len(seq), min_words) and ((row, i) not in best or best[row, i][4] < b - a):
                best[row, i] = (row, item_id, lo + a + shift, lo + a, b - a, agree)
        return list(best.values())


def overlaps(docs: DataFrame, benchmark: DataFrame, percent: int = 80, min_words: int = 10, shortest: int = 5, block_words: int = 2_000_000) -> DataFrame:
    """One row per document and test item that it overlaps: doc_id, item_id, doc_start, item_start, n_words, n_same."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    schema = "doc_id long, item_id long, doc_start int, item_start int, n_words int, n_same int"
    total = tests.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))

    def one(block: int) -> DataFrame:
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about block_words words
        held = spark.sparkContext.broadcast(Items(sorted({(r.item_id, r.text) for r in rows}, key=str), shortest))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in slices(batches):
                out = items.overlaps(batch.column("text"), percent, min_words)
                rows = batch.column("doc_id").take(pa.array([r[0] for r in out], pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, *(pa.array([r[c] for r in out], pa.int64() if c == 1 else pa.int32()) for c in range(1, 6))], names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_same"])

        return source.mapInArrow(run, schema)

    found = reduce(DataFrame.union, map(one, range(int(blocks)))).groupBy("doc_id", "item_id")
    longest = found.agg(F.max(F.struct("n_words", "n_same", (-F.col("doc_start")).alias("d"), "item_start")).alias("o"))
    return longest.select("doc_id", "item_id", (-F.col("o.d")).alias("doc_start"), F.col("o.item_start").alias("item_start"), F.col("o.n_words").alias("n_words"), F.col("o.n_same").alias("n_same"))
