"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Training takes a bounded, documented sample of labelled documents (``max_examples``, by hash order).
The vocabulary is every word of every sampled example, without any selection.  A word weighs
(1 + ln count) * idf * relevance: document frequencies count the whole corpus, and the relevance frequency
log2(2 + toxic examples with it / other examples with it) is the usual factor of supervised term weighting;
it is 1 for a word that speaks for no side.  Vectors are of unit length.

All examples lie in blocks of ``BLOCK``, alike ones together; the index keeps the largest weight of each
word in each block, which bounds every cosine in the block.  Blocks are read in order of their bounds
until the bound falls below the k-th best cosine, so the neighbours are exact.  Votes weighted by
distance are calibrated by isotonic regression on leave-one-out votes of the examples.

Cases: a null or empty text, or one that shares no word with any example, has no neighbour and gets the
smoothed rate of such examples; words that no example holds can't match and don't count in a text's
length; ties between neighbours go to the smaller example number; repeated rows are scored row by row, and
copies teach once with the mean of their labels; rows of one doc_id with different texts teach each with that
doc_id's label; without labelled examples (or with an empty table of labels) every score is 0; an empty
table of documents gives no rows; further columns are ignored; texts may be of any length: words are hashed
in slices, and a text's distinct words are held whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsmith.llm.common import release, text_or_empty
from roundsmith.llm.words import NO_WORD, WordHasher, slices

BLOCK = 64


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after the other, and the number of each one's range."""
    n = end - begin
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + begin[of], of


class BlockMaxIndex:
    """Inverted index of unit vectors (terms, weights), with a maximum for each term and block.

    The lists of terms that a ``full``th of all examples hold are kept as full rows, all others as postings.  A worker
    holds some 20 bytes for each word of each example.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list, n_terms: int, full: int = 16):
        order = self._alike(vectors, labels, n_terms)
        self.labels, self.ids = np.asarray(labels, np.float64)[order], [ids[i] for i in order]
        self.n, self.n_blocks = len(order), max(1, -(-len(order) // BLOCK))
        self.read = self.asked = 0
        rows = np.repeat(np.arange(self.n), [len(vectors[i][0]) for i in order])
        terms = np.concatenate([vectors[i][0] for i in order]) if len(order) else np.zeros(0, np.int64)
        weights = np.concatenate([vectors[i][1] for i in order]) if len(order) else np.zeros(0)
        common = np.bincount(terms, minlength=n_terms) * full >= max(self.n, full * BLOCK)
        self.row_of = np.where(common, np.cumsum(common) - 1, -1).astype(np.int32)
        self.table = np.zeros((int(common.sum()), self.n_blocks, BLOCK))
        held = common[terms]
        self.table[self.row_of[terms[held]], rows[held] // BLOCK, rows[held] % BLOCK] = weights[held]
        self.table_largest = self.table.max(axis=2)
        rows, terms, weights = rows[~held], terms[~held], weights[~held]
        by_term = np.lexsort((rows, terms))
        self.rows, self.weights, terms = rows[by_term].astype(np.uint16 if self.n < 1 << 16 else np.uint32), weights[by_term], terms[by_term]
        # Entries are the runs of one term and block within the postings.
        block = self.rows // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])])) if len(terms) else np.zeros(0, np.int64)
        self.begin = np.append(new, len(terms)).astype(np.uint32)
        self.block = block[new]
        self.largest = np.maximum.reduceat(self.weights, new) if len(new) else np.zeros(0)
        # A bound may be a little too large, never too small.
        self.largest = np.nextafter(self.largest.astype(np.float32), np.float32(2))
        self.first = np.searchsorted(terms[new], np.arange(n_terms + 1)).astype(np.int32)

    @staticmethod
    def _alike(vectors: list, labels: np.ndarray, n_terms: int, leaders: int = 64) -> np.ndarray:
        """An order that puts like vectors together, so that a block's bound is tight."""
        if not vectors:
            return np.zeros(0, np.int64)
        dense = np.zeros((n_terms, min(leaders, len(vectors))), np.float32)
        for c, i in enumerate(np.random.default_rng(5).permutation(len(vectors))[: dense.shape[1]]):
            dense[vectors[i][0], c] = vectors[i][1]
        nearest = np.array([int((w.astype(np.float32) @ dense[t]).argmax()) for t, w in vectors])
        return np.lexsort((np.arange(len(vectors)), np.asarray(labels, np.float64), nearest))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the k nearest examples with a positive cosine, nearest first."""
        row = self.row_of[terms]
        row, row_weights = row[row >= 0], weights[row >= 0]
        entry, of = _ranges(self.first[terms], self.first[terms + 1])
        block, weight = self.block[entry], weights[of]
        bound = (np.bincount(block, weight * self.largest[entry], self.n_blocks) + row_weights @ self.table_largest[row]) * (1 + 1e-9)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        # The best blocks first: enough for k examples; then all blocks whose bound reaches the k-th best cosine.
        rows, cosines, at, kth = np.zeros(0, np.int64), np.zeros(0), 0, 0.0
        step = -(-2 * k // BLOCK)
        self.asked += self.n_blocks
        while at < len(order):
            these = order[at:at + step]
            these = np.sort(these[bound[these] >= kth])
            if len(these) == 0:
                break
            self.read += len(these)
            got = row_weights @ self.table[row[:, None], these].reshape(len(row), len(these) * BLOCK)
            place = np.full(self.n_blocks, -1)
            place[these] = np.arange(len(these)) * BLOCK
            some = np.flatnonzero(place[block] >= 0)
            posting, own = _ranges(self.begin[entry[some]].astype(np.int64), self.begin[entry[some] + 1].astype(np.int64))
            example = self.rows[posting].astype(np.int64)
            got += np.bincount(place[example // BLOCK] + example % BLOCK, self.weights[posting] * weight[some][own], len(got))
            hit = np.flatnonzero(got >= max(kth, 1e-300))
            found = these[hit // BLOCK] * BLOCK + hit % BLOCK
            rows, cosines = np.append(rows, found[found != without]), np.append(cosines, got[hit[found != without]])
            best = np.lexsort((rows, -np.round(cosines, 12)))[:k]
            rows, cosines = rows[best], cosines[best]
            kth = cosines[-1] - 1e-12 if len(rows) == k else 0.0
            at, step = at + step, len(order)
        return rows, cosines


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone fit by pooling adjacent violators: block means at ascending thresholds."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        if pools and pools[-1][2] == a:
            pools[-1][0] += b
            pools[-1][1] += 1
        else:
            pools.append([b, 1.0, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _ = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
    return np.array([p[2] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1.0) for p in pools])


class Model:
    """Vocabulary, word weights, index and calibration; all bounded by the sample of examples."""

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, examples: list[tuple], k: int):
        """examples: (doc_id, term numbers, counts, label)."""
        self.vocabulary, self.weight, self.k = vocabulary, weight, k
        full = [e for e in examples if len(e[1])]
        bare = [e[3] for e in examples if not len(e[1])]
        rate = float(np.mean([e[3] for e in examples])) if examples else 0.0
        self.bare = (sum(bare) + rate) / (len(bare) + 1)
        vectors = [self.vector(e[1], e[2]) for e in full]
        numbers = list(range(len(full)))
        self.index = BlockMaxIndex(vectors, np.array([e[3] for e in full]), numbers, len(vocabulary))
        self.at, self.to = np.zeros(0), np.zeros(0)
        row_of = {number: row for row, number in enumerate(self.index.ids)}
        self.index.ids = [full[number][0] for number in self.index.ids]
        if full:
            votes = np.array([self.vote(*self.index.nearest(*vectors[n], k, row_of[n])) for n in numbers])
            self.at, self.to = isotonic(votes, np.array([e[3] for e in full], np.float64))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[terms]
        return terms, w / np.sqrt(w @ w)

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Votes weigh 1/(distance + 0.1), distance being 1 - cosine; one virtual vote for the rate of bare texts."""
        w = 1 / (1.1 - np.minimum(cosines, 1))
        return float((w @ self.index.labels[rows] + self.bare) / (w.sum() + 1)) if len(rows) else self.bare

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list]:
        if len(terms) == 0:
            return float(min(1.0, max(0.0, self.bare))), []
        rows, cosines = self.index.nearest(*self.vector(terms, counts), self.k)
        vote = self.vote(rows, cosines)
        if len(self.to):
            vote = self.to[max(0, int(np.searchsorted(self.at, vote, "right")) - 1)] if vote >= self.at[0] else min(vote, self.to[0])
        evidence = [{"doc_id": self.index.ids[r], "toxic": float(self.index.labels[r]), "cosine": float(c)} for r, c in zip(rows[:3], cosines[:3])]
        return float(min(1.0, max(0.0, vote))), evidence


def known_terms(hasher: WordHasher, vocabulary: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, count) of the vocabulary's words in each text, by row and term."""
    hashes, first = hasher.column(texts)
    if len(hashes) == 0 or len(vocabulary) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    known = np.flatnonzero(vocabulary[at] == hashes)
    key = np.repeat(np.arange(len(first) - 1), np.diff(first))[known] * len(vocabulary) + at[known]
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new] // len(vocabulary), key[new] % len(vocabulary), np.diff(np.append(new, len(key)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each example and their counts."""
    hasher = WordHasher(NO_WORD)
    for batch in slices(batches):
        hashes, first = hasher.column(batch.column("text"))
        bags = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array([b.view(np.int64) for b, _ in bags], pa.list_(pa.int64())), pa.array([c for _, c in bags], pa.list_(pa.int64()))],
            names=["doc_id", "y", "words", "counts"],
        )


def fit(docs: DataFrame, labels: DataFrame, eligible, max_examples: int = 4096, k: int = 25) -> Model:
    """``labels(doc_id, toxic)``: rows for which ``eligible(doc_id)`` holds may teach; of these the first
    ``max_examples`` by hash are taken.  ``docs`` may carry any further columns.
    """
    spark = docs.sparkSession
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(eligible(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_examples)
        .collect()
    )
    examples = spark.createDataFrame([(int(r.doc_id), float(r.y)) for r in sample], "doc_id long, y double")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # Exact copies teach once. The examples are at most max_examples rows of 16 bytes.
    taught = base.join(F.broadcast(examples), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.max("text").alias("text"), F.avg("y").alias("y"))
    # What comes to the driver is the sample's own words.
    rows = taught.select("doc_id", "y", "text").mapInArrow(_bags, "doc_id long, y double, words array<long>, counts array<long>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    ids, y = rows.column("doc_id").to_pylist(), rows.column("y").to_numpy()
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy() if len(ids) else np.zeros(0, np.int64)
    words, counts = flat("words").view(np.uint64), flat("counts")
    first = np.concatenate([[0], np.cumsum([len(w) for w in rows.column("words")])]).astype(np.int64)
    vocabulary, terms = np.unique(words, return_inverse=True)
    held = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = WordHasher(NO_WORD), held.value
        n, found = 0, np.zeros(len(known) + 1, np.int64)
        for batch in slices(batches):
            n += batch.num_rows
            found += np.bincount(known_terms(hasher, known, batch.column("text"))[1], minlength=len(known) + 1)
        found[-1] = n
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["term", "n"])

    df = np.zeros(len(vocabulary) + 1)
    if len(vocabulary):
        # One row for each word of the examples.
        seen = base.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        df[seen.column("term").to_numpy()] = seen.column("n").to_numpy()
    of = np.repeat(np.arange(len(ids)), np.diff(first))
    toxic, other = np.bincount(terms, y[of], len(vocabulary)), np.bincount(terms, 1 - y[of], len(vocabulary))
    weight = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * np.log2(2 + toxic / np.maximum(other, 1))
    return Model(vocabulary, weight, [(ids[e], terms[a:b], counts[a:b], y[e]) for e, (a, b) in enumerate(zip(first[:-1], first[1:]))], k)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, text_hash, score, predicted and evidence (nearest examples with labels and cosines) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = shared.value, WordHasher(NO_WORD)
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.float64()), ("cosine", pa.float64())]))
        for batch in slices(batches):
            row, term, count = known_terms(hasher, m.vocabulary, batch.column("text"))
            first = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            got = [m.score(term[a:b], count[a:b]) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= threshold) for s, _ in got], pa.int32()), pa.array([e for _, e in got], kind)],
                names=["doc_id", "text_hash", "score", "predicted", "evidence"],
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return base.mapInArrow(run, "doc_id long, text_hash long, score double, predicted int, evidence array<struct<doc_id:long,toxic:double,cosine:double>>")


def held_out(doc_id):
    """Rows kept from training: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **parameters) -> DataFrame:
    """Score every document of ``docs``; labels of held-out rows are never learned from."""
    model = fit(docs, labels, lambda d: ~held_out(d), **parameters)
    release(docs.sparkSession)
    return score(docs, model, threshold).withColumn("held_out", held_out("doc_id"))
