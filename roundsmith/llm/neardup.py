"""Near-duplicate components from SetSketch registers.

1. A document's shingle set is hashed to 64-bit elements; equal sets form one class, so exact copies
   cost nothing further.
2. A class gets a SetSketch: ``registers`` minima, each truncated to floor(1 - log_b(minimum)).  They
   are mergeable by maximum and two registers are equal with about the similarity's probability.
   ``bands`` bands of ``rows`` registers are hashed; every class is paired with the centre of each of
   its buckets, the class that comes first in one random order.
3. The likelihood of greater, equal and smaller registers, given both exact sizes, estimates each
   pair's similarity; pairs that reach ``loose`` join classes to clusters.  A bucket's members below
   ``loose`` are compared with each other and with its members between ``loose`` and ``sure``, in
   blocks, and join where their registers don't exclude the similarity: work that grows with the
   square of a bucket's unlike members, and not with its alike ones.  Two members like the centre are
   in one cluster already; one above ``sure`` has no partner at the threshold below ``loose``, but for
   an error of five standard errors in the difference of the two estimates.
4. Pairs with a centre that look linked are decided on full sets, and links join classes to
   components.  While a cluster still holds many components, the members outside its largest one, its
   free members, are tried against random members of the largest one, round by round; a link ends a
   member's freedom.  When the pairs with a free member are few, or no longer fall, all of them are
   compared in blocks: sizes and sketches exclude pairs whose similarity cannot (six standard errors) reach the
   threshold, full sets decide the rest.  Members of one component are never compared with each other,
   so a large group of alike documents costs a few comparisons a member.

With 32 bands of 4 registers a pair at similarity 0.8 shares no bucket with a probability below 1e-7.

Cases: a document without words (or null) has no shingles and links with nothing; one with fewer words
than a shingle has its whole sequence as one; rows that share a doc_id are one document and so one
component; rows with a null doc_id form components like others by their texts (their component_id is the smallest
non-null doc_id, or null), and the first of a component is one of them only where it has no other; an empty table gives no
rows; further columns are ignored.  Texts may be of any length: words are hashed in slices, a set is held
whole, and blocks of sets are cut by bytes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsmith.llm.common import stored, text_or_empty
from roundsmith.llm.words import WordHasher, mix, shingle_hashes, slices

_M2 = np.uint64(0xC2B2AE3D27D4EB4F)


class SetSketch:
    """Registers of exponentially spaced truncated minima, base ``b``."""

    def __init__(self, registers: int, b: float = 1.001, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.m, self.b, self.top = registers, b, 2**16 - 2
        self.factor = rng.integers(1, 2**31, registers, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shift = rng.integers(0, 2**32, registers, dtype=np.uint32)

    def of_sets(self, sets: list[np.ndarray]) -> np.ndarray:
        """The registers of each of the (non-empty) sets of hashed elements, one row per set."""
        out = np.empty((len(sets), self.m), np.uint32)
        # Runs of sets are hashed together; a register's values of one run stay in the cache.
        ends = np.cumsum([len(s) for s in sets]) if sets else np.zeros(0, np.int64)
        a = 0
        while a < len(sets):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 65536, "right")))
            flat = (np.concatenate(sets[a:b]) >> np.uint64(32)).astype(np.uint32)
            starts = np.concatenate([[0], ends[a:b - 1] - (ends[a - 1] if a else 0)])
            value = np.empty_like(flat)
            for r in range(self.m):
                np.multiply(flat, self.factor[r], out=value)
                np.add(value, self.shift[r], out=value)
                out[a:b, r] = np.minimum.reduceat(value, starts)
            a = b
        # The minimum of n uniform values u gives the minimum of n exponential values -ln(1 - u).
        minimum = -np.log1p(-(out.astype(np.float64) + 0.5) / 2**32)
        return np.clip(np.floor(1 - np.log(minimum) / np.log(self.b) + 30_000), 0, self.top).astype(np.uint16)

    def of(self, elements: np.ndarray) -> np.ndarray:
        return self.of_sets([elements])[0]

    def jaccard(self, n_u: np.ndarray, n_v: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Maximum-likelihood similarity from the counts of registers above and below, by bisection of the score."""
        u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
        base = (self.b - 1) / self.b
        p = lambda x: -np.log1p(-x * base) / np.log(self.b)
        dp = lambda x: base / (1 - x * base) / np.log(self.b)
        low, high = np.zeros(len(u)), np.minimum(n_u, n_v) / np.maximum(n_u, n_v)
        same = self.m - above - below
        for _ in range(24):
            j = (low + high) / 2
            x, y = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
            px, py = p(x), p(y)
            slope = -above * v * dp(x) / px - below * u * dp(y) / py + same * (v * dp(x) + u * dp(y)) / np.maximum(1 - px - py, 1e-9)
            low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
        return (low + high) / 2


def _estimates(sketch: SetSketch, n_u, n_v, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sketch.jaccard(np.asarray(n_u, np.float64), np.asarray(n_v, np.float64), (a > b).sum(axis=1), (a < b).sum(axis=1))


def components(edges: DataFrame, name: str = "components", rows: int | None = None) -> DataFrame:
    """edges(a, b), at most ``rows`` if known → (node, label): one label for each connected component, a node of it.

    Every node moves to its smallest neighbour, the edges move along, and loops and repeats go; rounds
    follow until no edge is left.  Edges shrink by a factor each round because nodes are hashes, in random
    order.  Rounds are written to the shared folder.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0", rows)
    n = first = left.count()
    label, step = None, 0
    while label is None or n:
        step += 1
        both = left.select(F.col("a").alias("node"), F.col("b").alias("m")).union(left.select(F.col("b").alias("node"), F.col("a").alias("m")))
        move = stored(both.groupBy("node").agg(F.min("m").alias("m")).select("node", F.least("node", "m").alias("to")), f"{name}-move-{step}", 2 * n)
        if label is None:
            label = move.select("node", F.col("to").alias("label"))
        else:
            label = label.join(move.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        side = lambda at: move.select(F.col("node").alias(at), F.col("to").alias(f"{at}_to"))
        moved = left.join(side("a"), "a").join(side("b"), "b").where("a_to <> b_to")
        left = stored(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), f"{name}-{step}", n)
        n = left.count()
    return stored(label, f"{name}-labels", 2 * first)


def linked_pairs(ids: list, label_pairs: np.ndarray) -> list[tuple]:
    """A spanning forest of the links, as pairs of ids."""
    forest = Forest(len(ids))
    return [(ids[i], ids[j]) for i, j in label_pairs if forest.join(i, j)]


class Forest:
    """Disjoint sets of the numbers below ``n``."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, rows: int | None = None, members_per_task: int = 256) -> DataFrame:
    """The pairs(h, c), at most ``rows`` if known, that reach the similarity on full sets(h, set).

    The pairs of a centre ``c`` are dealt into groups; a group's rows stream past the centre's set.
    """
    pairs = stored(pairs.select("h", "c").distinct(), "pairs", rows)
    n = pairs.count()
    crowd = stored(pairs.groupBy("c").agg(F.ceil(F.count("*") / members_per_task).cast("int").alias("k")), "pairs-crowd", n)
    dealt = pairs.join(crowd, "c").select("h", "c", F.pmod(F.xxhash64("h"), F.col("k")).cast("int").alias("salt"))
    members = dealt.join(sets.select("h", "set"), "h").select("c", "salt", "h", "set")
    heads = crowd.select("c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt")).join(sets.select(F.col("h").alias("c"), "set"), "c")
    rows = heads.select("c", "salt", F.lit(None).cast("binary").alias("h"), "set").union(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            out = []
            at = zip(batch.column("c").to_pylist(), batch.column("salt").to_pylist(), batch.column("h").to_pylist(), batch.column("set"))
            for c, salt, h, elements in at:
                found = np.frombuffer(elements.as_buffer(), np.uint64)
                if h is None:
                    centre, own = (c, salt), found.copy()
                elif centre == (c, salt) and alike(found, own, percent):
                    out.append((h, c))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in range(2)], names=["h", "c"])

    return rows.repartition("c", "salt").sortWithinPartitions("c", "salt", "h").mapInArrow(run, "h binary, c binary")


def _relabelled(members: DataFrame, links: DataFrame, name: str, rows: int) -> DataFrame:
    """members(h, label, ...), ``rows`` of them, with the labels that links between labels (a, b) bring together made one."""
    to = components(links, name).select(F.col("node").alias("label"), F.col("label").alias("to"))
    rest = [c for c in members.columns if c != "label"]
    return stored(members.join(to, "label", "left").select(*rest, F.coalesce("to", "label").alias("label")), f"{name}-members", rows)


def _crowds(members: DataFrame, rows: int) -> tuple[DataFrame, int, int]:
    """Clusters of several components: (cluster, top, members, n_top, bytes); the number of pairs with a free member, and of members."""
    per = members.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    crowds = per.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.sum("n").alias("members"), F.max("n").alias("n_top"), F.sum("size").alias("size"))
    crowds = stored(crowds.where("members > n_top"), "crowds", rows)
    total = crowds.agg(F.sum((F.col("members") - F.col("n_top")) * F.col("members")).alias("pairs"), F.sum("members").alias("members")).first()
    return crowds, total.pairs or 0, total.members or 0


def _tried(members: DataFrame, crowds: DataFrame, sets: DataFrame, percent: int, step: int, rows: int, tries: int = 16) -> DataFrame:
    """Links (a, b) of labels between free members and ``tries`` random members of their cluster's largest component."""
    of = members.join(crowds.select("cluster", "top"), "cluster")
    slot = F.pmod(F.xxhash64("h", F.lit(step)), F.lit(tries))
    heads = of.where("label = top").groupBy("cluster", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("h", F.lit(-step)).alias("r"), "h"))["h"].alias("c"))
    free = of.where("label <> top").select("cluster", "h", "label", F.col("top").alias("other"))
    pairs = stored(free.join(heads, "cluster").select("h", "c", "label", "other"), f"tried-{step}", tries * rows)
    return verified(pairs, sets, percent, tries * rows).join(pairs, ["h", "c"]).select(F.col("label").alias("a"), F.col("other").alias("b"))


def _compared(members: DataFrame, crowds: DataFrame, sets: DataFrame, sketch: SetSketch, percent: int, block_bytes: int) -> DataFrame:
    """Links (a, b) of labels from all pairs of a cluster with a free member, in pairs of blocks."""
    of = members.join(crowds, "cluster").withColumn("free", F.col("label") != F.col("top"))
    side = F.least(F.greatest(F.floor(block_bytes * F.col("members") / (8 * F.col("crowd_size") + 1)), F.lit(16)), F.lit(128))
    of = of.withColumn("kf", F.ceil((F.col("members") - F.col("n_top")) / side).cast("int")).withColumn("kl", F.ceil(F.col("n_top") / side).cast("int"))
    # Blocks of free members are numbered from 0, those of the largest component from kf.
    spot = F.xxhash64("h")
    of = of.withColumn("mine", F.when(F.col("free"), F.pmod(spot, F.col("kf"))).otherwise(F.col("kf") + F.pmod(spot, F.col("kl"))).cast("int"))
    other = F.when(F.col("free"), F.sequence(F.lit(0), F.col("kf") + F.col("kl") - 1)).otherwise(F.sequence(F.lit(0), F.col("kf") - 1))
    of = of.select("h", "cluster", "label", "mine", other.alias("other")).join(sets.select("h", "set", "sketch"), "h").withColumn("other", F.explode("other"))
    dealt = of.select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "h", "label", "set", "sketch")
    # Registers agree with at least the similarity's probability; six standard errors are allowed.
    least_same = sketch.m * (percent / 100 - 6 * (0.25 / sketch.m) ** 0.5)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(s, np.uint64) for s in group["set"]]
        registers = np.frombuffer(b"".join(group["sketch"]), np.uint16).reshape(-1, sketch.m)
        number, names = pd.factorize(group["label"])
        mine, i, j = group["mine"].to_numpy(), group["i"].iloc[0], group["j"].iloc[0]
        out = _links(own, registers, number, np.flatnonzero(mine == i), np.flatnonzero(mine == j), least_same, percent)
        return pd.DataFrame({"a": [names[a] for a, _ in out], "b": [names[b] for _, b in out]}, dtype=object)

    return dealt.groupBy("cluster", "i", "j").applyInPandas(compare, "a binary, b binary")


def _links(sets: list[np.ndarray], sketches: np.ndarray, labels: np.ndarray, left: np.ndarray, right: np.ndarray, least_same: float, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between labels, over all pairs of ``left`` and ``right`` rows of different labels."""
    n, forest, out = np.array([len(s) for s in sets], np.int64), Forest(len(sets)), []
    across, shared = np.ascontiguousarray(sketches[right].T), _shared(sets, left, right)
    for a in range(0, len(left), 64):
        own = left[a:a + 64]
        same = np.zeros((len(own), len(right)), np.uint16)
        for r in range(sketches.shape[1]):
            same += sketches[own, r][:, None] == across[r][None]
        least, most = np.minimum(n[own][:, None], n[right][None]), np.maximum(n[own][:, None], n[right][None])
        x, y = np.nonzero((same >= least_same) & (100 * least >= percent * most) & (labels[own][:, None] != labels[right][None]))
        if shared is not None:
            both = shared[a + x, y]
            yes = 100 * both >= percent * (n[own[x]] + n[right[y]] - both)
            x, y = x[yes], y[yes]
        else:
            likely = np.argsort(-same[x, y].astype(np.int64), kind="stable")
            x, y = x[likely], y[likely]
        for p, q in zip(own[x].tolist(), right[y].tolist()):
            u, v = int(labels[p]), int(labels[q])
            if forest.root(u) != forest.root(v) and (shared is not None or alike(sets[p], sets[q], percent)):
                forest.join(u, v)
                out.append((u, v))
    return out


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, most: int = 8_000_000) -> np.ndarray | None:
    """Shared elements by one matrix product, where elements repeat enough for the matrix to be small."""
    if len(sets) < 16:
        return None
    elements, where = np.unique(np.concatenate(sets), return_inverse=True)
    if len(elements) * len(sets) > most:
        return None
    matrix = np.zeros((len(sets), len(elements)), np.float32)
    matrix[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), where] = 1
    return (matrix[left] @ matrix[right].T).astype(np.int64)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, loose: float = 0.4, sure: float = 0.8, bucket_block: int = 1024, block_bytes: int = 16 << 20, spare: int = 256) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept (by doc_id), first (of its component, by doc_id and text).

    ``spare``: members of clusters go to blocks when a member has so many open pairs on average; it changes the order of work only.
    """
    sketch = SetSketch(bands * rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in slices(batches):
            n, h, full = [], [], []
            for s in shingle_hashes(*hasher.column(batch.column("text")), shingle_words):
                n.append(len(s))
                h.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    full.append(s)
            registers = iter(sketch.of_sets(full))
            sk = [next(registers).tobytes() if x else None for x in n]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(sk, pa.binary())], names=["doc_id", "th", "n", "h", "sketch"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    read_docs = stored(base.mapInArrow(read, "doc_id long, th long, n long, h binary, sketch binary"), "sketches")
    full, n_docs = read_docs.where("n > 0"), read_docs.count()
    # A class is named by its hash; one of its rows stands for it.
    classes = stored(full.groupBy("h").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min(F.struct("doc_id", "th")).alias("head")), "classes", n_docs)

    banded = classes.mapInArrow(_band_rows(bands, rows), "key long, h binary")
    centre = banded.groupBy("key").agg(F.min(F.struct(F.xxhash64("h").alias("r"), F.col("h").alias("h"))).alias("c"), F.count("*").alias("n")).where("n > 1").select("key", F.col("c.h").alias("c"))
    placed = stored(banded.join(centre, "key").where("h <> c").select("key", "h", "c"), "placed", bands * n_docs, 1 << 16)
    n_placed = placed.count()
    side = lambda key, to: classes.select(F.col("h").alias(key), F.col("n").alias(f"n{to}"), F.col("sketch").alias(f"s{to}"))
    pairs = placed.select("h", "c").distinct().join(side("h", 1), "h").join(side("c", 2), "c")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s1, s2 = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, sketch.m) for c in ("s1", "s2"))
                found = _estimates(sketch, batch.column("n1").to_numpy(), batch.column("n2").to_numpy(), s1, s2)
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(found)], names=["h", "c", "estimate"])

    judged = stored(pairs.select("h", "c", "n1", "n2", "s1", "s2").mapInArrow(estimate, "h binary, c binary, estimate double"), "judged", n_placed)
    near = judged.where(F.col("estimate") >= loose).select(F.col("h").alias("a"), F.col("c").alias("b"))

    # What the centre doesn't settle: members unlike it go with each other and with those that are like it, but not surely.
    rest = stored(placed.join(judged.where(F.col("estimate") < sure), ["h", "c"]).select("key", "h", (F.col("estimate") >= loose).alias("linked")), "rest", n_placed, 1 << 16)
    counts = rest.groupBy("key").agg(F.count_if("linked").alias("n_linked"), F.count_if(~F.col("linked")).alias("n_free")).where("n_free > 0 and n_linked + n_free > 1")
    counts = stored(counts, "rest-counts", rest.count())
    parts = lambda n: F.ceil(F.col(n) / bucket_block).cast("int")
    dealt = rest.join(counts, "key").select("key", "h", "linked", parts("n_free").alias("kf"), parts("n_linked").alias("kl"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("h"), F.when(F.col("linked"), F.col("kl")).otherwise(F.col("kf"))).cast("int")).join(classes.drop("head"), "h")
    # Blocks of free members are numbered from 0, those of linked members from kf: only pairs with a free block are compared.
    other = F.when(F.col("linked"), F.sequence(F.lit(0), F.col("kf") - 1)).otherwise(F.sequence(F.lit(0), F.col("kf") + F.col("kl") - 1))
    dealt = dealt.withColumn("mine", F.when(F.col("linked"), F.col("kf") + F.col("mine")).otherwise(F.col("mine"))).withColumn("other", F.explode(other))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "n", "h", "sketch")
    further = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_within_buckets(sketch, percent), "a binary, b binary")

    cluster = components(near.union(further), "clusters").select(F.col("node").alias("h"), F.col("label").alias("cluster"))
    n_members = cluster.count()

    # Only members of clusters of two classes or more need their sets: one text of each class.
    wanted = cluster.join(classes, "h").select("h", "head.doc_id", "head.th").withColumnsRenamed({"doc_id": "id", "th": "hash"})

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in slices(batches):
            own = list(shingle_hashes(*hasher.column(batch.column("text")), shingle_words))
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([s.tobytes() for s in own], pa.binary()), pa.array([x.tobytes() for x in sketch.of_sets(own)], pa.binary())], names=["h", "set", "sketch"])

    same = base.doc_id.eqNullSafe(wanted.id) & (base.th == wanted.hash)
    texts = base.join(wanted, same).select("h", "text").dropDuplicates(["h"])
    held = stored(texts.mapInArrow(sets, "h binary, set binary, sketch binary"), "sets", n_members, 2048)

    # Pairs with a centre that look linked; then free members against random ones; then all pairs with a free member.
    members = stored(cluster.join(classes.select("h", F.col("n").alias("size")), "h").withColumn("label", F.col("h")), "members", n_members)
    likely = judged.where(F.col("estimate") >= percent / 100 - 0.05)
    members = _relabelled(members, verified(likely, held, percent, n_placed).toDF("a", "b"), "links", n_members)
    crowds, open_pairs, n_open = _crowds(members, n_members)
    step = 0
    while open_pairs > spare * n_open:
        step += 1
        members = _relabelled(members, _tried(members, crowds, held, percent, step, n_open), f"tried-{step}", n_members)
        before = open_pairs
        crowds, open_pairs, n_open = _crowds(members, n_members)
        if open_pairs > 0.8 * before:
            break
    if open_pairs:
        crowds = crowds.withColumnRenamed("size", "crowd_size")
        members = _relabelled(members, _compared(members, crowds, held, sketch, percent, block_bytes), "compared", n_members)

    # Rows of one doc_id with different texts are one document: they link their classes.
    mine = stored(full.select("doc_id", "th", "h").join(members.select("h", "label"), "h", "left").select("doc_id", "th", F.coalesce("label", "h").alias("label")), "labels", n_docs, 1 << 16)
    twice = mine.where("doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.collect_set("label").alias("all")).where("a <> b")
    if not twice.isEmpty():
        more = components(twice.select("a", F.explode("all").alias("b")), "repeated").select(F.col("node").alias("label"), F.col("label").alias("to"))
        mine = mine.join(more, "label", "left").select("doc_id", "th", F.coalesce("to", "label").alias("label"))
    # The first of a component has the smallest doc_id; null ones come last, and texts go by their hash.
    heads = stored(mine.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("head")), "heads", n_docs, 1 << 16)
    is_first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))
    of = mine.join(heads, "label").select(F.col("doc_id").alias("id"), F.col("th").alias("hash"), "component_id", is_first.alias("first")).distinct()
    here = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("hash"))
    some = read_docs.where("n > 0").select("doc_id", "th", "n").join(of, here).select("doc_id", "th", "n", "component_id", "first")
    by_id = of.where("id is not null").groupBy("id").agg(F.min("component_id").alias("component_id"))
    bare = read_docs.where("n = 0").select("doc_id", "th", "n").join(by_id, F.col("doc_id") == F.col("id"), "left")
    bare = bare.select("doc_id", "th", "n", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("component_id").isNull().alias("first"))
    out = some.unionByName(bare).select("doc_id", F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), "component_id", "first")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _within_buckets(sketch: SetSketch, percent: int):
    """Rows sorted by (key, i, j), a group being two blocks of a bucket: a spanning forest of the pairs that may reach the similarity."""
    # Registers agree with at least the similarity's probability; six standard errors are allowed.
    least_same = sketch.m * (percent / 100 - 6 * (0.25 / sketch.m) ** 0.5)

    def group(table: pa.Table) -> list[tuple]:
        i, j, mine, n = (table.column(c).to_numpy() for c in ("i", "j", "mine", "n"))
        order = np.argsort(n, kind="stable")
        own, far = order[mine[order] == i[0]], order[mine[order] == j[0]]
        registers = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, sketch.m)
        across = np.ascontiguousarray(registers[far].T)
        found = []
        for a in range(0, len(own), 32):
            p = own[a:a + 32]
            # Sizes further apart than the similarity allows need no look; both sides are sorted by size.
            lo, hi = np.searchsorted(n[far], n[p[0]] * percent / 100 - 1), np.searchsorted(n[far], n[p[-1]] * 100 / percent + 1, "right")
            same = np.zeros((len(p), hi - lo), np.uint16)
            for r in range(sketch.m):
                same += registers[p, r][:, None] == across[r, lo:hi][None]
            x, y = np.nonzero(same >= least_same)
            x, y = p[x], far[lo + y]
            fits = (x != y) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            found.append(np.column_stack([x[fits], y[fits]]))
        if not any(map(len, found)):
            return []
        return linked_pairs(table.column("h").to_pylist(), np.concatenate(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if not held:
                    return
            elif batch.num_rows == 0:
                continue
            else:
                held.append(pa.Table.from_batches([batch]))
            table = pa.concat_tables(held)
            if table.num_rows == 0:
                continue
            at = np.column_stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
            starts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1])
            # The last group may go on in the next batch.
            ends = np.append(starts[1:], len(at))
            ready = len(starts) if batch is None else len(starts) - 1
            out = [e for s, t in zip(starts[:ready], ends[:ready]) if t - s > 1 for e in group(table.slice(s, t - s))]
            held = [] if batch is None else [table.slice(starts[-1])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["a", "b"])

    return run


def _band_rows(bands: int, rows: int):
    salt = np.random.default_rng(7).integers(1, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                registers = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, bands, rows).astype(np.uint64)
                keys = np.zeros(registers.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    keys = mix(keys * _M2 + registers[:, :, r] * salt[:, r])
                names = np.repeat(np.arange(batch.num_rows), bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), batch.column("h").take(pa.array(names))], names=["key", "h"])

    return run
