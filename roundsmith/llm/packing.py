"""Hierarchical residual packing of documents into fixed-length training sequences.

Every task packs its own pieces best-fit (longest first), ``items_per_group`` at a time, and emits bins that
are nearly full.  Underfull bins are items of the next round, in which ``fan_in`` groups meet; rounds go on
until one group is left.  No bin is left out of a round unless no bin of the whole corpus could join it.

A round packs residual classes instead of bins: bins of one size are alike, so a group's items are at most
``capacity`` sizes with their numbers, best-fit places as many at a time as there are alike, and the result
is a list of patterns with their numbers.  A bin finds its place by its rank within its size.  So no task
grows with the corpus, however many underfull bins meet.

Cases: a null text is the empty text and still holds the end id; documents longer than a sequence are
cut into full pieces and a last, possibly shorter piece, whatever their length; repeated doc_ids are packed
row by row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roundsmith.llm.common import stored, text_or_empty
from roundsmith.llm.encoding import encoder
from roundsmith.llm.words import slices


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin number and offset of every item, longest items first, each into the fullest bin that holds it.

    The residuals in use are the set bits of one integer, so the best bin is one shift away.
    """
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    by_residual: dict[int, list[int]] = defaultdict(list)
    mask = n_bins = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fitting = mask >> size
        if fitting:
            residual = size + (fitting & -fitting).bit_length() - 1
            b = by_residual[residual].pop()
            if not by_residual[residual]:
                mask &= ~(1 << residual)
        else:
            residual, b, n_bins = capacity, n_bins, n_bins + 1
        bins[i], offsets[i] = b, capacity - residual
        if residual > size:
            by_residual[residual - size].append(b)
            mask |= 1 << (residual - size)
    return bins, offsets


PIECE = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("leaf", pa.int64()), ("bin", pa.int64()), ("at", pa.int64()),
])


def local_pieces(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int, items_per_group: int) -> DataFrame:
    """Tokenise, cut and pack within each task, at most ``items_per_group`` pieces at a time."""
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer, kind).encode, TaskContext.get().partitionId()
        rows, n_bins = [], 0

        def packed() -> pa.RecordBatch:
            nonlocal n_bins
            bins, at = best_fit([r[3] for r in rows], capacity)
            names = [(task << 32) + n_bins + b for b in bins]
            n_bins += max(bins) + 1
            columns = [*zip(*rows), [names[0]] * len(rows), names, at]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECE)], schema=PIECE)

        for batch in slices(batches, keep=(tokenizer, kind)):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[a:a + 4 * capacity]
                    rows.append((doc_id, k, a // 4, len(own) // 4, zlib.crc32(own)))
                if len(rows) >= items_per_group:
                    yield packed()
                    rows = []
        if rows:
            yield packed()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return stored(source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, leaf long, bin long, at long"), "pieces")


def best_fit_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit of ``counts[size]`` items of each size, longest first: (sizes of a bin, number of such bins)."""
    by_residual: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    mask = 0

    def put(residual: int, pattern: tuple[int, ...], n: int) -> None:
        nonlocal mask
        if n:
            by_residual[residual].append((pattern, n))
            mask |= 1 << residual

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fitting = mask >> size
            if not fitting:
                most = capacity // size
                put(capacity - most * size, (size,) * most, left // most)
                put(capacity - left % most * size, (size,) * (left % most), int(left % most > 0))
                break
            residual = size + (fitting & -fitting).bit_length() - 1
            pattern, n = by_residual[residual].pop()
            if not by_residual[residual]:
                mask &= ~(1 << residual)
            put(residual, pattern, n - min(n, left))
            put(residual - size, (*pattern, size), min(n, left))
            left -= min(n, left)
    return [p for patterns in by_residual.values() for p in patterns]


def merge_round(bins: DataFrame, groups: int, capacity: int, name: str, rows: int) -> DataFrame:
    """bins(leaf, bin, size), at most ``rows`` → (bin, parent, shift, leaf, size): best-fit of whole bins within each of ``groups`` groups.

    ``leaf`` is the group of the first round that a bin comes from; ranks are counted within it, and leaves follow each other.
    """
    bins = bins.withColumn("grp", F.pmod(F.xxhash64("leaf"), F.lit(groups)).cast("int"))
    counts = stored(bins.groupBy("grp", "leaf", "size").agg(F.count("*").alias("n")), f"{name}-counts", rows)
    before = Window.partitionBy("grp", "size").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("leaf", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), f"{name}-starts", rows)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        used: dict[int, int] = defaultdict(int)
        rows = []
        for number, (pattern, n) in enumerate(best_fit_patterns(dict(zip(group["size"].tolist(), group["n"].tolist())), capacity)):
            shift = 0
            for size in pattern:
                if len(pattern) > 1:
                    rows.append((group["grp"].iloc[0], size, used[size], used[size] + n, number, shift))
                used[size] += n
                shift += size
        return pd.DataFrame(rows, columns=["grp", "size", "lo", "hi", "pattern", "shift"])

    sizes = counts.groupBy("grp", "size").agg(F.sum("n").alias("n"))
    ranges = sizes.groupBy("grp").applyInPandas(plan, "grp int, size long, lo long, hi long, pattern long, shift long")
    # At most as many ranges for a size as there are patterns.
    ranges = stored(ranges.groupBy("grp", "size").agg(F.collect_list(F.struct("lo", "hi", "pattern", "shift")).alias("ranges")), f"{name}-ranges", rows)
    own = Window.partitionBy("leaf", "size").orderBy("bin")
    ranked = stored(bins.withColumn("rank", F.row_number().over(own).cast("long") - 1), f"{name}-ranks", rows)
    ranked = ranked.join(starts, ["leaf", "size"]).withColumn("rank", F.col("rank") + F.col("start"))
    place = F.filter("ranges", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))
    found = ranked.join(ranges, ["grp", "size"]).withColumn("place", F.element_at(F.when(F.size(place) > 0, place), 1)).where("place is not null")
    found = found.select("grp", "leaf", "bin", "size", "place.pattern", (F.col("rank") - F.col("place.lo")).alias("k"), "place.shift")
    found = stored(found, f"{name}-found", rows)
    heads = found.where("shift = 0").select("grp", "pattern", "k", F.col("bin").alias("parent"), F.col("leaf").alias("parent_leaf"))
    return found.join(heads, ["grp", "pattern", "k"]).select("bin", "parent", "shift", F.col("parent_leaf").alias("leaf"), "size")


def pack_documents(docs: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = 4096, full: float = 0.98, fan_in: int = 64, items_per_group: int = 32768) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = local_pieces(docs, tokenizer, kind, end_id, capacity, items_per_group)
    bins = stored(pieces.groupBy("leaf", "bin").agg(F.sum("length").alias("size")), "bins", pieces.count(), 1 << 16)
    n_bins = bins.count()
    placed = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    leaves = bins.select("leaf").distinct().count()
    groups, level = max(1, leaves), 0
    while leaves and (level == 0 or groups > 1):
        level, groups = level + 1, -(-groups // fan_in)
        least = bins.agg(F.min("size")).first()[0]
        # A bin that even the smallest one would overfill is final.
        open_bins = bins.where((F.col("size") < int(full * capacity)) & (F.col("size") + least <= capacity))
        moved = stored(merge_round(open_bins, groups, capacity, f"round-{level}", n_bins), f"moved-{level}", n_bins)
        step = moved.where("shift > 0").select(F.col("bin").alias("sequence_id"), "parent", "shift")
        placed = placed.join(step, "sequence_id", "left").select(
            "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
        )
        if groups > 1:
            merged = moved.groupBy("leaf", F.col("parent").alias("bin")).agg(F.sum("size").alias("size"))
            bins = stored(bins.join(moved.select("bin"), "bin", "left_anti").unionByName(merged), f"bins-{level}", n_bins)
    return placed
