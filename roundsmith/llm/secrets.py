"""Secret scans with corpus-wide ownership frequency.

Candidates are assignments, access keys and long hexadecimal runs.  The hash of each candidate value is
aggregated over the corpus by distinct repositories and distinct owners.  A value that ``copied_owners`` or
more owners hold, or that stands in ``copied_repositories`` or more repositories, whoever owns them, is a widely
copied example; a value that looks live (see ``looks_live``) and stays below both is a live-looking credential of its owner.

Cases: a null text is the empty text; a null owner or repository is one of its own, apart from the empty string; repeated rows
count once as repository (their repository id is the same); candidates of different kinds may overlap and all are
kept; an empty table gives no rows; further columns are ignored.  Texts may be of any length: a text is scanned
whole, in linear time, and only the hashes of its candidates go on.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsmith.llm.common import stored, text_or_empty
from roundsmith.llm.words import slices

#: Kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that mark a made-up value.
PLACEHOLDER = re.compile(r"example|sample|changeme|placeholder|dummy|your|xxxx|1234567|abcdef|test", re.IGNORECASE)


def find_secrets(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of every candidate, by start and then kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def entropy(value: str) -> float:
    """Bits a character of the value under its own character frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_live(value: str) -> bool:
    """No made-up word in it, letters and digits mixed (or 20 characters), and three quarters of the bits a character that its length allows, 3 at most."""
    if PLACEHOLDER.search(value):
        return False
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return (mixed or len(value) >= 20) and entropy(value) >= 0.75 * math.log2(min(len(value), 16))


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary()), ("looks_live", pa.bool_())]))


def scan_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", copied_owners: int = 3, copied_repositories: int = 50) -> DataFrame:
    """Per row: doc_id, text_hash and found, an array of (start, kind, end, repositories, owners, verdict).

    ``verdict`` is "copied", "live" or "weak"; ``text_hash`` tells rows of one doc_id apart.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                out.append([
                    {"start": a, "kind": k, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).digest(), "looks_live": looks_live(v)}
                    for a, k, b, v in find_secrets(text)
                ])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "repository", "owner", "text_hash")), pa.array(out, _FOUND)], names=["doc_id", "repository", "owner", "text_hash", "found"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), text_or_empty().alias("text"))
    source = source.withColumn("text_hash", F.xxhash64("text"))
    rows = stored(source.mapInArrow(scan, "doc_id long, repository string, owner string, text_hash long, found array<struct<start:long,kind:int,end:long,value:binary,looks_live:boolean>>"), "candidates")
    n_found = rows.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    some = rows.where(F.size("found") > 0).select("doc_id", "repository", "owner", "text_hash", F.explode("found").alias("f"))
    # Two levels of partial sums: a value that fills a third of the corpus is reduced before each exchange.
    spread = lambda c, to: some.groupBy(F.col("f.value").alias("value"), F.col(c).alias("x")).agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("*").alias(to))
    ownership = stored(spread("repository", "repositories").join(spread("owner", "owners"), "value"), "ownership", n_found)
    judged = some.select("doc_id", "text_hash", "f.*").distinct().join(ownership, "value")
    verdict = F.when((F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories), "copied").when(F.col("looks_live"), "live").otherwise("weak")
    judged = judged.select("doc_id", "text_hash", F.struct("start", "kind", "end", "repositories", "owners", verdict.alias("verdict")).alias("f"))
    by_doc = judged.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("f")).alias("found"))
    by_doc = by_doc.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), "found")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th"))
    return rows.select("doc_id", "text_hash").join(by_doc, same, "left").select("doc_id", "text_hash", F.coalesce("found", F.expr("array()")).alias("found"))


def redact(text, found):
    """``text`` with the live spans replaced by ``[SECRET]``; overlapping spans are one."""
    live = F.filter(found, lambda f: f["verdict"] == "live")
    piece = lambda acc, f: F.when(
        f["start"] >= acc["at"],
        F.struct(F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (f["start"] - acc["at"]).cast("int")), F.lit("[SECRET]")).alias("out"), f["end"].alias("at")),
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], f["end"]).alias("at")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(live, start, piece, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(live) > 0, done).otherwise(text)
