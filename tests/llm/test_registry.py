"""The registered queries on a small table of odd rows: digests against SQL or plain Python."""

import hashlib
import random
import zlib
from array import array

import duckdb
import pytest
from tokenizers import Tokenizer

from roundsmith.llm import registry
from roundsmith.llm.registry import tokenizer_path
from tests.llm.test_corpus_operators import PII_TEXTS, base_pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    rng = random.Random(6)
    pool = [f"wort{k}" for k in range(60)] + ["Äpfel", "naïve", "the", "of", "42", "x1"]
    out = [t for t in PII_TEXTS if t is None or len(t) < 30_000]
    for k in range(120):
        words = rng.choices(pool, k=rng.randrange(0, 60))
        if k % 7 == 0:
            words.insert(len(words) // 2, f"mail ann{k % 5}@clinic.org or +49 30 1234{k:04}, 10.0.{k}.7")
        if k % 11 == 0:
            words.append(f'token = "Zq8vX2mN7pLw4RtY{k}" and 0123456789abcdef0123456789ab{k % 3}')
        out.append(" ".join(words))
    out += [out[30], out[30] + " extra", out[40].upper()]
    return out + [" ".join(f"b{j}" for j in range(25)) + " tail", "head " + " ".join("y" if j in (3, 11, 17) else f"b{j}" for j in range(25))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [(100 + 3 * k, t, "en", None if k % 13 == 0 else f"s{k % 5}", 0) for k, t in enumerate(texts())]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"b{j}" for j in range(25))), (2, "too short"), (3, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(100 + 3 * k, 1, int(k % 7 == 0)) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(spark, name, folder):
    df = registry.QUERIES[name](spark, folder)
    return df.columns, sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["op2_pii_sanitisation", "op4_near_duplicates", "op6_secret_scan", "op9_decontamination"])
def test_queries_equal_their_sql(spark, folder, name):
    columns, got = rows_of(spark, name, folder)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.sql(registry.SQL[name])
    assert sorted(map(str, want.columns)) == sorted(columns)
    order = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


def test_base_digest_of_personal_data(spark, folder):
    _, got = rows_of(spark, "op2_pii_sanitisation", folder)
    digest = {r[0]: r[5] for r in got}
    for k, t in enumerate(texts()):
        spans = ",".join(f"{kind}:{a}:{b}" for kind, found in base_pii(t or "").items() for a, b in found)
        assert digest[100 + 3 * k] == hashlib.sha256(spans.encode()).hexdigest()


def test_token_files_and_packing_hold_the_librarys_ids(spark, folder):
    byte, word = (Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    _, got = rows_of(spark, "op5_token_files", folder)
    start = 0
    for r, (k, t) in zip(sorted(got), enumerate(texts()), strict=True):
        ids = array("I", [*byte.encode(t or "", add_special_tokens=False).ids, 0]).tobytes()
        assert r == (100 + 3 * k, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    columns, got = rows_of(spark, "op8_best_fit_packing", folder)
    pieces = {(r[0], r[1]): r[2:5] for r in got}
    assert columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and len(pieces) == len(got)
    for k, t in enumerate(texts()):
        ids = array("I", [*word.encode(t or "", add_special_tokens=False).ids, 1])
        for n, a in enumerate(range(0, len(ids), 4096)):
            own = ids[a:a + 4096]
            assert pieces.pop((100 + 3 * k, n)) == (a, len(own), zlib.crc32(own.tobytes()))
    assert not pieces


def test_toxicity_query_scores_every_document(spark, folder):
    columns, got = rows_of(spark, "op3_toxicity", folder)
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(texts())
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) and 0 <= r[2] <= 1 and r[3] == int(r[2] >= 0.3) for r in got)
