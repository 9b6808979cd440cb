"""Encoding whole columns by word hashes against the library, with a memory that is soon full."""

import random
from array import array

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from roundsmith.llm.encoding import BatchEncoder, HashMemory
from roundsmith.llm.registry import tokenizer_path


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
@pytest.mark.parametrize("bits", [6, 16])
def test_columns_equal_the_library(name, kind, bits):
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab AB\n\t'’.,s é1_-ßÄ") for _ in range(rng.randrange(50))) for _ in range(600)]
    texts += ["".join(rng.choice("ab AB\n'.,séÄ ") for _ in range(30)).replace("  ", " ") for _ in range(600)]
    texts += ["", " a", " ", "a ", "don't I'll", "  x", "x. y, z!", " .", "a\nb c", "Word word WORD", "<|endoftext|> a", "Ω ärger İstanbul", "long " * 40_000, "x" * 30_000]
    library, ours = Tokenizer.from_file(tokenizer_path(name)), BatchEncoder(tokenizer_path(name), kind)
    ours.memory = HashMemory(bits)
    want = [array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    whole = pa.array(["before", *texts])
    for a in range(0, len(texts), 170):
        assert ours.encode(whole.slice(1 + a, 170)) == want[a:a + 170]
    assert ours.encode(pa.array([], pa.string())) == [] and ours.encode(pa.array(["", ""])) == [b"", b""]
    assert ours.memory.n <= ours.memory.most


def test_memory_finds_what_it_keeps():
    rng = np.random.default_rng(0)
    memory, kept = HashMemory(10), {}
    for _ in range(20):
        hashes = np.unique(rng.integers(1, 2**63, 60, dtype=np.uint64) * np.uint64(2))
        hashes = hashes[memory.find(hashes) < 0]
        runs = [array("I", rng.integers(0, 50_000, rng.integers(0, 5)).tolist()).tobytes() for _ in hashes]
        kept |= dict(list(zip(hashes.tolist(), runs))[: memory.most - memory.n])
        memory.add(hashes, runs)
    assert len(kept) == memory.n == memory.most
    numbers = memory.find(np.array(list(kept), np.uint64))
    assert [memory.ids[memory.begin[k]:memory.begin[k + 1]].tobytes() for k in numbers] == list(kept.values())
