"""Spaced seeds: every stretch that the rule confirms holds a seed; overlaps against brute force; long items."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from roundsmith.llm import decontaminate
from roundsmith.llm.decontaminate import MASKS, SHORT_MASKS, Items, best_stretch


@pytest.mark.parametrize("length", range(5, 20))
def test_every_layout_of_substitutions_holds_a_seed(length):
    masks = [[p for p, c in enumerate(m) if c == "1"] for m in MASKS + (SHORT_MASKS if length < 10 else ())]
    for gone in itertools.combinations(range(1, length - 1), length // 5):
        assert any(o + m[-1] < length and not any(o + p in gone for p in m) for m in masks for o in range(length)), gone


def brute(text, item, percent=80, least=10):
    a, b = (re.findall(r"\w+", t.lower()) for t in (text, item))
    best = None
    for shift in range(-len(b), len(a)):
        for i in range(len(b)):
            for j in range(i + 1, len(b) + 1):
                if 0 <= i + shift and j + shift <= len(a) and j - i >= min(len(b), least) and a[i + shift] == b[i] and a[j - 1 + shift] == b[j - 1]:
                    same = sum(x == y for x, y in zip(a[i + shift:j + shift], b[i:j]))
                    if 100 * same >= percent * (j - i):
                        best = max(best or 0, j - i)
    return best


def test_overlaps_equal_brute_force():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(5, 22)))) for i in range(6)]
    texts = []
    for _ in range(150):
        copy = rng.choice(items)[1].split()
        a = rng.randrange(len(copy))
        part = copy[a if rng.random() < 0.3 else 0:]
        for _ in range(rng.randrange(0, 5)):
            part[rng.randrange(len(part))] = "x"
        texts.append(" ".join(rng.choices(words, k=rng.randrange(0, 8)) + part + rng.choices(words, k=4)))
    got = {(row, item): n for row, item, _, _, n, _ in Items(items, 5).overlaps(pa.array(texts), 80, 10)}
    want = {(row, i): brute(text, item) for row, text in enumerate(texts) for i, item in items}
    assert got == {k: n for k, n in want.items() if n}


def test_long_items_take_linear_time_and_memory(spark):
    rng = np.random.default_rng(0)
    same = rng.random(2_000_000) < 0.8
    began = time.process_time()
    best_stretch(same, 80)
    assert time.process_time() - began < 2
    words = [f"v{k}" for k in rng.integers(0, 10**6, 20_000)]
    text = "start " * 50 + " ".join("changed" if k % 7 == 3 else w for k, w in enumerate(words)) + " end" * 100_000
    docs = spark.createDataFrame([(1, text, "en"), (2, "“Quoted” – other", "en"), (None, None, "en")], "doc_id long, text string, item_id string")
    tests = spark.createDataFrame([(7, " ".join(words), "x")], "item_id long, text string, doc_id string")
    assert [tuple(r) for r in decontaminate.overlaps(docs, tests).collect()] == [(1, 7, 50, 0, 20_000, 20_000 - len(range(3, 20_000, 7)))]
    assert decontaminate.overlaps(docs, tests.where("false")).count() == 0 and decontaminate.overlaps(docs.where("false"), tests).count() == 0
