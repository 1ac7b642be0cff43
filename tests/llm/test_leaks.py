"""Overlaps with a benchmark at its edges: short items, shared phrases, very long items."""

import random
import time

import numpy as np
import pyarrow as pa

from umbra.llm import decontaminate
from umbra.llm.common import string_buffers

from .conftest import rows_of


def found(items, texts, **options):
    p = decontaminate.probe(list(range(len(items))), items)
    return decontaminate.overlaps(*string_buffers(pa.array(texts)), p, **options).tolist()


def names(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def test_short_items_are_found_whole_with_as_many_changes_as_the_share_allows():
    rng = random.Random(1)
    for n in range(1, 13):
        item = names(rng, n)
        for gone in range(n + 1):
            for _ in range(4):
                changed = list(item)
                for i in rng.sample(range(n), gone):
                    changed[i] = "zzz"
                text = " ".join([*names(rng, 5), *changed, *names(rng, 5)])
                hit = found([" ".join(item)], [text])
                if n - gone >= 0.8 * n and (n < 10 or gone <= 1):
                    assert hit == [[0, 0, 5, n, n - gone]], (n, gone)
                elif n - gone < 0.8 * n:
                    assert hit == [], (n, gone)


def test_a_phrase_that_all_items_share_costs_no_verification_of_all(monkeypatch):
    rng = random.Random(2)
    phrase = names(rng, 14)
    items = [" ".join([*names(rng, 12), *phrase, *names(rng, 12)]) for _ in range(10_000)]
    texts = [" ".join([*names(rng, 40), *phrase, *names(rng, 40)]) for _ in range(20)] + [f"{' '.join(names(rng, 30))} {items[77]} end"]
    start = time.time()
    assert found(items, texts) == [[20, 77, 30, 25, 25]]
    assert time.time() - start < 60


def test_a_very_long_item_is_found_in_part():
    rng = random.Random(3)
    long = names(rng, 100_000)
    items = [" ".join(long), " ".join(names(rng, 30))]
    texts = [" ".join([*names(rng, 10), *long[70_000:70_040], *names(rng, 10)]), items[1], " ".join(names(rng, 60)), " ".join(long[99_985:])]
    assert [r[:2] for r in found(items, texts)] == [[0, 0], [1, 1]]
    assert found(items, texts)[0][2:] == [10, 25, 25]


def test_blocks_give_what_one_block_gives(spark, odd):
    rng = random.Random(4)
    texts = [r.text for r in odd.collect() if r.text]
    items = [" ".join(t.split()[:40]) for t in texts[:8]] + [" ".join(names(rng, 20)), "a", ""]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    columns = ("doc_id", "item_id", "start", "length", "equal")
    assert rows_of(decontaminate.leaks(odd, benchmark), *columns) == rows_of(decontaminate.leaks(odd, benchmark, block_seeds=600), *columns)
    one, more = (rows_of(decontaminate.drop_leaks(odd, benchmark, block_seeds=b), "doc_id", "text") for b in (1 << 20, 600))
    assert one == more and len(one) < odd.count()
    assert np.isfinite(decontaminate.SHARE)
