import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from umbra.llm import shingles

from .conftest import words
from .test_near_duplicates import grouped


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, text, times):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), times):
        w[i] = "".join(rng.choice("xyz") for _ in range(9))
    return " ".join(w)


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(12)
    line = " ".join(words(rng, 30))
    base = [" ".join(words(rng, n, 8)) for n in (50, 49, 48, 90, 120, 200, 400, 6, 3)]
    rows = [*base, *base[:2], "", None, base[0].upper()]
    rows += [edited(rng, b, t) for b in base[:7] for t in (1, 2, 3, 4, 5) for _ in range(2)]
    rows += [edited(rng, base[4], 1) for _ in range(25)] + [edited(rng, base[6], 8) for _ in range(10)]
    rows += [f"{line} " + " ".join(words(rng, rng.randint(2, 40))) for _ in range(30)]
    return list(enumerate(rows))


@pytest.mark.parametrize(("bucket", "block"), [(32, 1024), (2, 1024), (2, 3)])
def test_the_stage_links_what_brute_force_jaccard_links(spark, near_texts, bucket, block, monkeypatch):
    monkeypatch.setattr(shingles, "LEADERS", 1)
    df = spark.createDataFrame(near_texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.label for r in shingles.labelled(df, bucket=bucket, block=block).collect()}
    sets = [shingle_set(t) for _, t in near_texts]
    want = grouped(sets, similar)
    mine = [got[d] for d, _ in near_texts]
    assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i in range(len(mine)) for j in range(i))
    kept = sorted(r.doc_id for r in shingles.keep_one(df, bucket=bucket).collect())
    assert kept == sorted({min(d for (d, _), k in zip(near_texts, want, strict=True) if k == w) for w in want})


def test_near_copies_at_four_fifths_go(spark):
    rng = random.Random(5)
    pairs = []
    for k in range(20):
        text = " ".join(words(rng, 100, 8))
        pairs += [(2 * k, text), (2 * k + 1, edited(rng, text, 2))]
    similarities = [len(a & b) / len(a | b) for a, b in ((shingle_set(pairs[i][1]), shingle_set(pairs[i + 1][1])) for i in range(0, 40, 2))]
    assert min(similarities) >= 0.8
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(pairs, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))


def test_a_passage_that_long_texts_share_is_not_shipped_once_for_each_shingle(spark):
    rng = random.Random(21)
    passage = " ".join(words(rng, 1500, 8))
    texts = [f"{passage} " + " ".join(words(rng, 1500, 8)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = shuffled()
    assert len({r.label for r in shingles.labelled(df).collect()}) == len(texts)
    assert shuffled() - before < 15 * sum(map(len, texts))


def test_open_buckets_hold_every_pair_of_like_sizes_that_is_not_connected(spark):
    rng = random.Random(22)
    sets = {c: (rng.choice([1, 3, 4, 5, 16, 20, 25, 79, 80, 99, 100, 125, 1000, 1250, 1251]), rng.randrange(25)) for c in range(60)}
    buckets = [rng.sample(sorted(sets), rng.randint(2, 7)) for _ in range(60)]
    buckets += buckets[:30]
    grouped = spark.createDataFrame([(t, c, *sets[c]) for t, b in enumerate(buckets) for c in b], "t long, c long, n long, g long")
    rooms = shingles._open(grouped, (4, 5))
    members = {}
    for r in shingles._by_size(grouped, (4, 5)).join(rooms, ["t", "s"]).collect():
        members.setdefault((r.t, r.s), []).append(r)
    got = {(x.c, y.c) for b in members.values() for x in b for y in b if x.c < y.c and x.g != y.g and not (x.low and y.low)}
    alike = lambda x, y: 5 * min(sets[x][0], sets[y][0]) >= 4 * max(sets[x][0], sets[y][0])
    want = {(x, y) for b in buckets for x in b for y in b if x < y and sets[x][1] != sets[y][1] and alike(x, y)}
    assert want and want <= got
    same = [(k[1], tuple(sorted(r.c for r in b))) for k, b in members.items()]
    assert len(same) == len(set(same)) and all(len(members[r.t, r.s]) == r.m for r in rooms.collect())


def test_similar_sizes_are_of_classes_that_follow_each_other(spark):
    n = spark.range(1, 20000).select(F.col("id").alias("n"), F.floor(F.col("id") * 5 / 4).alias("o"))
    far = n.select((shingles._class("o", (4, 5)) - shingles._class("n", (4, 5))).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert tuple(far) == (0, 1)


def test_fewer_words_in_sql_are_those_of_folded(spark):
    rng = random.Random(23)
    bits = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (16, 32, 32, 64, 256)]
    got = [r.x for r in spark.createDataFrame([(b,) for b in bits], "bits array<long>").coalesce(1).select(shingles._fewer("bits").alias("x")).collect()]
    assert got == [shingles.folded(np.array(b, np.int64)).tolist() if len(b) > 16 else b for b in bits]
