import random
import re

import xxhash

from umbra.llm import graph, simhash

from .conftest import rows_of


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(items, linked):
    """The index of the first item that each is connected to."""
    label = list(range(len(items)))
    changed = True
    while changed:
        changed = False
        for i in range(len(items)):
            for j in range(i):
                if label[i] != label[j] and linked(items[i], items[j]):
                    low = min(label[i], label[j])
                    label = [low if x in (label[i], label[j]) else x for x in label]
                    changed = True
    return label


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(4)
    rng = random.Random(1)
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not diff & m for m in masks)


def components_of(texts):
    fps = [fingerprint(t) for _, t in texts]
    label = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for k, (d, _) in zip(label, texts, strict=True):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    return [(d, f"{fp:016x}", least.get(k)) for (d, _), fp, k in zip(texts, fps, label, strict=True)]


def test_components_against_brute_force(odd, odd_texts):
    want = sorted(components_of(odd_texts), key=repr)
    assert rows_of(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id") == want
    assert rows_of(simhash.near_duplicates(odd, bucket=2), "doc_id", "fingerprint", "component_id") == want  # large buckets go the other way


def test_links_connect_all_pairs_within_the_radius(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for seed in list(fps)[:20]:  # chains of near values
        for _ in range(12):
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(seed)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    want = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    for bucket in (4096, 3):
        got = {r.node: r.label for r in graph.components(simhash.links(df, 4, bucket), "a", "b").collect()}
        mine = [got.get(simhash.signed(x), simhash.signed(x)) for x in fps]
        assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i in range(len(fps)) for j in range(i))


def test_a_long_chain_and_a_hub_are_one_component_each(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(500)]
    rng = random.Random(3)
    rng.shuffle(chain)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001 + i: 1000 for i in range(500)}


def test_one_of_each_group_is_kept(odd, odd_texts):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = components_of(odd_texts)
    named = {c for d, _, c in rows if c is not None}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in got if d is not None) == sorted(named)
    assert got.count(None) == len({f for d, f, c in rows if c is None})


def test_settled_tables_can_be_dropped(spark):
    import os

    from umbra.llm import common

    common.settled(spark.range(3).toDF("x"), "some")
    paths = [p.removeprefix("file://") for p in common._SETTLED]
    assert paths and all(map(os.path.isdir, paths))
    common.drop_settled(spark)
    assert not any(map(os.path.isdir, paths)) and not common._SETTLED


def test_empty_table(none):
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.keep_one(none).collect() == []
