import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from umbra.llm import debruijn, suffixes
from umbra.llm.repeats import SHIFT, Spec, Symbols, keyed

from .conftest import rows_of


def covered(sequences, length, earlier=None):
    """Which symbols a repeated window covers; earlier: sort keys, and only windows that occurred before count."""
    seen, out = Counter(), []
    windows = lambda s: [s[i : i + length] for i in range(len(s) - length + 1)]
    if earlier is None:
        for s in sequences:
            seen.update(windows(s))
    order = range(len(sequences)) if earlier is None else sorted(range(len(sequences)), key=lambda k: earlier[k])
    marks = {}
    for k in order:
        s, mark = sequences[k], [False] * len(sequences[k])
        for i, w in enumerate(windows(s)):
            again = seen[w] > 1 if earlier is None else seen[w] > 0
            if earlier is not None:
                seen[w] += 1
            if again:
                mark[i : i + length] = [True] * length
        marks[k] = mark
    out = [marks[k] for k in range(len(sequences))]
    return out


def words_of(text):
    return tuple(w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w)


@pytest.mark.parametrize(("width", "anchor"), [(35, 12), (5, 2), (8, 8)])
def test_words(odd, odd_texts, width, anchor):
    sequences = [words_of(t) for _, t in odd_texts]
    want = [(d, len(s), sum(c), hashlib.sha256(" ".join(w for w, x in zip(s, c, strict=True) if not x).encode()).hexdigest()) for (d, _), s, c in zip(odd_texts, sequences, covered(sequences, width), strict=True)]
    assert rows_of(debruijn.remove_repeats(odd, width, anchor), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


@pytest.mark.parametrize(("length", "anchor", "ways"), [(200, 80, 1024), (40, 12, 1024), (40, 12, 1), (30, 30, 4)])
def test_bytes(odd, odd_texts, length, anchor, ways):
    sequences = [(t or "").encode() for _, t in odd_texts]
    want = []
    for (d, _), s, c in zip(odd_texts, sequences, covered(sequences, length), strict=True):
        spans = sum(x and (i == 0 or not c[i - 1]) for i, x in enumerate(c))
        want.append((d, len(s), sum(c), spans, hashlib.sha256(bytes(b for b, x in zip(s, c, strict=True) if not x)).hexdigest()))
    got = rows_of(suffixes.remove_repeats(odd, length, anchor, ways=ways), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(want, key=repr)


def test_the_first_copy_stays(spark, odd_texts):
    texts = [(i, t) for i, (_, t) in enumerate(odd_texts)]  # without equal rows, so that the order is plain
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    sequences = [(t or "").encode() for _, t in texts]
    want = [(i, sum(c)) for i, c in enumerate(covered(sequences, 60, list(range(len(texts)))))]
    for ways in (1024, 1):
        assert rows_of(suffixes.remove_repeats(docs, 60, 20, first_stays=True, ways=ways), "doc_id", "n_removed") == sorted(want, key=repr)
    sequences = [words_of(t) for _, t in texts]
    want = [(i, sum(c)) for i, c in enumerate(covered(sequences, 10, list(range(len(texts)))))]
    assert rows_of(debruijn.remove_repeats(docs, 10, 4, first_stays=True), "doc_id", "n_removed") == sorted(want, key=repr)


@pytest.mark.parametrize("raw", [b"abracadabra abracadabra cadabra", b"a" * 40, b"ab\0\0ab\0ab\0\0\0ab", bytes(range(30))])
def test_previous_and_next_factors_are_those_of_a_plain_search(raw):
    data, cap = np.frombuffer(raw, np.uint8), 11
    at = np.arange(len(data) - cap + 1)
    order, lcp = suffixes.suffix_order(data, at, cap)
    cut = [raw[i : i + cap] for i in at]
    assert [cut[i] for i in order] == sorted(cut)
    common = lambda x, y: next((k for k in range(cap) if x[k] != y[k]), cap)
    assert lcp.tolist() == [0] + [common(cut[order[k - 1]], cut[order[k]]) for k in range(1, len(order))]
    rng = np.random.default_rng(1)
    for source in (at, at[::-1].copy(), rng.permutation(len(at))):  # where a suffix stands need not follow its place
        where = source[order]
        for least in (1, 4, cap):
            floor = lambda n: n if n >= least else 0
            earlier, later = suffixes.previous_factors(where, lcp, least), suffixes.next_factors(where, lcp, least)
            for k, i in enumerate(order):
                assert earlier[k] == floor(max((common(cut[i], cut[j]) for j in at if source[j] < source[i]), default=0))
                assert later[k] == floor(max((common(cut[i], cut[j]) for j in at if source[j] > source[i]), default=0))


def clashing(spark):
    """Two long texts of one 32-bit hash (Spark's own), different in every window, and an unrelated one."""
    rows = spark.range(150_000).selectExpr("concat_ws(' ', transform(sequence(1, 60), k -> hex(hash(id, k)))) AS text")
    rows = rows.selectExpr("text", "hash(text) AS h")
    pair = rows.groupBy("h").agg(F.collect_list("text").alias("t")).where("size(t) > 1").first()
    return pair.t[0], pair.t[1], " ".join(f"other{k}" for k in range(80))


@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_of_one_32_bit_hash_are_rows_of_their_own(spark, doc_id):
    a, b, c = clashing(spark)
    texts = [a, b, a[:600] + " " + c]
    docs = spark.createDataFrame(list(zip((doc_id, doc_id, 1), texts, strict=True)), "doc_id long, text string")
    raw, words = [t.encode() for t in texts], [words_of(t) for t in texts]
    removed = [[sum(x) for x in covered(s, k)] for s, k in ((raw, 200), (words, 35))]
    assert removed[0] == [600, 0, 600] and removed[1][0] == removed[1][2] > 35 and not removed[1][1]
    got = sorted((r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(docs).collect())
    assert got == sorted(zip(map(len, raw), removed[0], strict=True))
    got = sorted((r.n_words, r.n_removed) for r in debruijn.remove_repeats(docs).collect())
    assert got == sorted(zip(map(len, words), removed[1], strict=True))


def test_rows_without_an_id_that_are_repeated(spark, odd_texts):
    text = odd_texts[0][1] + " " + odd_texts[1][1]
    docs = spark.createDataFrame([(None, text)] * 40 + [(None, text[:-3] + "xyz"), (1, "short")], "doc_id long, text string")
    got = [(r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(docs.repartition(6)).collect()]
    size = len(text.encode())
    assert sorted(got) == sorted([(size, size)] * 40 + [(size, size - len(text.encode()) + len(text[:-3].encode())), (5, 0)])


def test_nonbranching_paths_are_compacted_as_by_walking(spark):
    edges = [(i, i + 1, 2) for i in range(0, 9)] + [(9, 20, 1), (9, 30, 1), (20, 21, 5), (30, 31, 1), (31, 32, 1), (21, 40, 1), (32, 40, 3), (40, 41, 1)]
    edges += [(100, 101, 1), (101, 102, 1), (102, 100, 1), (200, 200, 1)]  # cycles
    got = debruijn.compacted(spark.createDataFrame(edges, "source long, target long, n long")).collect()
    assert len(got) == len(edges)
    paths = {}
    for r in got:
        paths.setdefault(r.unitig, []).append((r.offset, r.source, r.target, r.n))
    walked = sorted(tuple((s, t) for _, s, t, _ in sorted(p)) for p in paths.values())
    line = tuple((i, i + 1) for i in range(9))
    assert [p for p in walked if len(p) > 1] == sorted([line, ((9, 20), (20, 21), (21, 40)), ((9, 30), (30, 31), (31, 32), (32, 40))])
    for p in paths.values():
        at = 0
        for offset, _, _, n in sorted(p):
            assert offset == at
            at += n


def test_spans_on_one_passage_have_the_same_words(spark, odd_texts):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(300))
    texts = [f"x{k} " * int(rng.integers(1, 50)) + " ".join(passage.split()[int(a) :]) + f" y{k}" * 40 for k, a in enumerate(rng.integers(0, 150, 6))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = keyed(docs).join(debruijn.repeated_spans(docs), ["k1", "k2"]).collect()
    seen = {}
    for r in rows:
        words, start, n = r.text.split(), r.place >> SHIFT, r.place & ((1 << SHIFT) - 1)
        for k in range(n):
            seen.setdefault((r.unitig, r.offset + k), set()).add(" ".join(words[start + k : start + k + 35]))
    assert seen and all(len(x) == 1 for x in seen.values())
    assert len({u for u, _ in seen}) < len(seen) / 10


def test_paths_hold_every_window_once():
    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog " * 5, np.uint8)
    offsets = np.array([0, 100, 100, 130, len(data)])
    text, start, n, _, _ = Symbols(data, offsets, Spec(False, 20, 6)).paths()
    got = sorted((t, s + i) for t, s, k in zip(text.tolist(), start.tolist(), n.tolist(), strict=True) for i in range(k))
    sizes = np.diff(offsets)
    assert got == [(t, s) for t in range(4) for s in range(max(0, sizes[t] - 19))]


def test_empty_table(none):
    assert debruijn.remove_repeats(none).collect() == []
    assert suffixes.remove_repeats(none).collect() == []
