import random
import re
import zlib

import numpy as np

import corpus_pipeline
from umbra.llm import pii, quality, tagger
from umbra.llm.queries import ORACLES, QUERIES

from .test_near_duplicates import grouped
from .test_packing import ids_of
from .test_scans import _leaky
from .test_shingles import shingle_set, similar


def plain_votes(text):
    """The measures of one text, counted plainly, and its votes."""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "lines": len(lines),
        "upper": len(re.findall("[A-Z]", text)), "lower": len(re.findall("[a-z]", text)), "distinct": len(set(words)), "stops": sum(w[-1] in ".!?" for w in words), "shouts": sum(w[-1] == "!" for w in words), "marked": sum(w[-1] in "#*$%&|<>" for w in words),
    }
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return int(quality.patterns({k: np.array([v]) for k, v in m.items()})[0]), failed


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "ter", "ou", "re", "che", "la", "mo", "pa"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n)) + "."
    item = prose(4)
    base = [prose(rng.randint(3, 9)) for _ in range(60)]
    near = [b.replace("an", "on", 1) for b in base[:10]]
    rows = base + near + base[10:15] + [f"{base[20]} {item} {base[21]}", f"{prose(5)} Mail me at jo.doe@example.com or 10.1.2.3.", f"{prose(5)} Call +1 (415) 555-1234 now."]
    rows += ["BUY NOW!! CHEAP!! " * 15, "a b c", "", None, "x### y*** z$$$ " * 10]
    return list(enumerate(rows)), [(0, item), (1, prose(5)), (2, None)]


def test_the_pipeline_against_its_stages_done_plainly(spark, tmp_path):
    docs, items = texts(8)
    wide = [(d, t, "en", "s", None if t is None else len(t)) for d, t in docs]
    spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    votes = [plain_votes(t or "") for _, t in docs]
    counts = {}
    for v, _ in votes:
        counts[v] = counts.get(v, 0) + 1
    p = quality.fit(counts)
    left = [(d, t) for (d, t), (v, failed) in zip(docs, votes, strict=True) if p[v] >= 0.5 and not failed]
    # Near-duplicates are texts whose sets of five-word shingles have a similarity of 0.8 or more.
    label = grouped([shingle_set(t) for _, t in left], similar)
    left = [(d, t) for (d, t), k, i in zip(left, label, range(len(left)), strict=True) if k == i]
    left = [(d, t) for d, t in left if not _leaky(t, [x for _, x in items])]
    assert 40 < len(left) < len(docs) - 8
    model = tagger.trained()
    spans = [every for _, every in pii.all_spans([t for _, t in left], model)]
    want = []
    for (d, t), s in zip(left, spans, strict=True):
        x = ids_of(pii.masked(t, s))
        want += [(d, k * 1024, len(part), zlib.crc32(part.tobytes()), len(x)) for k, part in enumerate(np.split(x, range(1024, len(x), 1024)))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    assert any("[EMAIL]" in pii.masked(t, s) for (_, t), s in zip(left, spans, strict=True))


def test_stages_keep_the_columns_of_documents(spark, odd, tmp_path):
    spark.createDataFrame([(0, "some words of a benchmark item here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema.names == odd.schema.names, name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii", "packing"]


def test_every_operator_has_a_query():
    assert sorted(int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)
