"""Joins of places in long documents, which go by buckets, against plain loops."""

import random

from umbra.operators import documents


def test_long_documents(spark):
    rng = random.Random(6)
    cuts = sorted(rng.sample(range(1, 30_000), 12))
    segs = [(1, k, a, b, (k, 0, k + 1, 9)) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 30_000], strict=True))]
    some = []
    for i in range(60):
        a = rng.choice([rng.randrange(30_000), 4096 * rng.randrange(8), 4096 * rng.randrange(1, 8) - 1])
        some.append((1, i, a, min(30_000, a + rng.choice([0, 1, 5, 3000, 9000]))))
    box = "struct<left:int,top:int,right:int,bottom:int>"
    segments = spark.createDataFrame(segs, f"doc_id long, segment_id int, start int, end int, bbox {box}").selectExpr("*", "0 AS page_index")
    spans = spark.createDataFrame(some, "doc_id long, span_id int, start int, end int")
    got = sorted((r.span_id, r.segment_id) for r in documents.anchored(spans, segments).collect())
    inside = {i: next((s[1] for s in segs if s[2] <= a < s[3] and b <= s[3]), None) for _, i, a, b in some}
    assert got == sorted(inside.items(), key=lambda x: x[0])
    meets = lambda s, a, b: s[3] > a and s[2] < b
    first = {}
    for s in segs:
        for _, i, a, b in sorted(some, key=lambda x: (x[2], x[3])):
            if meets(s, a, b):
                first.setdefault(s[1], (a, b))
    got = {r.segment_id: (r.start, r.end) for r in documents.overlapped(spans, segments).collect()}
    assert got == first
    boxes = {(r.start, r.end): tuple(r.bbox) for r in documents.boxes_of(spans, segments).collect()}
    want = {}
    for _, _, a, b in some:
        met = [s[4] for s in segs if meets(s, a, b)]
        if met:
            want[a, b] = (min(m[0] for m in met), 0, max(m[2] for m in met), 9)
    assert boxes == want
