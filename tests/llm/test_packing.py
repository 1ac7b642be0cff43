import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from umbra.llm import packing, tokens

from .conftest import rows_of

HF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array([*HF.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_every_id_is_packed_once_and_sequences_have_no_gaps(odd, odd_texts):
    rows = packing.pack(odd, group=16).collect()
    want = sorted((repr(d), k * 1024, len(p), zlib.crc32(p.tobytes()), len(x)) for d, t in odd_texts for x in [ids_of(t)] for k, p in enumerate(np.split(x, range(1024, len(x), 1024))))
    assert sorted((repr(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_little_padding(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', CAST(pmod(hash(id), 900) AS INT) + 1) AS text")
    rows = packing.pack(docs).collect()
    assert sum(r.length for r in rows) / (1024 * len({r.sequence_id for r in rows})) > 0.98


def test_first_fit_decreasing_against_a_plain_one():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 100, 400)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    used = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, u in enumerate(used) if u + sizes[i] <= 100), len(used))
        used += [0] * (b == len(used))
        assert (bins[i], offsets[i]) == (b, used[b])
        used[b] += sizes[i]


def test_kept_ids_are_the_documents(odd, odd_texts):
    rows = packing.pack(odd, keep_ids=True).collect()
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_empty_table(none):
    assert packing.pack(none).collect() == []
    assert tokens.attribute(none).collect() == []


def test_ids_are_those_of_the_library_for_unusual_texts():
    enc = tokens.encoder(*tokens.paths(None, None))
    for text in ["", " ", "a<|endoftext|>b", "x" * 5000, " " * 5000 + "y", "\n" * 3000, "𓀀 𝒳 😀", "l'été ça va? ½ ٣", "  tab\t\r\n", "�\x00\x01"]:
        assert enc.ids(text).tolist() == HF.encode(text, add_special_tokens=False).ids


def allotted(text, rule):
    """Counts for each line, by the library's own offsets of each token's bytes."""
    lines, sections = text.encode().split(b"\n"), []
    for i, line in enumerate(lines):
        part = line + b"\n" * (i < len(lines) - 1)
        if part:
            sections.append(part)
    ends = np.cumsum([len(s) for s in sections]).tolist()
    counts, at = [0] * len(sections), 0
    enc = tokens.encoder(*tokens.paths(None, None))
    for i in HF.encode(text, add_special_tokens=False).ids:
        size = int(enc.lengths[i])
        share = [max(0, min(at + size, e) - max(at, b)) for b, e in zip([0, *ends], ends, strict=False)]
        touched = [k for k, s in enumerate(share) if s]
        counts[{"first": touched[0], "last": touched[-1], "majority": max(touched, key=lambda k: (share[k], -k))}[rule]] += 1
        at += size
    return counts


def test_tokens_are_attributed_to_lines(spark):
    texts = ["a\nb\n\n\nc", "no line feed", "\n", "é\nü 😀\n \n x", "end\n", "\n\n\n\n\n\n\n\n\n\n\n\nlast", "line one\r\nline two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rule in ("first", "last", "majority"):
        got = tokens.attribute(docs, rule).collect()
        for d, text in enumerate(texts):
            mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.section)
            assert [r.n_tokens for r in mine] == allotted(text, rule), (rule, text)
            assert "".join(text[r.start : r.end] for r in mine) == text


def test_odd_texts_have_all_their_tokens(odd, odd_texts):
    totals = {}
    for r in tokens.attribute(odd).collect():
        totals[repr(r.doc_id)] = totals.get(repr(r.doc_id), 0) + r.n_tokens
    want = {}
    for d, t in odd_texts:
        want[repr(d)] = want.get(repr(d), 0) + len(ids_of(t)) - 1
    assert totals == want
    assert rows_of(tokens.attribute(odd).where("doc_id = 111"), "section", "start", "end", "n_tokens") == [(0, 0, 0, 0)]
