"""Personal data: base expressions, and spans that a character-level tagger adds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import per_text, prepared, string_buffers, text_or_empty
from umbra.llm.tagger import KINDS, SPELLED_AT, Tagger, tagged, trained

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match never starts within digits: it would start before them
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT, _LETTERS = re.compile("@|" + SPELLED_AT.pattern, re.ASCII | re.IGNORECASE), re.compile("[A-Za-z]")
_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), 64]] = True
#: How much better a tagged span must score than no span, for each character.
MARGIN = 0.5
Found = list[tuple[int, int, int]]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; each @ is looked at once, so long runs of letters cost no more than others."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        domain, start = _DOMAIN.match(text, at + 1), at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", at + 1)
    return found


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(values)) % 10 == 0


def is_ip(text: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in text.split(".")))


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> Found:
    """(kind, start, end) by kind and start."""
    found = [(0, *s) for s in emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if is_ip(m.group())]
    found += [(2, *m.span()) for m in _CARD.finditer(text) if is_card(m.group())]
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return found


def plausible(kind: int, text: str) -> bool:
    """Whether a tagged span has what its kind can't be without; how it is written is for the tagger to know."""
    digits = len(digits_of(text))
    if "\n" in text or not text.strip() == text:
        return False
    if kind == 0:
        return len(text) <= 254 and bool(_AT.search(text)) and ("." in text or "dot" in text.lower())
    if kind == 1:
        return text.count(":") >= 2 and len(text) <= 45 or 4 <= digits <= 12 and not _LETTERS.search(text.replace("dot", ""))
    if kind == 2:
        return 13 <= digits <= 19 and not _LETTERS.search(text)
    return 8 <= digits <= 15 and not _LETTERS.search(text)


def all_spans(texts: list[str], model: Tagger, margin: float = MARGIN) -> list[tuple[Found, Found]]:
    """For each text its base spans, and those with the tagger's: plausible ones that overlap no base span."""
    out = []
    for text, more in zip(texts, tagged(model, texts), strict=True):
        base = base_spans(text)
        taken, at, extra = sorted((s, e) for _, s, e in base), 0, []
        for kind, s, e, gain in sorted(more, key=lambda x: x[1]):
            while at < len(taken) and taken[at][1] <= s:  # overlapping ones are few and end in about the same order
                at += 1
            free = all(e <= a or b <= s for a, b in taken[max(0, at - 3) : at + 3])
            if free and gain >= margin and plausible(kind, text[s:e]):
                extra.append((kind, s, e))
        out.append((base, sorted(base + extra)))
    return out


def spelled(spans: Found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _candidates(texts: pa.Array) -> np.ndarray:
    """The rows with a digit, an @ or one that is spelled out; no kind is without one."""
    data, offsets = string_buffers(texts)
    spelled = pc.match_substring_regex(texts, f"(?i){SPELLED_AT.pattern}").to_numpy(zero_copy_only=False)
    return np.flatnonzero((per_text(_MARK[data], offsets) > 0) | spelled)


def find(docs: DataFrame, model: Tagger | None = None, margin: float = MARGIN) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for each row of docs.

    The counts and base_sha256 are of base spans, which may overlap if they differ in kind; spans has the tagger's too.
    Spans are kind:start:end in code points, by kind and start. A null or empty text has none; a repeated row gives its
    row again; an empty table gives none.
    """
    model = model or trained()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts, n = batch.column("text"), batch.num_rows
            some = _candidates(texts).tolist()
            counts, digests, spans = np.zeros((len(KINDS), n), np.int64), [empty] * n, [""] * n
            for i, (base, every) in zip(some, all_spans([texts[i].as_py() for i in some], model, margin), strict=True):
                for k, _, _ in base:
                    counts[k, i] += 1
                digests[i], spans[i] = hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(every)
            arrays = [batch.column("doc_id"), *(pa.array(c) for c in counts), pa.array(digests), pa.array(spans)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    return text_or_empty(docs).mapInArrow(each, schema)


def masked(text: str, spans: Found) -> str:
    """text with each run of overlapping spans replaced by the kind of its first, in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Tagger | None = None, margin: float = MARGIN) -> DataFrame:
    """docs with personal data masked in text; a column n_chars, if there is one, is the new length. Nulls stay null."""
    model, names = model or trained(), docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            some = _candidates(texts.fill_null("")).tolist()
            new = texts.to_pylist()
            for i, (_, every) in zip(some, all_spans([new[i] for i in some], model, margin), strict=True):
                new[i] = masked(new[i], every)
            yield batch.set_column(names.index("text"), batch.schema.field("text"), pa.array(new, batch.schema.field("text").type))

    out = prepared(docs, *names).mapInArrow(each, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out
