"""Replacement and masking of spans, with events and replacement maps, placeholders and markup."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import fixed
from umbra.functions.text import canonical_type, context_hash, java, once, replacement_key, rewritten, sane, spliced
from umbra.operators.detection import SPAN, SPAN_KIND, Detector, nested, portioned, spans_in, widened

MODES = {"replace": "replace", "replacement": "replace", "blackbox": "blackbox", "black": "blackbox", "redact": "blackbox", "mask": "blackbox"}
MASK = "█"


def mode_of(name: str) -> str:
    """replace or blackbox; an unknown name raises rather than meaning one of them."""
    if name.strip().lower() not in MODES:
        raise ValueError(f"no such output mode: {name}")
    return MODES[name.strip().lower()]


def hashed_value(kind: Column, original: Column, context: Column) -> Column:
    """A value that depends on type, original and context alone, in the form of its type; made of hash digits in the JVM."""
    return once(F.struct(kind.alias("kind"), F.sha2(F.concat_ws(":", kind, original, context), 256).alias("digest")), lambda x: _formed(x["kind"], x["digest"]))


def _formed(kind: Column, digest: Column) -> Column:
    number = lambda at, size: F.conv(F.substring(digest, at, 12), 16, 10).cast("long") % F.lit(10**size)
    digits = lambda at, size: F.lpad(number(at, size).cast("string"), size, "0")
    forms = {
        "ID": F.concat(digits(1, 3), F.lit("-"), digits(13, 2), F.lit("-"), digits(25, 4)),
        "PHONE": F.concat(F.lit("555-"), (number(1, 5) % 900 + 100).cast("string"), F.lit("-"), digits(13, 4)),
        "EMAIL": F.concat(F.lit("user"), digits(1, 6), F.lit("@example.com")),
        "UNIFIED_BUSINESS_NO": digits(1, 8),
        "PASSPORT": F.concat(F.element_at(F.array(*map(F.lit, ("P", "PA", "PB"))), (number(13, 3) % 3 + 1).cast("int")), digits(1, 7)),
        "MEDICAL_ID": F.concat(F.lit("M"), digits(1, 7)),
        "CONTRACT_NO": F.concat(F.lit("CN-"), digits(1, 6)),
        "ORGANIZATION": F.concat(F.lit("Example Organization "), (number(1, 8) % 9999 + 1).cast("string")),
        "NAME": F.element_at(F.array(*map(F.lit, fixed.NAMES["en"])), (number(1, 4) % 4 + 1).cast("int")),
        "ADDRESS": F.concat((number(1, 6) % 999 + 1).cast("string"), F.lit(" Main Street")),
    }
    out = F.when(kind == "TW_ID", forms["ID"])
    for name, form in forms.items():
        out = out.when(kind == name, form)
    return out.otherwise(F.concat(F.lit("<"), kind, F.lit(":"), F.substring(digest, 1, 8), F.lit(">")))


def seeded_value(kind: str, key: str, seed: int, taiwan: bool) -> str:
    """The value that a generator seeded so gives for a type, drawing in this order."""
    rng = random.Random(seed)
    digits = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    if kind in ("ID", "TW_ID"):
        if taiwan:
            return rng.choice(fixed.ID_LETTERS) + rng.choice(["1", "2"]) + digits(7) + digits(1)
        return f"{rng.randint(0, 999):03d}-{rng.randint(0, 99):02d}-{rng.randint(0, 9999):04d}"
    makers = {
        "PHONE": lambda: "09" + digits(8) if taiwan else f"555-{rng.randint(100, 999):03d}-{rng.randint(0, 9999):04d}",
        "EMAIL": lambda: f"user{rng.randint(0, 999999):06d}@example.com",
        "UNIFIED_BUSINESS_NO": lambda: f"{rng.randint(0, 99999999):08d}",
        "PASSPORT": lambda: rng.choice(["P", "PA", "PB"]) + digits(7),
        "MEDICAL_ID": lambda: "M" + digits(7),
        "CONTRACT_NO": lambda: f"CN-{rng.randint(0, 999999):06d}",
        "ORGANIZATION": lambda: f"Example Organization {rng.randint(1, 9999)}",
        "NAME": lambda: rng.choice(list(fixed.NAMES["zh" if taiwan else "en"])),
        "ADDRESS": lambda: rng.choice(list(fixed.ADDRESSES["zh"])) if taiwan else f"{rng.randint(1, 999)} Main Street",
    }
    if kind in makers:
        return makers[kind]()
    return f"<{kind}:{hashlib.sha256(key.encode()).hexdigest()[:8]}>"


def fake_values(df: DataFrame, locale: str = "en_US") -> DataFrame:
    """df (type, original, context_hash, ...) with `value`, seeded by a hash of the three; the same values as users have."""
    taiwan = "tw" in locale.lower()

    @F.pandas_udf("string")
    def value(kind: pd.Series, original: pd.Series, context: pd.Series) -> pd.Series:
        keys = [f"{k}:{o}:{c}" for k, o, c in zip(kind, original, context, strict=True)]
        return pd.Series([seeded_value(k, key, int(hashlib.sha256(key.encode()).hexdigest()[:8], 16), taiwan) for k, key in zip(kind, keys, strict=True)])

    return df.withColumn("value", value("type", "original", "context_hash"))


def rewritten_documents(docs: DataFrame, mode: str = "replace") -> DataFrame:
    """docs (doc_id, text, entities, ...) with context_hash, output, events and replacement_map.

    Events are in the order of replacement, from the last span to the first; replacement_map has type:original -> value.
    Masked spans have events too, without a replacement, and no map.
    """
    mode = mode_of(mode)
    rows = docs.withColumn("context_hash", context_hash(F.col("text"))) if "context_hash" not in docs.columns else docs
    original = lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    if mode == "replace":
        value = lambda s: hashed_value(s["type"], original(s), F.col("context_hash"))
    else:
        value = lambda s: F.repeat(F.lit(MASK), s["end"] - s["start"])
    rows = rows.withColumn(
        "events",
        F.transform(
            F.array_sort(F.transform("entities", lambda s, i: F.struct((-s["start"]).alias("at"), i.alias("i"), s.alias("s")))),
            lambda x: F.struct(
                x["s"]["type"].alias("entity_type"), original(x["s"]).alias("original"), value(x["s"]).alias("replacement"),
                x["s"]["start"].alias("start"), (x["s"]["start"] + F.length(value(x["s"]))).alias("end"), x["s"]["source"].alias("source"),
            ),
        ),
    )
    pairs = F.transform("events", lambda e: F.struct(replacement_key(e["entity_type"], e["original"]).alias("key"), e["replacement"].alias("value")))
    empty = F.create_map().cast("map<string,string>")
    return rows.withColumn("output", spliced(F.col("text"), F.col("entities"), value)).withColumn(
        "replacement_map", F.map_from_entries(F.array_distinct(pairs)) if mode == "replace" else empty
    )


_EVENT = pa.struct([("entity_type", pa.string()), ("original", pa.string()), ("replacement", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("source", pa.string())])
EVENTS = "array<struct<entity_type:string,original:string,replacement:string,start:int,end:int,source:string>>"


def hashed_text(kind: str, original: str, context: str) -> str:
    """hashed_value for one span, outside the JVM."""
    digest = hashlib.sha256(f"{kind}:{original}:{context}".encode()).hexdigest()
    number = lambda at, size: int(digest[at - 1 : at + 11], 16) % 10**size
    digits = lambda at, size: f"{number(at, size):0{size}d}"
    forms = {
        "ID": lambda: f"{digits(1, 3)}-{digits(13, 2)}-{digits(25, 4)}",
        "PHONE": lambda: f"555-{number(1, 5) % 900 + 100}-{digits(13, 4)}",
        "EMAIL": lambda: f"user{digits(1, 6)}@example.com",
        "UNIFIED_BUSINESS_NO": lambda: digits(1, 8),
        "PASSPORT": lambda: ("P", "PA", "PB")[number(13, 3) % 3] + digits(1, 7),
        "MEDICAL_ID": lambda: "M" + digits(1, 7),
        "CONTRACT_NO": lambda: "CN-" + digits(1, 6),
        "ORGANIZATION": lambda: f"Example Organization {number(1, 8) % 9999 + 1}",
        "NAME": lambda: fixed.NAMES["en"][number(1, 4) % 4],
        "ADDRESS": lambda: f"{number(1, 6) % 999 + 1} Main Street",
    }
    form = forms.get("ID" if kind == "TW_ID" else kind)
    return form() if form else f"<{kind}:{digest[:8]}>"


#: A source of replacement values: (type, original, hash of the whole text) -> value; the same for the same three.
Provider = Callable[[str, str, str], str]


def replaced(text: str, spans: list[tuple], mode: str, provider: Provider = hashed_text) -> tuple[str, list[tuple]]:
    """The text with its spans replaced or masked, and the events, from the last span to the first.

    While spans are apart, the pieces between them are joined once; an overlap splices into the text as already changed.
    """
    context = hashlib.sha256(text.encode()).hexdigest() if mode == "replace" else ""
    done, parts, edge, rest = [], [], len(text), None
    for start, end, kind, _, source in sorted(spans, key=lambda s: -s[0]):
        original = text[start:end]
        value = provider(kind, original, context) if mode == "replace" else MASK * (end - start)
        done.append((kind, original, value, start, start + len(value), source))
        if end > edge or rest is not None:
            rest = text[:edge] + "".join(reversed(parts)) if rest is None else rest
            rest = rest[:start] + value + rest[end:]
            edge, parts = start, [rest[start:]]
            continue
        parts += [text[end:edge], value]
        edge = start
    return rest if rest is not None else text[:edge] + "".join(reversed(parts)), done


def deidentified(
    docs: DataFrame, found_by: Sequence[Detector], mode: str = "replace", provider: Provider | None = None
) -> DataFrame:
    """docs with entities, output, events and replacement_map: detection, resolution and rewriting in one pass of batches.

    provider: where values come from, instead of hashes in the form of their type; it is asked once for each type and
    original of a text, so that a text names one thing in one way.
    """
    mode, names = mode_of(mode), docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portioned(batches, "text"):
            spans, outputs, all_events, maps = [], [], [], []
            for text in batch.column(names.index("text")).to_pylist():
                found = spans_in(text or "", found_by)
                output, done = replaced(text or "", found, mode, lru_cache(None)(provider) if provider else hashed_text)
                spans.append(found)
                outputs.append(output)
                all_events.append(done)
                maps.append(list({f"{e[0]}:{e[1]}": e[2] for e in done}.items()) if mode == "replace" else [])
            arrays = [nested(spans, SPAN_KIND), pa.array(outputs, pa.string()), nested(all_events, _EVENT), pa.array(maps, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*names, "entities", "output", "events", "replacement_map"])

    return docs.mapInArrow(each, widened(docs, f"entities array<{SPAN}>, output string, events {EVENTS}, replacement_map map<string,string>"))


def events(results: DataFrame) -> DataFrame:
    """A row for each event: doc_id, seq (0 for the last span), and its fields; out_start is its place in the output."""
    each = results.select("doc_id", F.posexplode("events").alias("seq", "e"), "events")
    growth = F.aggregate(F.slice("events", F.col("seq") + 2, F.size("events")), F.lit(0), lambda a, e: a + (e["end"] - e["start"]) - F.length(e["original"]))
    return each.select("doc_id", "seq", "e.*", (F.col("e.start") + growth).alias("out_start"))


def replacement_map(events: DataFrame) -> DataFrame:
    """(doc_id, key, value), the value of the event with the smallest start where there are several."""
    key = replacement_key(F.col("entity_type"), F.col("original")).alias("key")
    return events.groupBy("doc_id", key).agg(F.min_by("replacement", F.struct("start", (-F.col("seq")).alias("s"))).alias("value"))


def with_placeholders(text: Column, spans: Column, unknown: str = "PII") -> Column:
    """text with each sane span of a known type replaced by <TYPE>, from the last to the first by start and end."""
    named = F.transform(sane(spans, text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), canonical_type(s["type"], unknown).alias("type")))
    ordered = F.array_sort(F.filter(named, lambda s: s["type"].isNotNull()))
    back = F.reverse(ordered)
    step = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("<"), s["type"], F.lit(">"), F.substring(t, s["end"] + 1, F.length(t)))
    return F.aggregate(back, text, step)


def masked_spans(text: Column, spans: Column, value: str = "") -> Column:
    """text with each sane span replaced by value, from the last to the first by start and end."""
    back = F.reverse(F.array_sort(F.transform(sane(spans, text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    return F.aggregate(back, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(value), F.substring(t, s["end"] + 1, F.length(t))))


def markup_format(text: Column) -> Column:
    """xml, bracket or none, by what the text has first in this order."""
    return F.when(text.rlike(java(fixed.XML_MARKUP, "DOTALL")), "xml").when(text.rlike(java(fixed.BRACKET_MARKUP, "DOTALL")), "bracket")


def markup_blocks(text: Column) -> Column:
    """The marked blocks of the text's one format: type, value, and the places of value and block, in order."""

    def blocks(pattern: str, xml: bool) -> Column:
        p = java(pattern, "DOTALL")
        before = F.transform(F.split(text, p, -1), lambda x: F.length(x))
        found = F.zip_with(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.slice(before, 1, F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))), lambda w, b: F.struct(w.alias("whole"), b.alias("before")))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<type:string,value:string,start:int,end:int,block_start:int,block_end:int>>").alias("out"))

        def step(a, x):
            start = a["at"] + x["before"]
            kind, value = F.regexp_extract(x["whole"], p, 1), F.regexp_extract(x["whole"], p, 2)
            tail = F.lit(6) if xml else F.length(kind) + 3
            end = start + F.length(x["whole"])
            block = F.struct(kind.alias("type"), value.alias("value"), (end - tail - F.length(value)).alias("start"), (end - tail).alias("end"), start.alias("block_start"), end.alias("block_end"))
            return F.struct(end.alias("at"), F.concat(a["out"], F.array(block)).alias("out"))

        return F.aggregate(found, first, step, lambda a: a["out"])

    fmt = markup_format(text)
    return F.when(fmt == "xml", blocks(fixed.XML_MARKUP, True)).when(fmt == "bracket", blocks(fixed.BRACKET_MARKUP, False)).otherwise(
        F.array().cast("array<struct<type:string,value:string,start:int,end:int,block_start:int,block_end:int>>")
    )


def masked_markup(text: Column, value: str = "") -> Column:
    """text with its marked blocks, tags and all, replaced by value."""
    xml, bracket = java(fixed.XML_MARKUP, "DOTALL"), java(fixed.BRACKET_MARKUP, "DOTALL")
    fmt = markup_format(text)
    plain = value.replace("\\", "\\\\").replace("$", "\\$")
    return F.when(fmt == "xml", F.regexp_replace(text, xml, plain)).when(fmt == "bracket", F.regexp_replace(text, bracket, plain)).otherwise(text)


def filled_placeholders(text: Column, context: Column, unknown: str = "PII") -> Column:
    """text with its i-th placeholder replaced by a value for RAW_TYPE:i in this context."""
    p = java(fixed.PLACEHOLDER)

    def one(found: Column, i: Column) -> Column:
        kind = lambda raw: F.coalesce(canonical_type(raw, unknown), F.lit(unknown))
        return once(F.regexp_extract(found, p, 2), lambda raw: hashed_value(kind(raw), F.concat_ws(":", raw, i.cast("string")), context))

    return rewritten(text, p, one)


def provided_placeholders(df: DataFrame, provider: Provider, column: str = "text", unknown: str = "PII") -> DataFrame:
    """df with `filled`: the i-th placeholder of a text is provider(canonical type, RAW_TYPE:i, hash of the text)."""
    pattern = re.compile(fixed.PLACEHOLDER)

    @F.pandas_udf("string")
    def fill(texts: pd.Series, contexts: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for text, context, names in zip(texts, contexts, kinds, strict=True):
            known, count = dict(names), iter(range(len(text or "")))
            put = lambda m: provider(known.get(m.group(2)) or unknown, f"{m.group(2)}:{next(count)}", context)  # noqa: E731, B023
            out.append(pattern.sub(put, text or ""))
        return pd.Series(out)

    raw = F.array_distinct(F.regexp_extract_all(column, F.lit(java(fixed.PLACEHOLDER)), F.lit(2)))
    named = F.transform(raw, lambda r: F.array(r, F.coalesce(canonical_type(r, unknown), F.lit(unknown))))
    return df.withColumn("filled", fill(column, context_hash(F.col(column)), named))


def noisy(df: DataFrame, key: str = "doc_id", seed: int = 0, swap: float = 0.35, space: float = 0.25, double: float = 0.08) -> DataFrame:
    """df with `noisy`: text with punctuation swapped, spaced or doubled. Each row's chances come from seed and its key."""
    swaps = {a: b for x, y in fixed.SWAPS.items() for a, b in ((x, y), (y, x))}

    def one(row: object, text: str | None) -> str:
        rng, out = random.Random(f"{seed}:{row}"), []
        for c in text or "":
            if c in swaps:
                c = swaps[c] if rng.random() < swap else c
                out.append(c)
                out.append(" " if rng.random() < space else "")
                out.append(c if rng.random() < double else "")
            else:
                out.append(c)
        whole = "".join(out)
        return (whole.replace("  ", " ") if rng.random() < 0.5 else whole.replace(" ", "  ")).strip()

    names = df.columns

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(noisy=[one(k, t) for k, t in zip(frame[key], frame["text"], strict=True)])[[*names, "noisy"]]

    return df.mapInPandas(each, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", noisy string")


