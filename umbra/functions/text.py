"""Column functions over texts and types; all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions import fixed

_FLAGS = {"IGNORECASE": "iu", "MULTILINE": "m", "DOTALL": "s"}


def java(pattern: str, flags: str = "") -> str:
    """A Python expression for str as Java's dialect: Unicode classes, flags by name joined with |, braces in classes escaped."""
    names = [f.strip() for f in flags.split("|") if f.strip()]
    unknown = [f for f in names if f not in _FLAGS]
    if unknown:
        raise ValueError(f"no such flags: {unknown}")
    return f"(?U{''.join(_FLAGS[f] for f in names)})" + pattern.replace(r"[<\[{]", r"[<\[\{]").replace(r"[>\]}]", r"[>\]\}]")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often it is used.

    A lambda is interpreted, so a large expression in it can't make a generated method too large to be compiled.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces(text: Column, pattern: str) -> Column:
    """Array of (before, found): what the pattern finds, each with what stands before it; the last has no find."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return zipped


def needed(pattern: str) -> list[list[str]]:
    """Of each group of plain words in a Python expression that a match must go through: its words, one of which a match has."""
    plain = r"[^()\[\]\\?{}+*.|^$]+"
    bare = re.sub(r"\((?:[^()\[\]\\]|\\.|\[[^\]]*\])*\)", "", re.sub(r"\[[^\]]*\]", "", pattern))
    if "|" in bare or "(" in bare:
        return []
    return [g.split("|") for g in re.findall(rf"\(({plain}(?:\|{plain})*)\)(?![?*{{])", pattern)]


def counted(text: Column, pattern: str, flags: str = "") -> Column:
    """How often a Python expression finds something; texts without the words that it needs aren't searched by it."""
    found = F.regexp_count(text, F.lit(java(pattern, flags))).cast("long")
    lacks = [~reduce(or_, [F.contains(text, F.lit(w)) for w in words]) for words in needed(pattern)] if "IGNORECASE" not in flags else []
    return F.when(reduce(or_, lacks), F.lit(0).cast("long")).otherwise(found) if lacks else found


def rewritten(text: Column, pattern: str, replacement: Callable[[Column, Column], Column]) -> Column:
    """text with each find replaced by replacement(find, its number from 0), which a plain regexp_replace can't compute."""

    def put(x: Column) -> Column:
        parts = F.zip_with(F.slice(x["before"], 1, F.size(x["found"])), F.transform(x["found"], replacement), lambda a, b: F.concat(a, b))
        return F.when(F.size(x["found"]) == 0, x["text"]).otherwise(F.concat(F.concat_ws("", parts), F.element_at(x["before"], -1)))

    split = lambda t: F.struct(t.alias("text"), F.split(t, pattern, -1).alias("before"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"))
    return once(text, lambda t: once(split(t), put))


def finds(df: DataFrame, key: Sequence[str], text: str, pattern: str) -> DataFrame:
    """key columns, idx, start, end, found for each find of the pattern, in code points, end exclusive.

    key must identify rows. Offsets are running sums over a row's pieces, so long texts with many finds stay linear.
    """
    each = df.select(*key, F.posexplode(pieces(F.col(text), pattern)).alias("idx", "p")).select(*key, "idx", "p.before", "p.found")
    upto = Window.partitionBy(*key).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("before") + F.coalesce(F.length("found"), F.lit(0))).over(upto)
    return each.withColumn("end", end.cast("int")).where("found is not null").select(*key, "idx", (F.col("end") - F.length("found")).alias("start"), "end", "found")


def cleaned(text: Column) -> Column:
    """Words of text with one space between them."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def context_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def replacement_key(kind: Column, original: Column) -> Column:
    return F.concat_ws(":", kind, original)


def placeholder(kind: Column, *key: Column) -> Column:
    """<TYPE:8 hex digits>, of the hash of the type and the rest of the key."""
    return F.concat(F.lit("<"), kind, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", kind, *key), 256), 1, 8), F.lit(">"))


def type_name(raw: Column) -> Column:
    """A raw type name in its normal form: upper case, single underscores, without numbers at its end."""
    x = F.regexp_replace(F.upper(F.trim(raw)), "[- ]", "_")
    x = F.regexp_replace(F.regexp_replace(x, r"(?:[_-]?\d+)+$", ""), "[^A-Z_]+", "")
    return F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_|_$", "")


def canonical_type(raw: Column, unknown: str = "PII") -> Column:
    """The canonical type of a raw name: an exact name, else the first hint it matches, else `unknown`; none for none."""

    def of(key: Column) -> Column:
        out = F.when(key.isNull() | (key == ""), F.lit(None).cast("string"))
        for kind, names in fixed.TYPE_NAMES.items():
            out = out.when(key.isin(*names.split()), F.lit(kind))
        for kind, hint in fixed.TYPE_HINTS:
            found = key.rlike(hint)
            out = out.when(found & ~F.contains(key, F.lit("USER")) if kind == "NAME" else found, F.lit(kind))
        rest = type_name(F.lit(unknown))
        return out.otherwise(F.when(rest == "", F.lit(None).cast("string")).otherwise(rest))

    return once(type_name(raw), of)


def canonical_placeholders(text: Column, unknown: str = "PII") -> Column:
    """text with the type inside each placeholder made canonical; its brackets stay, and need not match."""
    p = java(fixed.PLACEHOLDER)

    def one(found: Column, _: Column) -> Column:
        kind = F.coalesce(canonical_type(F.regexp_extract(found, p, 2), unknown), F.lit(unknown))
        return F.concat(F.regexp_extract(found, p, 1), kind, F.regexp_extract(found, p, 3))

    return rewritten(text, p, one)


def spliced(text: Column, spans: Column, value: Callable[[Column], Column]) -> Column:
    """text with spans (structs with start and end) replaced by value(span), from the last start to the first.

    Spans of equal start keep their order; overlapping ones are spliced into the text as already changed.
    """
    order = F.array_sort(F.transform(spans, lambda s, i: F.struct((-s["start"]).alias("at"), i.alias("i"), s.alias("s"))))
    step = lambda t, x: F.concat(F.substring(t, F.lit(1), x["s"]["start"]), value(x["s"]), F.substring(t, x["s"]["end"] + 1, F.length(t)))
    return F.aggregate(order, text, step)


def sane(spans: Column, text: Column) -> Column:
    """Spans that lie in the text and aren't empty."""
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)))


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\x{4E00}-\\x{9FFF}]")


def paragraphs(text: Column) -> Column:
    """Non-blank parts between blank lines; else between lines; else the whole text."""
    parts = lambda sep: F.filter(F.split(text, sep, -1), lambda x: F.length(cleaned(x)) > 0)
    return F.when(F.contains(text, F.lit("\n\n")), parts("\n\n")).when(F.contains(text, F.lit("\n")), parts("\n")).otherwise(F.array(text))


def without_prefixes(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    for prefix in fixed.PREFIXES:
        out = F.regexp_replace(out, rf"(?U)^{prefix}\s*", "")
    return out


def prompt(template: str, text: Column) -> Column:
    """The template with its slot {RAW_TEXT} filled."""
    return F.concat(*[x for i, part in enumerate(template.split("{RAW_TEXT}")) for x in ([text] if i else []) + [F.lit(part)]])


def rewrite_prompt(noisy: Column, clean: Column, language: str) -> Column:
    kind = "de-identified Chinese text" if language == "zh" else "de-identified text"
    head = f"Rewrite the following {kind} to be fluent and natural. Preserve all replacement values exactly.\nINPUT: "
    return F.concat(F.lit(head), noisy, F.lit("\nOUTPUT: "), clean, F.lit("\n"))


def triggers(text: Column, banned: Sequence[str] = fixed.BANNED) -> Column:
    """What makes an output break the format, in order; empty if nothing does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    needles = [F.when(F.contains(low, F.lit(n)), F.lit(n)) for n in fixed.NEEDLES]
    left = F.when(F.contains(low, F.lit(fixed.MARKUP_LEFT[0])) | F.contains(low, F.lit(fixed.MARKUP_LEFT[1])), F.lit(fixed.MARKUP_TRIGGER))
    phrases = [F.when(F.contains(low, F.lit(p.strip().lower())), F.lit(p.strip())) for p in banned if p.strip()]
    return F.when(F.length(cleaned(low)) == 0, F.array(F.lit("<EMPTY>"))).otherwise(F.array_compact(F.array(*needles, left, *phrases)))


def repetition(text: Column, width: int = 3) -> Column:
    """The share of character 3-grams that occur more than once in the text.

    Grams are sorted, so that equal ones stand together, and runs are counted by comparing neighbours.
    """
    grams = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(text) - (width - 1)), lambda i: F.substring(text, i, width)))
    step = lambda a, g: F.struct(
        g.alias("last"), F.when(g == a["last"], a["run"] + 1).otherwise(F.lit(1)).alias("run"),
        (a["n"] + F.when(g == a["last"], F.when(a["run"] == 1, 2).otherwise(1)).otherwise(0)).alias("n"),
    )
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("n"))
    total = F.length(text) - (width - 1)
    return F.when(F.coalesce(F.length(text), F.lit(0)) < width, F.lit(0.0)).otherwise(F.aggregate(grams, start, step, lambda a: a["n"]) / total)


def leaked(values: Column, text: Column) -> Column:
    return F.filter(values, lambda v: (v != "") & F.contains(text, v))
