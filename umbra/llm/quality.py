"""Quality rules by weak supervision: rules vote or abstain, and expectation-maximisation weighs their votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import (
    BYTE_BASE,
    BYTE_CODES,
    WORD_BASES,
    Words,
    blocks,
    mixed,
    per_text,
    prepared,
    running,
    safe_hashes,
    settled,
    stretch,
    string_buffers,
    text_or_empty,
    whole_windows,
    within,
)

_SYMBOL, _UPPER, _LOWER, _STOP = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", range(65, 91), range(97, 123), b".!?"))
ABSTAIN, BAD, GOOD = 0, 1, 2
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """What the rules look at, for each text."""
    w = Words(data, offsets)
    n = w.counts()
    solid = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = per_text(solid[w.ends] - solid[w.starts], w.first)
    prefix = running(BYTE_CODES[data], BYTE_BASE)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = data == 10
    cut[offsets] = True
    begins = np.flatnonzero(cut[:-1])
    ends = np.append(begins[1:], len(data)) if len(begins) else begins
    ends = ends - (data[ends - 1] == 10) if len(begins) else ends
    used = np.searchsorted(w.starts, begins) < np.searchsorted(w.starts, ends)
    begins, ends = begins[used], ends[used]
    lines = np.searchsorted(offsets, begins, "right") - 1
    _, again = within(lines, safe_hashes(data, prefix, begins, ends))
    texts = len(offsets) - 1
    owners = w.owners()
    at = whole_windows(w.first, 5)
    times, _ = within(owners[at], stretch(running(mixed(w.hashes), WORD_BASES[0]), at, at + 5, WORD_BASES[0]))
    step = np.zeros(len(w.hashes) + 1, np.int64)
    hit = at[times > 1]
    np.add.at(step, hit, 1)
    np.add.at(step, hit + 5, -1)
    covered = np.cumsum(step[:-1]) > 0
    _, seen = within(owners, w.hashes)
    last = data[w.ends - 1]
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(lines, again, minlength=texts).astype(np.int64),
        "n_repeat_words": per_text(covered, w.first),
        "lines": np.bincount(lines, minlength=texts),
        "upper": per_text(_UPPER[data], offsets),
        "lower": per_text(_LOWER[data], offsets),
        "distinct": per_text(~seen, w.first),
        "stops": per_text(_STOP[last], w.first),
        "shouts": per_text(last == ord("!"), w.first),
        "marked": per_text(_SYMBOL[last], w.first),
    }


#: A rule gives (bad, good): where it votes so, and abstains elsewhere.
RULES = {
    "short": lambda m: (m["n_words"] < 10, None),
    "repeats": lambda m: (m["n_repeat_words"] > 0.15 * m["n_words"], None),
    "repeated lines": lambda m: (m["n_dup_lines"] > 0.3 * m["lines"], None),
    "symbols": lambda m: (m["n_symbols"] > 0.1 * m["n_words"], None),
    "marked words": lambda m: (m["marked"] > 0.1 * m["n_words"], None),
    "shouting": lambda m: (m["shouts"] > 0.2 * m["n_words"], None),
    "capitals": lambda m: (m["upper"] > 0.5 * (m["upper"] + m["lower"]), None),
    "word length": lambda m: ((m["word_chars"] > 14 * m["n_words"]) | (m["word_chars"] < 2.2 * m["n_words"]), None),
    "few different words": lambda m: ((m["distinct"] < 0.1 * m["n_words"]) & (m["n_words"] >= 50), None),
    "sentences": lambda m: (None, (m["stops"] > 0.02 * m["n_words"]) & (m["stops"] < 0.34 * m["n_words"]) & (m["shouts"] <= 0.1 * m["n_words"])),
    "plain": lambda m: (None, (m["n_symbols"] <= 0.02 * m["n_words"]) & (m["upper"] < 0.3 * (m["upper"] + m["lower"]))),
}


def patterns(m: dict[str, np.ndarray]) -> np.ndarray:
    """All votes of a text as one number: a digit to base 3 for each rule."""
    out = np.zeros(len(m["n_words"]), np.int64)
    for rule in RULES.values():
        bad, good = rule(m)
        vote = np.where(bad, BAD, ABSTAIN) if bad is not None else np.where(good, GOOD, ABSTAIN)
        out = out * 3 + vote
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_buffers(batch.column("text"))
        for lo, hi in blocks(offsets):
            m = measured(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
            arrays = [batch.column("doc_id")[lo:hi], *(pa.array(m[k].astype(np.int64)) for k in COUNTS), pa.array(failed), pa.array(patterns(m))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *COUNTS, "base_failed", "votes"])


FEATURES = "doc_id long, " + "".join(f"{k} long, " for k in COUNTS) + "base_failed boolean, votes long"


def fit(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """The probability that a text is good, for each pattern of votes, from how many texts have each pattern.

    Good and bad texts are two latent classes in which rules vote independently. Expectation-maximisation starts from
    rules that are right in nine of ten votes and estimates each class's share and each rule's chance to vote bad, good
    or to abstain in it. A bad vote always stays likelier for bad texts, and a good one for good texts, so that the
    classes can't trade places.
    """
    if not counts:
        return {}
    keys, n, m = sorted(counts), np.array([counts[k] for k in sorted(counts)], float), len(RULES)
    digits = np.array([[k // 3 ** (m - 1 - j) % 3 for j in range(m)] for k in keys])
    votes = np.eye(3)[digits]
    good = 1 / (1 + 9.0 ** ((digits == BAD).sum(1) * 2 - (digits == GOOD).sum(1)))
    for _ in range(rounds):
        weight = np.stack((n * good, n * (1 - good)))
        share = (weight.sum(1) + 1) / (weight.sum() + 2)
        chance = (np.einsum("ck,kjv->cjv", weight, votes) + 0.5) / (weight.sum(1)[:, None, None] + 1.5)
        for vote, better in ((BAD, 1), (GOOD, 0)):
            chance[better, :, vote] = np.maximum(chance[better, :, vote], chance[1 - better, :, vote])
        chance /= chance.sum(2, keepdims=True)
        log = np.log(share)[:, None] + np.einsum("cjv,kjv->ck", np.log(chance), votes)
        before, good = good, 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        if np.abs(good - before).max() < 1e-9:
            break
    return dict(zip(keys, good.tolist(), strict=True))


def judged(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and p_good for each row of docs.

    Votes are counted over all rows; there are at most 3 patterns to the number of rules, so the counts are small. A row
    that fails the base rules isn't kept, whatever its votes; others are if their posterior is at least `least`. A null
    or empty text has no words and fails. Repeated rows are judged alike, rows with a null doc_id like others; an empty
    table gives no rows.
    """
    rows = settled(text_or_empty(docs).mapInArrow(_features, FEATURES), "features")
    p = fit({r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()})
    table = docs.sparkSession.createDataFrame(list(p.items()), "votes long, p_good double")
    return rows.join(F.broadcast(table), "votes").select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("p_good") >= least)).alias("kept"), "p_good"
    )


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Texts are read twice, for the counts and to filter."""
    counts = text_or_empty(docs).mapInArrow(_features, FEATURES).groupBy("votes").count()
    good = {k for k, p in fit({r["votes"]: r["count"] for r in counts.collect()}).items() if p >= least}
    schema = docs.schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").fill_null("")
            both = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), text], ["doc_id", "text"])
            keep = [v in good and not f for part in _features(iter([both])) for v, f in zip(part["votes"].to_pylist(), part["base_failed"].to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return prepared(docs, *docs.columns).mapInArrow(each, schema)
