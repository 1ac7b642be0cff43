"""Secret scans: a trigram inverted index picks candidate texts for each rule, and the rule's expression verifies them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre  # the standard library's own parser of expressions
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from umbra.llm.common import FOLD, blocks, string_buffers, text_or_empty

#: A Boolean query over trigrams: True (nothing is mandatory), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | bytes | tuple


@dataclass(frozen=True)
class Rule:
    """kind, expression, and what a match must satisfy besides; a match that doesn't is dropped and not retried."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    passes: Callable[[re.Match], bool] | None = None


#: The base rules come first and in this order.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, lambda m: m.end(2) - m.start(2) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", passes=lambda m: m.end() - m.start() >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # as [0-9a-f]+ with its failing matches dropped: a match is always a whole run
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("code_host", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}|\bgithub_pat_[A-Za-z0-9_]{22,}|\bglpat-[A-Za-z0-9_-]{20,}"),
    Rule("chat", r"\bxox[abposr]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"\b[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("cloud_key", r"\bAIza[A-Za-z0-9_-]{35}|\bASIA[A-Z0-9]{16}\b"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("bearer", r"\bBearer [A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_login", r"(?<![a-z0-9+.-])[a-z0-9+.-]{2,}+://[^\s:/@]++:[^\s:/@]{3,}+@"),
    Rule("package", r"\b(?:npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,})"),
)


# Trigram queries, after Russ Cox's published account of regular-expression search with a trigram index. Of each part of
# an expression three things are known: the strings it can be, while these are few; else what they begin and end with;
# and a query that every match satisfies.
_FEW, _LONGEST = 24, 12


def both(kind: str, *queries: Query) -> Query:
    """Conjunction or disjunction, simplified."""
    keep, stop = (True, None) if kind == "and" else (None, True)
    parts: set = set()
    for q in queries:
        if q is stop and stop is not None:
            return True
        if q is keep and keep is not None:
            continue
        parts |= set(q[1]) if isinstance(q, tuple) and q[0] == kind else {q}
    if not parts:
        return True
    return next(iter(parts)) if len(parts) == 1 else (kind, frozenset(parts))


def trigrams_of(strings: set[bytes]) -> Query:
    """What a text must have that contains one of the strings."""
    if not strings or any(len(s) < 3 for s in strings):
        return True
    return both("or", *(both("and", *(s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


@dataclass
class _Part:
    exact: set[bytes] | None
    prefix: set[bytes]
    suffix: set[bytes]
    query: Query = True


_ANY = {b""}


def _literal(strings: set[bytes]) -> _Part:
    return _Part(strings, strings, strings)


def _joined(a: _Part, b: _Part) -> _Part:
    query = both("and", a.query, b.query)
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= _FEW:
        exact = {x + y for x in a.exact for y in b.exact}
        if max(map(len, exact), default=0) <= _LONGEST:
            return _Part(exact, exact, exact, query)
        return _Part(None, {s[:_LONGEST] for s in exact}, {s[-_LONGEST:] for s in exact}, both("and", query, trigrams_of(exact)))
    left, right = (a.exact if a.exact is not None else a.suffix), (b.exact if b.exact is not None else b.prefix)
    across = {x + y for x in left for y in right} if len(left) * len(right) <= _FEW else _ANY
    for part in (a, b):
        if part.exact is not None:
            query = both("and", query, trigrams_of(part.exact))
    prefix = {x + y for x in a.exact for y in right} if a.exact is not None and len(a.exact) * len(right) <= _FEW else a.prefix
    suffix = {x + y for x in left for y in b.exact} if b.exact is not None and len(left) * len(b.exact) <= _FEW else b.suffix
    query = both("and", query, trigrams_of(across))
    return _Part(None, {s[:_LONGEST] for s in prefix}, {s[-_LONGEST:] for s in suffix}, query)


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= _FEW:
        return _literal(set().union(*(p.exact for p in parts)))
    full = [both("and", p.query, trigrams_of(p.exact)) if p.exact is not None else p.query for p in parts]
    ends = [set().union(*(p.exact if p.exact is not None else getattr(p, side) for p in parts)) for side in ("prefix", "suffix")]
    return _Part(None, *(e if len(e) <= _FEW else _ANY for e in ends), both("or", *full))


def _characters(items: list, fold: bool) -> set[bytes] | None:
    chars: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            chars.add(chr(value))
        elif op is sre.RANGE and value[1] - value[0] < _FEW:
            chars |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    found = {(c.lower() if fold else c).encode() for c in chars}
    return found if len(found) <= _FEW // 4 else None


def _part(tree: list, fold: bool) -> _Part:
    out, run = _literal({b""}), b""
    for op, value in [*tree, (sre.AT, None)]:
        if op is sre.LITERAL:  # literals in a row are one string
            c = chr(value)
            run += (c.lower() if fold else c).encode()
            continue
        if run:
            out, run = _joined(out, _literal({run})), b""
        if op is sre.IN:
            found = _characters(value, fold)
            p = _literal(found) if found else _Part(None, _ANY, _ANY)
        elif op is sre.SUBPATTERN:
            p = _part(value[3], fold)
        elif op is sre.BRANCH:
            p = _either([_part(x, fold) for x in value[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            p = _part(inner, fold)
            if low == 0:
                p = _either([p, _literal({b""})]) if high == 1 and p.exact is not None else _Part(None, _ANY, _ANY)
            elif (low, high) != (1, 1):
                first = p.exact if p.exact is not None else p.prefix
                last = p.exact if p.exact is not None else p.suffix
                p = _Part(None, first, last, both("and", p.query, trigrams_of(p.exact or set())))
        elif op is sre.AT:
            continue
        else:  # anything else may be any string
            p = _Part(None, _ANY, _ANY)
        out = _joined(out, p)
    return out


def trigram_query(pattern: str, flags: int = re.ASCII) -> Query:
    """The Boolean query over trigrams (in lower case under IGNORECASE) that every text with a match satisfies."""
    p = _part(list(parser.parse(pattern, flags)), bool(flags & re.IGNORECASE))
    return both("and", p.query, trigrams_of(p.exact) if p.exact is not None else both("and", trigrams_of(p.prefix), trigrams_of(p.suffix)))


def leaves(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(leaves(q) for q in query[1]))




class Index:
    """Postings, by trigram, of a run of texts: only of trigrams that some query names, so its size is bounded by the texts."""

    def __init__(self, wanted: list[bytes]):
        self.place = {g: i for i, g in enumerate(wanted)}
        self.slot = np.zeros(1 << 24, np.uint16)
        for g, i in self.place.items():
            self.slot[g[0] << 16 | g[1] << 8 | g[2]] = i + 1

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each trigram: which texts have it."""
        out = np.zeros((len(self.place), len(offsets) - 1), bool)
        if len(data) < 3:
            return out
        wide = data.astype(np.uint32)
        slots = self.slot[wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]]
        at = np.flatnonzero(slots)
        text = np.searchsorted(offsets, at, "right") - 1
        whole = at + 3 <= offsets[text + 1]
        out[slots[at[whole]] - 1, text[whole]] = True
        return out


def answer(query: Query, postings: np.ndarray, place: dict[bytes, int]) -> np.ndarray:
    """The texts that satisfy the query; a rule without mandatory trigrams is looked for in all of them."""
    if query is True:
        return np.ones(postings.shape[1], bool)
    if isinstance(query, bytes):
        return postings[place[query]]
    parts = [answer(q, postings, place) for q in query[1]]
    return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def spelled(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def _scan(rules: tuple[Rule, ...], base: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, r.flags) for r in rules]
        queries = [trigram_query(r.pattern, r.flags) for r in rules]
        folds = [bool(r.flags & re.IGNORECASE) for r in rules]
        index = {f: Index(sorted(set().union(*(leaves(q) for q, g in zip(queries, folds, strict=True) if g == f), set()))) for f in set(folds)}
        kinds = tuple(r.kind for r in rules)
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = batch.column("text")
            data, offsets = string_buffers(texts)
            n = batch.num_rows
            candidate = np.zeros((len(rules), n), bool)
            for lo, hi in blocks(offsets):
                here, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                found = {f: x.postings(FOLD[here] if f else here, at) for f, x in index.items()}
                for k, q in enumerate(queries):
                    candidate[k, lo:hi] = answer(q, found[folds[k]], index[folds[k]].place)
            counts = np.zeros((base, n), np.int64)
            digests, spans = [empty] * n, [""] * n
            for i in np.flatnonzero(candidate.any(0)).tolist():
                text, hits = texts[i].as_py(), []
                for k in np.flatnonzero(candidate[:, i]).tolist():
                    passes = rules[k].passes
                    hits += [(m.start(), k, m.end()) for m in compiled[k].finditer(text) if passes is None or passes(m)]
                if not hits:
                    continue
                hits.sort()
                own = [h for h in hits if h[1] < base]
                for _, k, _ in own:
                    counts[k, i] += 1
                digests[i] = hashlib.sha256(spelled(own, kinds).encode()).hexdigest()
                spans[i] = spelled(hits, kinds)
            arrays = [batch.column("doc_id"), *(pa.array(c) for c in counts), pa.array(digests), pa.array(spans)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in kinds[:base]), "base_sha256", "spans"])

    return each


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """doc_id, n_<kind> of each base kind, base_sha256 and spans for each row of docs.

    Each run of texts is an index segment: the trigrams its texts have are posted, each rule's Boolean query intersects
    postings, and the rule's expression is applied to the texts that remain; a rule without mandatory trigrams is
    applied to all. Spans are kind:start:end in code points, by start and then rule order; spans of different rules may
    overlap. A null or empty text has none; a very long one is looked at whole, by expressions that read it once. Repeated
    rows each give a row; other columns, whatever their names, are left out; an empty table gives none.
    """
    schema = "doc_id long, " + "".join(f"n_{r.kind} long, " for r in rules[:base]) + "base_sha256 string, spans string"
    return text_or_empty(docs).mapInArrow(_scan(rules, base), schema)
