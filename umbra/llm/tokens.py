"""Token ids of whole texts, and attribution of tokens to sections by their places in the text."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from umbra.llm.common import blocks, prepared, string_buffers, text_or_empty

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Texts with what the faster library treats otherwise, or can't take: special tokens' strings, rare planes, long space.
_SLOW = re.compile(r"<\||[\U00011000-\U0010ffff]|\s{1000}")


class Encoder:
    """Ids of byte-level BPE as the tokenizers library gives them.

    Where a file of the same vocabulary as ranks is named, ordinary texts go through tiktoken, which gives the same ids
    several times as fast; texts that match _SLOW always go through tokenizers.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(vocabulary), None
        self.lengths = np.zeros(self.slow.get_vocab_size(), np.int64)
        marks = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
        for token, i in self.slow.get_vocab().items():  # each character of a token stands for one byte
            self.lengths[i] = len(token.encode()) if token in marks else len(token)
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or _SLOW.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(2)
def encoder(vocabulary: str, ranks: str | None) -> Encoder:
    """One for each Python worker."""
    return Encoder(vocabulary, ranks)


def paths(vocabulary: str | None, ranks: str | None) -> tuple[str, str | None]:
    """The files to use; by default the public ones. A vocabulary without ranks is encoded by tokenizers alone."""
    if vocabulary is None:
        return public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS)
    return vocabulary, ranks


def line_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, owners): lines with their line feed; an empty text has one empty line, other texts no empty last one."""
    cut = np.zeros(len(data) + 1, bool)
    cut[1:] = data == 10
    cut[offsets[1:]] = True
    cut[0] = False
    ends = np.flatnonzero(cut)
    owners = np.searchsorted(offsets, ends, "left") - 1
    empty = np.flatnonzero(np.diff(offsets) == 0)
    ends, owners = np.concatenate((ends, offsets[empty])), np.concatenate((owners, empty))
    order = np.lexsort((ends, owners))
    return ends[order], owners[order]


def _allot(start: int, end: int, ends: np.ndarray, first: int, rule: str) -> int:
    """The section of a token [start, end) that begins in section `first` and crosses its border."""
    if rule == "first":
        return first
    best, most, k, at = first, 0, first, start
    while at < end:
        share = min(end, ends[k]) - at
        if rule == "last" and share or share > most:
            best, most = k, share
        at, k = max(at, min(end, ends[k])), k + 1
    return best


def _attribution(vocabulary: str, ranks: str | None, rule: str):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ranks)
        for batch in batches:
            data, offsets = string_buffers(batch.column("text"))
            for lo, hi in blocks(offsets, 1 << 20):
                base = offsets[lo]
                here, at = data[base : offsets[hi]], offsets[lo : hi + 1] - base
                ends, owners = line_ends(here, at)
                ids = [enc.ids(t) for t in batch.column("text")[lo:hi].to_pylist()]
                stops = np.cumsum(enc.lengths[np.concatenate(ids)]) if ids else np.zeros(0, np.int64)
                starts = np.concatenate(([0], stops[:-1])) if len(stops) else stops
                a, b = np.searchsorted(ends, starts, "right"), np.searchsorted(ends, stops - 1, "right")
                crossing = np.flatnonzero(a != b)
                border = np.zeros(len(ends) + 1, np.int64)
                for i in crossing.tolist():
                    border[a[i] : b[i] + 1] += 1
                    a[i] = _allot(int(starts[i]), int(stops[i]), ends, int(a[i]), rule)
                counts = np.bincount(a, minlength=len(ends))[: len(ends)]
                points = np.concatenate(([0], np.cumsum((here & 0xC0) != 0x80)))
                first = np.searchsorted(owners, np.arange(hi - lo))
                begins = np.concatenate(([0], ends[:-1]))
                begins = np.where(np.isin(np.arange(len(ends)), first), at[owners], begins)
                zero = points[at[owners]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi].take(pa.array(owners))]
                    + [pa.array(x.astype(np.int64)) for x in (np.arange(len(ends)) - first[owners], points[begins] - zero, points[ends] - zero, counts, border[:-1])],
                    ["doc_id", "section", "start", "end", "n_tokens", "n_border"],
                )

    return each


def attribute(docs: DataFrame, rule: str = "majority", vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Tokens of each line of each text: doc_id, section, start, end (code points), n_tokens, n_border.

    A whole text is encoded once. Token places, from the byte lengths of its tokens, and line places are both sorted,
    so they are joined as intervals by binary search. A token that crosses borders counts once, by `rule`: "first"
    (where its first byte is), "last", or "majority" (the section with most of its bytes, the earlier of equals);
    n_border counts the tokens that cross into or out of a section. The counts of a text add up to its tokens. A line
    ends after its line feed. A null or empty text has one empty section with no tokens. Repeated rows each give theirs.
    """
    if rule not in ("first", "last", "majority"):
        raise ValueError(f"no such rule: {rule}")
    schema = "doc_id long, section long, start long, end long, n_tokens long, n_border long"
    return text_or_empty(docs).mapInArrow(_attribution(*paths(vocabulary, ranks), rule), schema)


def token_totals(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) for each row."""
    vocabulary, ranks = paths(vocabulary, ranks)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ranks)
        for batch in batches:
            n = pa.array([len(enc.ids(t)) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n], ["doc_id", "n_tokens"])

    return text_or_empty(prepared(docs, "doc_id", "text")).mapInArrow(each, "doc_id long, n_tokens long")
