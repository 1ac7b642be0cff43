"""Detectors that run a token-classification model, and the windows, softmax and merging that they need."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

from umbra.operators.detection import Detector
from umbra.operators.spans import decoded

Found = tuple[int, int, str, float]


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the last axis, shifted so that no exponent overflows."""
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def token_windows(n: int, size: int = 512, overlap: float = 0.5) -> list[tuple[int, int]]:
    """Windows of `size` tokens over n, each sharing a part of the one before; the last ends with the text."""
    shared = min(max(0, int(size * overlap)), size - 1)
    out, start = [], 0
    while start < n:
        out.append((start, min(n, start + size)))
        if start + size >= n:
            break
        start += size - shared
    return out


def merged(found: Sequence[Found]) -> list[Found]:
    """Spans of a type that overlap by more than half of the shorter made one, by start, with the better score."""
    out: list[Found] = []
    for start, end, kind, score in sorted(found):
        last = next((i for i in range(len(out) - 1, -1, -1) if out[i][2] == kind), None)
        if last is not None:
            a, b, _, best = out[last]
            if min(b, end) - start > min(b - a, end - start) / 2:
                out[last] = (a, max(b, end), kind, max(best, score))
                continue
        out.append((start, end, kind, score))
    return sorted(out)


def windowed(find: Callable[[str], Sequence[Found]], size: int, source: str, threshold: float = 0.0) -> Detector:
    """A detector that gives a model windows of `size` characters, half of it apart, and merges what windows share."""

    def detect(text: str) -> list[tuple[int, int, str, float, str]]:
        every = [(s + at, e + at, kind, score) for at in range(0, len(text), max(1, size // 2)) for s, e, kind, score in find(text[at : at + size]) if score >= threshold]
        return [(*x, source) for x in merged(every)]

    return detect


def providers(wanted: Sequence[str], available: Sequence[str]) -> list[str]:
    """The wanted execution providers that are available, in order; the CPU's always comes last."""
    out = [p for p in wanted if p in available and p != "CPUExecutionProvider"]
    return [*out, "CPUExecutionProvider"]


@lru_cache(2)
def _session(model: str, tokenizer: str, wanted: tuple[str, ...]):
    """One session for each Python worker."""
    import onnxruntime
    from tokenizers import Tokenizer

    use = providers(wanted, onnxruntime.get_available_providers())
    return onnxruntime.InferenceSession(model, providers=use), Tokenizer.from_file(tokenizer)


def onnx_detector(model: str, tokenizer: str, labels: Sequence[str], threshold: float = 0.85, size: int = 512, overlap: float = 0.5, wanted: Sequence[str] = ()) -> Detector:
    """A detector for an exported token classifier: all windows of a text in one run, tags under the threshold are O.

    The paths must be where every executor sees them.
    """

    def detect(text: str) -> list[tuple[int, int, str, float, str]]:
        session, tok = _session(model, tokenizer, tuple(wanted))
        encoded = tok.encode(text, add_special_tokens=False)
        found: list[Found] = []
        parts = token_windows(len(encoded.ids), size, overlap)
        if parts:
            width = max(b - a for a, b in parts)
            ids, mask = np.zeros((len(parts), width), np.int64), np.zeros((len(parts), width), np.int64)
            for i, (a, b) in enumerate(parts):
                ids[i, : b - a], mask[i, : b - a] = encoded.ids[a:b], 1
            feeds = {x.name: mask if "mask" in x.name else np.zeros_like(ids) if "type" in x.name else ids for x in session.get_inputs()}
            chance = softmax(session.run(None, feeds)[0])
            for i, (a, b) in enumerate(parts):
                best = chance[i, : b - a].argmax(-1)
                tags = [(labels[k] if chance[i, j, k] >= threshold else "O", *encoded.offsets[a + j], float(chance[i, j, k])) for j, k in enumerate(best.tolist())]
                found += decoded(tags)
        return [(*x, "onnx") for x in merged(found)]

    return detect
