"""A character-level bidirectional LSTM with CRF transitions, trained and applied in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 outside, 1 + 2k the first character of a span of kind k, 2 + 2k a later one.
TAGS = 1 + 2 * len(KINDS)
_LETTER, _OTHER, PAD = 128, 129, 130
CHARS = 131
Span = tuple[int, int, int]  # kind, start, end


def codes(text: str) -> np.ndarray:
    """A number for each character: ASCII as it is, other letters and other characters one each."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 128, x, np.where((x < 0x250) | (x > 0x370), _LETTER, _OTHER)).astype(np.int64)


def allowed() -> np.ndarray:
    """Which tag may follow which: a later character only follows its own kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


@dataclass
class Tagger:
    """Weights by name: for f (forward) and b (backward) the gates' input table, recurrence and output; bias; transitions."""

    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {"bias": np.zeros(TAGS), "moves": np.zeros((TAGS, TAGS))}
        for d in "fb":
            w[f"{d}x"] = rng.normal(0, 0.3, (CHARS, 4 * hidden))
            w[f"{d}x"][:, hidden : 2 * hidden] += 1  # gates that keep what is known, at first
            w[f"{d}h"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            w[f"{d}o"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, TAGS))
        return Tagger({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, ids: np.ndarray, d: str) -> dict[str, np.ndarray]:
        """States over time-major ids, for direction d; what training needs besides."""
        steps, n = ids.shape
        hidden = self.w[f"{d}h"].shape[0]
        x, u = self.w[f"{d}x"], self.w[f"{d}h"]
        h, c = np.zeros((steps + 1, n, hidden), x.dtype), np.zeros((steps + 1, n, hidden), x.dtype)
        gates, tanh_c = np.zeros((steps, n, 4 * hidden), x.dtype), np.zeros((steps, n, hidden), x.dtype)
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        at = 0
        for t in order:
            z = x[ids[t]] + h[at] @ u
            z[:, : 3 * hidden] = _sigmoid(z[:, : 3 * hidden])
            z[:, 3 * hidden :] = np.tanh(z[:, 3 * hidden :])
            i, f, o, g = (z[:, k * hidden : (k + 1) * hidden] for k in range(4))
            c[at + 1] = f * c[at] + i * g
            tanh_c[at] = np.tanh(c[at + 1])
            h[at + 1] = o * tanh_c[at]
            gates[at] = z
            at += 1
        out = h[1:] if d == "f" else h[:0:-1]
        return {"h": h, "c": c, "gates": gates, "tanh_c": tanh_c, "out": out}

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(time, window, tag) scores for time-major ids."""
        return self._run(ids, "f")["out"] @ self.w["fo"] + self._run(ids, "b")["out"] @ self.w["bo"] + self.w["bias"]

    def moves(self) -> np.ndarray:
        return np.where(allowed(), self.w["moves"], self.w["moves"].dtype.type(-1e4))

    def best(self, scores: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """The best tags by Viterbi for (time, row, tag) scores; row r has steps[r] of them."""
        total, n, _ = scores.shape
        moves, back = self.moves(), np.zeros(scores.shape, np.int8)
        now = scores[0] + np.where(np.arange(TAGS) % 2 == 0, np.where(np.arange(TAGS) == 0, 0, -1e4), 0)
        stay = np.arange(TAGS, dtype=np.int8)
        for t in range(1, total):
            each = now[:, :, None] + moves
            live = (t < steps)[:, None]
            back[t] = np.where(live, each.argmax(1), stay)
            now = np.where(live, each.max(1) + scores[t], now)
        tags = np.zeros((total, n), np.int64)
        tags[-1] = now.argmax(1)
        for t in range(total - 1, 0, -1):
            tags[t - 1] = back[t, np.arange(n), tags[t]]
        return tags

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of the gold tags, and its derivatives."""
        runs = {d: self._run(ids, d) for d in "fb"}
        e = runs["f"]["out"] @ self.w["fo"] + runs["b"]["out"] @ self.w["bo"] + self.w["bias"]
        steps, n, _ = e.shape
        moves, rows = self.moves(), np.arange(n)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = _lse(alpha[t - 1][:, :, None] + moves, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(moves + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        pairs = np.exp(alpha[:-1, :, :, None] + moves + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
        loss = z.sum()
        for t in range(steps):
            loss -= e[t, rows, gold[t]].sum() + (moves[gold[t - 1], gold[t]].sum() if t else 0)
            de[t, rows, gold[t]] -= 1
            if t:
                np.subtract.at(pairs, (gold[t - 1], gold[t]), 1)
        de /= n
        grads = {"bias": de.sum((0, 1)), "moves": np.where(allowed(), pairs / n, 0)}
        for d in "fb":
            run, u = runs[d], self.w[f"{d}h"]
            hidden = u.shape[0]
            grads[f"{d}o"] = np.einsum("tnh,tnk->hk", run["out"], de)
            dout = de @ self.w[f"{d}o"].T
            dz, dh, dc = np.zeros_like(run["gates"]), np.zeros((n, hidden)), np.zeros((n, hidden))
            for at in range(steps - 1, -1, -1):
                i, f, o, g = (run["gates"][at][:, k * hidden : (k + 1) * hidden] for k in range(4))
                dh = dh + dout[at if d == "f" else steps - 1 - at]
                tc = run["tanh_c"][at]
                dc = dc + dh * o * (1 - tc * tc)
                dz[at] = np.concatenate((dc * g * i * (1 - i), dc * run["c"][at] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), 1)
                dh, dc = dz[at] @ u.T, dc * f
            grads[f"{d}h"] = np.einsum("tnh,tnk->hk", run["h"][:-1], dz)
            seen = ids if d == "f" else ids[::-1]
            dx = np.zeros_like(self.w[f"{d}x"])
            np.add.at(dx, seen.ravel(), dz.reshape(-1, 4 * hidden))
            grads[f"{d}x"] = dx
        return loss / n, grads


def tags_of(size: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for kind, start, end in spans:
        out[start], out[start + 1 : end] = 1 + 2 * kind, 2 + 2 * kind
    return out


def spans_of(tags: np.ndarray) -> list[Span]:
    found, start = [], None
    for i, t in enumerate([*tags.tolist(), 0]):
        if start is not None and t != 2 + 2 * start[0]:
            found.append((start[0], start[1], i))
            start = None
        if t % 2:
            start = ((t - 1) // 2, i)
    return found


WINDOW, STRIDE, MARGIN = 96, 48, 36
#: A region is at most so long; a longer one is cut, with OVERLAP characters in both parts.
LONGEST, OVERLAP = 4096, 512
_TRIGGER = np.zeros(CHARS, bool)
_TRIGGER[[*range(48, 58), 64]] = True
#: What stands for an @ in addresses that are spelled out.
SPELLED_AT = re.compile(r"[(\[{<]\s?at\s?[)\]}>]", re.ASCII | re.IGNORECASE)


def regions(x: np.ndarray, spelled: list[int] = []) -> list[tuple[int, int, int, int]]:  # noqa: B006
    """(start, end, from, to): where spans may be, and from where to where those that begin there belong to this region.

    Spans lie within MARGIN characters of a digit, an @ or a spelled one, which every kind has. Neighbouring regions
    that were one too long overlap, but each character belongs to one of them.
    """
    at = np.flatnonzero(_TRIGGER[x])
    if spelled:
        at = np.unique(np.concatenate((at, np.array(spelled))))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * MARGIN)
    first, last = np.concatenate(([at[0]], at[cut + 1])), np.concatenate((at[cut], [at[-1]]))
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        lo, hi = max(0, a - MARGIN), min(len(x), b + MARGIN + 1)
        begins = list(range(lo, max(lo + 1, hi - OVERLAP), LONGEST - OVERLAP))
        for k, begin in enumerate(begins):
            end = min(hi, begin + LONGEST) if k + 1 < len(begins) else hi
            own = begin + (OVERLAP // 2 if k else 0)
            to = begins[k + 1] + OVERLAP // 2 if k + 1 < len(begins) else hi
            out.append((begin, end, own, to))
    return out


def spelled_ats(text: str) -> list[int]:
    return [m.start() for m in SPELLED_AT.finditer(text)]


def windows(size: int) -> list[int]:
    """Starts of the overlapping windows over a region."""
    return list(range(0, max(1, size - WINDOW + STRIDE), STRIDE))


def train(
    examples: list[tuple[str, list[Span]]], hidden: int = 20, rounds: int = 7, batch: int = 128, rate: float = 0.03, seed: int = 5
) -> Tagger:
    """A tagger from texts with labelled spans (kind as a number of KINDS, start, end), by Adam on windows of regions."""
    ids, gold = [], []
    for text, spans in examples:
        x, y = codes(text), tags_of(len(text), spans)
        for lo, hi, _, _ in regions(x, spelled_ats(text)):
            for at in windows(hi - lo)[::2]:  # side by side; overlaps would teach little more
                part = slice(lo + at, min(hi, lo + at + WINDOW))
                ids.append(np.pad(x[part], (0, WINDOW - (part.stop - part.start)), constant_values=PAD))
                gold.append(np.pad(y[part], (0, WINDOW - (part.stop - part.start))))
    all_ids, all_gold = np.array(ids).T, np.array(gold).T
    all_gold[0] = np.where((all_gold[0] % 2 == 0) & (all_gold[0] > 0), all_gold[0] - 1, all_gold[0])
    model, rng, step = Tagger.fresh(hidden, seed), np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    total = rounds * -(-all_ids.shape[1] // batch)
    for _ in range(rounds):
        order = rng.permutation(all_ids.shape[1])
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            _, grads = model.gradients(all_ids[:, some], all_gold[:, some])
            step += 1
            size = np.sqrt(sum((g * g).sum() for g in grads.values()))
            speed = rate * (1 - 0.9 * step / total)
            for k, g in grads.items():
                g = g * min(1, 5 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.w[k] -= speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def tagged(model: Tagger, texts: list[str], cells: int = 1 << 14) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, margin) of the spans of each whole text.

    Overlapping windows are scored on their own; where they overlap, their scores are averaged, each weighted by its
    distance from its window's ends, and one Viterbi pass decodes the whole region, so that no span depends on where a
    window ended. Texts may be of any length: regions are bounded, and of overlapping ones each decides for its own part.
    margin: how much better the span scores than being outside, for each character.
    """
    where, own = [], []
    for i, t in enumerate(texts):
        x = codes(t)
        for lo, hi, first, last in regions(x, spelled_ats(t)):
            where.append((i, lo, hi, x))
            own.append((first, last))
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    bell = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)[:, None]
    order = sorted(range(len(where)), key=lambda k: where[k][2] - where[k][1])
    while order:
        longest = where[order[0]][2] - where[order[0]][1]
        group, order = order[: max(1, cells // max(longest, WINDOW))], order[max(1, cells // max(longest, WINDOW)) :]
        starts = [(k, at) for k in group for at in windows(where[k][2] - where[k][1])]
        size = max(where[k][2] - where[k][1] for k in group)
        room = max(at for _, at in starts) + WINDOW
        scores, weight = np.zeros((max(size, room), len(group), TAGS)), np.zeros((max(size, room), len(group), 1))
        place = {k: j for j, k in enumerate(group)}
        for lo in range(0, len(starts), 256):
            some = starts[lo : lo + 256]
            ids = np.full((WINDOW, len(some)), PAD)
            for j, (k, at) in enumerate(some):
                _, a, b, x = where[k]
                part = x[a + at : min(b, a + at + WINDOW)]
                ids[: len(part), j] = part
            e = model.emissions(ids)
            for j, (k, at) in enumerate(some):
                scores[at : at + WINDOW, place[k]] += e[:, j] * bell
                weight[at : at + WINDOW, place[k]] += bell
        scores /= np.maximum(weight, 1e-9)
        steps = np.array([where[k][2] - where[k][1] for k in group])
        tags = model.best(scores[:size], steps)
        for j, k in enumerate(group):
            i, lo, _, _ = where[k]
            for kind, a, b in spans_of(tags[: steps[j], j]):
                if not own[k][0] <= lo + a < own[k][1]:
                    continue
                gain = scores[np.arange(a, b), j, tags[a:b, j]] - scores[a:b, j, 0]
                found[i].append((kind, lo + a, lo + b, float(gain.mean())))
    return found


#: What may stand before a value of each kind, and before numbers that are none.
_CUES = {
    "email": "mail to|write to|e-mail|contact|reach me at|courriel|schreib an|correo|from|cc",
    "ip": "host|server at|ip|from|address|ping|via|login from|gateway|adresse",
    "card": "card|card no|visa|paid with|charged to|karte|carte|tarjeta|cc number|mastercard",
    "phone": "call|tel|phone|tel.|mobile|fax|ring me on|appelez le|telefon|ruf|llame al|text|dial|cell",
    "none": "order|invoice|isbn|page|room|no.|ref|tracking|build|version|in|since|about|parcel|ticket|article|sku|serial|id",
}
_WORDS = (
    "the of and to in is that it was for on with as at be this have from or by one had not but what all were when we "
    "there can an your which their said if do will each about how up out them then she many some so these would other "
    "der die und das ist nicht mit für auf sich ein auch nach wie im von zu den des dem werden aus bei noch einen über "
    "le la les des un une est dans que pour pas sur au avec ce il sont mais comme plus par je été où très à être nous "
    "el los las por con para una su al lo más pero sus ya este sí porque esta entre cuando muy sin sobre también me"
).split()
_SYLLABLES = "an ter ou re che ist la mo pa ver zu qui des por ing tion äu é ñe ü ka lo th er nd st en in at ß ç ez".split()


def synthetic(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Invented texts, some with labelled personal data in usual and unusual forms and some with numbers that are none.

    Unusual forms are those that no base expression has: addresses spelled out, version 6 and defanged IP addresses, card
    numbers in other groups or with a mistyped digit, and telephone numbers without a plus sign.
    """
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    chance = lambda p: rng.random() < p
    some = lambda a, b: int(rng.integers(a, b))
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))

    def word() -> str:
        w = pick(_WORDS) if chance(0.5) else "".join(pick(_SYLLABLES) for _ in range(some(1, 4)))
        return w.capitalize() if chance(0.15) else w

    def plain() -> str:
        return ("".join(c for c in word() + word() if c.isascii() and c.isalpha()) or "ab").lower()

    def email() -> str:
        name = plain() + pick([".", "_", "", "-", ""]) + pick([plain(), digits(some(0, 4)), ""])
        name, host = name.strip("._-"), [*pick([[plain()], [plain() + digits(1)], ["mail", plain()]]), pick(["com", "org", "net", "de", "fr", "es", "example.com"])]
        if chance(0.45):
            return f"{name}@{'.'.join(host)}"
        at = pick([" (at) ", " [at] ", "(at)", "[at]", " {at} ", " @ ", " (AT) ", " [AT] "])
        dot = pick([".", ".", " dot ", " [dot] ", "[dot]", " (dot) ", " DOT "]) if at != " @ " else pick([".", " . "])
        return name + at + dot.join(host)

    def ip() -> str:
        if chance(0.4):
            return ".".join(str(x) for x in rng.integers(0, 256, 4))
        if chance(0.3):
            return pick(["[.]", "(.)", " . ", "[dot]"]).join(str(x) for x in rng.integers(0, 256, 4))
        groups = [hexes(some(1, 5)).lstrip("0") or "0" for _ in range(8)]
        if chance(0.7):
            a = some(1, 5)
            return ":".join(groups[:a]) + "::" + ":".join(groups[: some(1, 6 - a)])
        return ":".join(groups)

    def card() -> str:
        body = pick("45363") + digits(int(rng.choice([14, 14, 14, 14, 13, 12])))
        total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(body))))
        number = body + str((-total + (0 if chance(0.4) else some(1, 10))) % 10)
        if chance(0.3):
            number = digits(16)
        sep = pick(["", "", "", " ", "-", ".", "/", "  ", "_"])
        cuts = [0, 4, 10, 15] if len(number) == 15 else list(range(0, len(number) + 4, 4))
        return sep.join(filter(None, (number[a:b] for a, b in zip(cuts, cuts[1:], strict=False))))

    def phone() -> str:
        a, b, c = str(some(200, 990)), digits(3), digits(4)
        return pick([
            lambda: f"+1 ({a}) {b}-{c}", lambda: f"({a}) {b}-{c}", lambda: f"{a}-{b}-{c}", lambda: f"{a}.{b}.{c}", lambda: f"({a}){b}-{c}", lambda: f"1-{a}-{b}-{c}",
            lambda: f"+{some(20, 99)} {digits(3)} {digits(7)}", lambda: f"+1-{a}-{b}-{c}", lambda: f"0{digits(3)} {digits(3)} {digits(4)}", lambda: f"0{digits(3)}/{digits(7)}", lambda: f"0{digits(2)}-{digits(8)}",
            lambda: "0" + digits(1) + "".join(" " + digits(2) for _ in range(4)), lambda: f"020 {digits(4)} {digits(4)}", lambda: f"6{digits(2)} {digits(3)} {digits(3)}", lambda: f"00{some(20, 99)} {digits(3)} {digits(7)}",
            lambda: f"{a} {b} {c}", lambda: f"0{digits(4)} {digits(6)}", lambda: f"6{digits(2)} {digits(2)} {digits(2)} {digits(2)}",
        ])()

    def harmless() -> str:
        return pick([
            lambda: f"{some(1, 9)}.{some(0, 9)}", lambda: digits(some(1, 7)), lambda: digits(some(6, 11)), lambda: f"{some(1900, 2040)}-{some(10, 13)}-{some(10, 29)}", lambda: f"{some(10, 29)}.{some(10, 13)}.{some(1900, 2040)}",
            lambda: f"{some(1, 24)}:{digits(2)}", lambda: f"{some(10, 24)}:{digits(2)}:{digits(2)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: hexes(40), lambda: hexes(32),
            lambda: f'token = "{hexes(40)}"', lambda: f"password={hexes(18)}", lambda: "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"@{plain()}", lambda: f"{some(1, 20)}-{some(20, 60)}",
            lambda: f"§{some(1, 99)}", lambda: f"{digits(2)}%", lambda: f"({some(1, 30)})", lambda: f"{digits(3)},{digits(3)}", lambda: f"{some(1, 900)},{digits(3)},{digits(3)}", lambda: f"ISO {digits(4)}-{digits(1)}",
            lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: ":".join(hexes(2).upper() for _ in range(6)), lambda: f"{digits(4)}-{digits(2)}", lambda: f"{plain()}-{digits(5)}", lambda: f"{some(1990, 2030)}/{some(1990, 2030)}",
            lambda: f"{digits(2)}x{digits(2)}", lambda: f"{digits(3)}-{digits(4)}-{plain()[:2]}", lambda: f"{some(1, 99)}.{digits(3)},{digits(2)}", lambda: f"CC BY-NC {some(1, 5)}.0", lambda: f"version {some(1, 9)}.{some(0, 9)}.{some(0, 20)}",
        ])()

    makers = [("email", email), ("ip", ip), ("card", card), ("phone", phone)]
    out = []
    for _ in range(n):
        text, spans, style = "", [], pick(["", "", "", "", "", "", "!!", "mark", " |"])
        join = lambda: pick(["###", "$$$", "%%%", "&&&", "***", "!!"]) if style == "mark" else style  # noqa: E731, B023
        for _ in range(some(1, 4)):
            text += "".join(word() + join() + " " for _ in range(some(2, 9)))
            k = some(0, 4) if chance(0.62) else None
            if chance(0.4):
                cue = pick(_CUES[makers[k][0] if k is not None else "none"].split("|"))
                text += (cue.capitalize() if chance(0.3) else cue) + pick([" ", " ", ": ", ":", " = ", " no ", ' "'])
            elif chance(0.2):
                text = text.rstrip() + pick([". ", ", ", "\n", ": ", ' "', " - ", " ("])
            if k is not None:
                value = makers[k][1]()
                spans.append((k, len(text), len(text) + len(value)))
            else:
                value = harmless()
            text += value + join() + pick([" ", " ", " ", " ", ". ", ", ", "\n", '" ', ") ", "; "])
        text += " ".join(word() for _ in range(some(1, 4)))
        loud = "".join(c.upper() if len(c.upper()) == 1 else c for c in text)
        out.append((loud if style == "!!" else text, spans))
    return out


@lru_cache(4)
def trained(examples: int = 4500, seed: int = 11) -> Tagger:
    """The tagger from so many synthetic examples; once for each process."""
    return train(synthetic(examples, seed))
