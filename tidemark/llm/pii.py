"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss.

The patterns find emails, IPv4 addresses, card and phone numbers of their exact forms. Values that touch each other, or
that are written another way, escape them; the tagger finds these. It reads windows of text around digits, @ signs and
spelled-out at signs; the windows overlap. Each character's scores are averaged over its windows, weighted by the distance to
the window's edge, and the best sequence of tags is then decoded over the whole stretch, so that windows cannot disagree.

The tagger is trained in numpy from labelled spans: windows of the corpus with the spans that the patterns find there, and
windows in which such values are put, alone or side by side, in their own and in other common forms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_slices, texts_as_bytes

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What a stretch of text must hold to be read by the tagger.
_TRIGGER = re.compile(r"[0-9@]|[\[({] ?(?:at|dot) ?[\])}]", re.IGNORECASE)

WINDOW, STRIDE, REACH = 96, 48, 32
_TAGS = 1 + 2 * len(KINDS)  # outside; then begin and inside of each kind
_CHARS = 132  # padding, ASCII, letters beyond, others beyond

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _fits(kind: int, value: str) -> bool:
    """The exact part of a kind's definition: counts of digits, sizes of parts, check digits."""
    digits = _digits(value)
    if KINDS[kind] == "ip":
        return all(len(p) < 4 and int(p) <= 255 or p.lstrip("0") == "" or len(p.lstrip("0")) < 4 and int(p.lstrip("0")) <= 255 for p in value.split("."))
    if KINDS[kind] == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return KINDS[kind] == "email" or 10 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping in each kind, by start and then kind.

    Each pattern is searched in time that grows with the text's length only: an email from its @ sign back, an address
    from the start of a run of digits.
    """
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if _fits(kind, m[0])]
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def codes(text: str) -> np.ndarray:
    """Character classes: ASCII by itself, letters and other characters beyond it as one class each; 0 is for padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = (points + 1).astype(np.int32)
    beyond = points > 127
    if beyond.any():
        out[beyond] = [129 + (not chr(p).isalpha()) for p in points[beyond]]
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that lie within ``REACH`` characters of a trigger; they do not overlap."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        low, high = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


# ---- the tagger


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _follows() -> np.ndarray:
    """0 where one tag may follow another, and a large negative number where not: inside follows its own kind only."""
    ok = np.zeros((_TAGS, _TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = -1e4
        ok[[inside - 1, inside], inside] = 0
    return ok


@dataclass
class Tagger:
    """A bidirectional LSTM over characters whose outputs score tags, and transitions between tags."""

    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, size: int = 32, hidden: int = 32, seed: int = 7) -> Tagger:
        r = np.random.default_rng(seed)
        part = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        weights = {"chars": 0.3 * r.standard_normal((_CHARS, size)).astype(np.float32), "out": part(2 * hidden, _TAGS), "out_b": np.zeros(_TAGS, np.float32), "next": np.zeros((_TAGS, _TAGS), np.float32)}
        for way in "fb":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1  # keeps what it holds, at first
            weights |= {f"{way}_x": part(size, 4 * hidden), f"{way}_h": part(hidden, 4 * hidden), f"{way}_b": bias}
        return cls(weights)

    def _read(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states over time of inputs (batch, time, size)."""
        w_h = self.weights[f"{way}_h"]
        hidden, (rows, steps) = w_h.shape[0], x.shape[:2]
        pre = x @ self.weights[f"{way}_x"] + self.weights[f"{way}_b"]
        h = c = np.zeros((rows, hidden), np.float32)
        out = np.empty((rows, steps, hidden), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ w_h
            gates = _sigmoid(z[:, : 3 * hidden])
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            g = np.tanh(z[:, 3 * hidden :])
            before = (h, c)
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep is not None:
                keep.append((t, *before, i, f, o, g, tc))
        return out

    def _back(self, x: np.ndarray, way: str, kept: list, d_out: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        w_h = self.weights[f"{way}_h"]
        d_pre = np.empty((*x.shape[:2], w_h.shape[1]), np.float32)
        d_h = d_c = np.zeros((x.shape[0], w_h.shape[0]), np.float32)
        for t, h0, c0, i, f, o, g, tc in reversed(kept):
            d_h = d_h + d_out[:, t]
            d_c = d_c + d_h * o * (1 - tc * tc)
            d_z = np.concatenate((d_c * g * i * (1 - i), d_c * c0 * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)), 1)
            grads[f"{way}_h"] += h0.T @ d_z
            d_pre[:, t] = d_z
            d_h, d_c = d_z @ w_h.T, d_c * f
        flat = d_pre.reshape(-1, d_pre.shape[2])
        grads[f"{way}_x"] += x.reshape(-1, x.shape[2]).T @ flat
        grads[f"{way}_b"] += flat.sum(0)
        return d_pre @ self.weights[f"{way}_x"].T

    def scores(self, chars: np.ndarray) -> np.ndarray:
        """Tag scores (batch, time, tags) of windows of character classes."""
        x = self.weights["chars"][chars]
        return np.concatenate([self._read(x, way) for way in "fb"], 2) @ self.weights["out"] + self.weights["out_b"]

    def loss(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences under the CRF, and its gradients."""
        w, kept = self.weights, ([], [])
        x = w["chars"][chars]
        states = np.concatenate([self._read(x, way, keep) for way, keep in zip("fb", kept, strict=True)], 2)
        emit = (states @ w["out"] + w["out_b"]).astype(np.float64)
        rows, steps, _ = emit.shape
        move = (w["next"] + _follows()).astype(np.float64)
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0]
        for t in range(1, steps):
            alpha[:, t] = emit[:, t] + _log_sum(alpha[:, t - 1, :, None] + move, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _log_sum(move + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = _log_sum(alpha[:, -1], 1)
        row, at = np.arange(rows)[:, None], np.arange(steps)
        true = emit[row, at, tags].sum(1) + move[tags[:, :-1], tags[:, 1:]].sum(1)
        d_emit = np.exp(alpha + beta - total[:, None, None])
        d_emit[row, at, tags] -= 1
        d_next = np.zeros_like(move)
        for t in range(1, steps):
            d_next += np.exp(alpha[:, t - 1, :, None] + move + (emit[:, t] + beta[:, t])[:, None, :] - total[:, None, None]).sum(0)
        np.subtract.at(d_next, (tags[:, :-1], tags[:, 1:]), 1)
        d_emit = (d_emit / rows).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["next"] += (d_next / rows).astype(np.float32)
        flat = d_emit.reshape(-1, _TAGS)
        grads["out"] += states.reshape(-1, states.shape[2]).T @ flat
        grads["out_b"] += flat.sum(0)
        d_states = d_emit @ w["out"].T
        half = d_states.shape[2] // 2
        d_x = self._back(x, "f", kept[0], d_states[:, :, :half], grads) + self._back(x, "b", kept[1], d_states[:, :, half:], grads)
        np.add.at(grads["chars"], chars, d_x)
        return float((total - true).mean()), grads

    def fit(self, chars: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> list[float]:
        """Adam over shuffled batches with a falling rate; the mean loss of each epoch."""
        r, first, second, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        steps = epochs * -(-len(chars) // batch)
        for _ in range(epochs):
            order, seen = r.permutation(len(chars)), 0.0
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                loss, grads = self.loss(chars[own], tags[own])
                seen, step = seen + loss * len(own), step + 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                    size = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.weights[k] = (self.weights[k] - size * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
            losses.append(seen / max(len(order), 1))
        return losses

    def decode(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        """Best tags of each stretch of character classes, of any length.

        Windows overlap by half. A character's scores are averaged over its windows with a weight that falls to the edges;
        the best sequence is searched over the whole stretch.
        """
        windows, places = [], []
        for k, piece in enumerate(pieces):
            for at in range(0, max(len(piece) - STRIDE, 1), STRIDE):
                window = np.zeros(WINDOW, np.int32)
                window[: len(piece[at : at + WINDOW])] = piece[at : at + WINDOW]
                windows.append(window)
                places.append((k, at))
        weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
        sums = [np.zeros((len(p), _TAGS), np.float32) for p in pieces]
        shares = [np.zeros((len(p), 1), np.float32) for p in pieces]
        for low in range(0, len(windows), 512):
            for (k, at), scored in zip(places[low : low + 512], self.scores(np.array(windows[low : low + 512])), strict=True):
                n = min(WINDOW, len(pieces[k]) - at)
                sums[k][at : at + n] += scored[:n] * weight[:n]
                shares[k][at : at + n] += weight[:n]
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        for low in range(0, len(order), 256):
            own = order[low : low + 256]
            for k, best in zip(own, self._best([sums[k] / shares[k] for k in own]), strict=True):
                out[k] = best
        return out

    def _best(self, emits: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over several stretches at once; beyond a stretch's end only the outside tag is free."""
        longest = max(map(len, emits), default=0)
        if longest == 0:
            return [np.zeros(0, np.int8) for _ in emits]
        emit = np.full((len(emits), longest, _TAGS), -1e4, np.float32)
        emit[:, :, 0] = 0
        for k, e in enumerate(emits):
            emit[k, : len(e)] = e
        move = self.weights["next"] + _follows()
        move_in, ends = emit[:, 0] + _follows()[0], np.zeros((longest, len(emits), _TAGS), np.int8)
        for t in range(1, longest):
            ways = move_in[:, :, None] + move
            ends[t] = ways.argmax(1)
            move_in = ways.max(1) + emit[:, t]
        tags = np.empty((len(emits), longest), np.int8)
        tags[:, -1] = move_in.argmax(1)
        for t in range(longest - 1, 0, -1):
            tags[:, t - 1] = ends[t][np.arange(len(emits)), tags[:, t]]
        return [tags[k, : len(e)] for k, e in enumerate(emits)]


# ---- labelled windows


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for start, kind, end in spans:
        tags[start:end] = 2 + 2 * kind
        tags[start] = 1 + 2 * kind
    return tags


def spans_of(tags: np.ndarray) -> list[Span]:
    """The spans of a tag sequence: from each begin tag over the inside tags that follow it."""
    out: list[Span] = []
    for at in np.flatnonzero(tags % 2 == 1).tolist():
        kind, end = int(tags[at]) // 2, at + 1
        while end < len(tags) and tags[end] == tags[at] + 1:
            end += 1
        out.append((at, kind, end))
    return out


def _with_check_digit(digits: str) -> str:
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def _value(kind: int, r: np.random.Generator, known: list[str]) -> str:
    """A value of a kind: one of the corpus with its digits changed, or another common form."""
    some = lambda n: "".join(map(str, r.integers(0, 10, n)))
    pick = lambda *x: x[int(r.integers(len(x)))]
    name = "".join(pick(*"abcdefghijklmnopqrstuvwxyz") for _ in range(int(r.integers(2, 9))))
    if known and r.random() < 0.5:
        value = "".join(some(1) if c.isdigit() else c for c in pick(*known))
        if kind == 1:
            return ".".join(str(int(r.integers(1, 256))) for _ in range(4))
        if kind == 2:
            digits = _with_check_digit(_digits(value)[:-1])
            return "".join(digits[sum(c.isdigit() for c in value[:k])] if c.isdigit() else c for k, c in enumerate(value))
        return value
    if kind == 0:
        host = f"{name[::-1]}{pick('', some(1))}{pick('.', '.mail.', '-net.')}{pick('com', 'org', 'net', 'de', 'fr', 'es', 'io')}"
        local = f"{name}{pick('', '.', '_', '+')}{pick('', some(2), name[:3])}" if r.random() < 0.8 else f"{name}.{name[:4]}"
        at, dot = pick(("@", "."), ("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" @ ", "."))
        return local.rstrip(".+_") + at + host.replace(".", dot)
    if kind == 1:
        return pick(".", ".", "[.]", " . ").join(str(int(r.integers(1, 256))) for _ in range(4))
    if kind == 2:
        digits = _with_check_digit(pick("4", "51", "37", "6011") + some(12))[:19]
        digits = _with_check_digit(digits[:15])
        gap = pick("", " ", "-", ".", "/")
        return gap.join(digits[k : k + 4] for k in range(0, 16, 4))
    a, b, c = some(3), some(3), some(4)
    return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"+{some(2)} {a} {b} {c}", f"00{some(2)} {a} {b}{c}", f"+1 {a}.{b}.{c}", f"tel:+1{a}{b}{c}"[4:])


def _plain(r: np.random.Generator) -> str:
    """A number or name that is no personal data."""
    some = lambda n: "".join(map(str, r.integers(0, 10, n)))
    pick = lambda *x: x[int(r.integers(len(x)))]
    hexes = "".join(pick(*"0123456789abcdef") for _ in range(int(r.integers(12, 42))))
    return pick(f"version {some(1)}.{some(1)}.", f"{some(1)}.{some(1)}.{some(2)}", f"20{some(2)}-0{some(1)}-1{some(1)}", some(int(r.integers(1, 8))), f"{some(2)},{some(3)}.{some(2)}", f"password={hexes[:18]}", f'token = "{hexes}"', f"id {some(5)}-{some(2)}", f"page {some(3)} of {some(3)}", f"{some(2)}:{some(2)}:{some(2)}", f"@{pick('home', 'news', 'team')}", f"{some(2)}%")


def training_windows(rows: list[tuple[str, list[Span]]], made: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes and tags: ``rows`` (text of at most ``WINDOW`` characters, spans) as they are, and
    ``made`` more, in which values stand alone or side by side between stretches of those texts that hold no value."""
    r, texts = np.random.default_rng(seed), list(rows)
    known = [[t[a:b] for t, spans in rows for a, k, b in spans if k == kind] for kind in range(len(KINDS))]
    calm = [w for t, spans in rows for w in (t[: spans[0][0]] if spans else t).split(" ") if w and not _TRIGGER.search(w)] or ["and", "the", "of"]
    fill = lambda: " ".join(calm[int(k)] for k in r.integers(0, len(calm), int(r.integers(0, 6))))
    for _ in range(made):
        text, spans = fill()[-40:], []
        for _ in range(int(r.integers(1, 4))):
            text += ("", " ", " ", " ", " ", " ", " ", ", ", ". ", "\n", ": ", " (", '"')[int(r.integers(13))] if text else ""
            if r.random() < 0.3:
                text += _plain(r)
            else:
                kind = int(r.integers(len(KINDS)))
                if text and text[-1] in _LOCAL:
                    text += " "
                value = _value(kind, r, known[kind])
                spans.append((len(text), kind, len(text) + len(value)))
                text += value
        text += ("", " ", " ", ". ", ", ", "\n", ")")[int(r.integers(7))] + fill()
        low = max(0, int(r.integers(-40, len(text) - WINDOW + 1))) if len(text) > WINDOW else 0
        spans = [(max(a - low, 0), k, min(b - low, WINDOW)) for a, k, b in spans if b - low > 0 and a - low < WINDOW and a >= low]
        texts.append((text[low : low + WINDOW], spans))
    chars, tags = np.zeros((len(texts), WINDOW), np.int32), np.zeros((len(texts), WINDOW), np.int64)
    for k, (text, spans) in enumerate(texts):
        shift = int(r.integers(0, WINDOW - len(text) + 1)) if r.random() < 0.3 else 0
        chars[k, shift : shift + len(text)] = codes(text)
        tags[k] = tags_of(WINDOW, [(a + shift, kind, b + shift) for a, kind, b in spans])
    return chars, tags


def labelled_windows(docs: DataFrame, most: int) -> DataFrame:
    """(text, spans) of at most ``most`` windows around triggers, chosen by a hash of the window, over all of ``docs``.

    Windows with digits that a pattern takes but whose count or check fails are left out: they may hold values that touch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts, spans = [], []
            for whole in texts_as_bytes(batch):
                text = whole.decode()
                for low, high in stretches(text):
                    part = text[low : min(high, low + WINDOW)]
                    own = base_spans(part)
                    taken = [m for kind, p in ((1, _IP), (2, _CARD), (3, _PHONE)) for m in p.finditer(part) if len(_digits(m[0])) > 11 and not _fits(kind, m[0])]
                    if not taken and not any(a < d and c < b for k, (a, _, b) in enumerate(own) for c, _, d in own[k + 1 :]) and not any(b == len(part) and high > low + WINDOW for _, _, b in own):
                        texts.append(part)
                        spans.append([[a, k, b] for a, k, b in own])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=["text", "spans"])

    found = docs.select("text").where(F.col("text").rlike(r"[0-9@]|(?i)[\[({] ?(at|dot) ?[\])}]")).mapInArrow(run, "text string, spans array<array<int>>")
    return found.distinct().orderBy(F.xxhash64("text"), "text").limit(most)


def train(docs: DataFrame, sample_windows: int = 1500, made_windows: int = 4500, epochs: int = 5) -> Tagger:
    """A tagger from the labelled windows of ``docs``, at most ``sample_windows`` of them, and ``made_windows`` made from them.

    The windows are chosen over all rows; the training itself, bounded by these numbers, is one task.
    """
    rows = [(r.text, [tuple(s) for s in r.spans]) for r in labelled_windows(docs, sample_windows).collect()]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            tagger = Tagger.new()
            tagger.fit(*training_windows(rows, made_windows), epochs)
            names, weights = zip(*tagger.weights.items(), strict=True)
            columns = [pa.array(names), pa.array([w.shape for w in weights], pa.list_(pa.int32())), pa.array([w.tobytes() for w in weights], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "shape", "weights"])

    learnt = docs.sparkSession.range(1, numPartitions=1).mapInArrow(fit, "name string, shape array<int>, weights binary").collect()
    return Tagger({r.name: np.frombuffer(r.weights, np.float32).reshape(r.shape) for r in learnt})


# ---- finding


def added_spans(texts: list[str], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """The tagger's spans of each text that touch none of the text's ``base`` spans and meet their kind's exact part.

    The number after a wrong or missing mark may have any form; what counts is the digits: 14 to 19 that pass the
    check for a card, 10 to 15 for a phone, four parts of at most 255 for an address.
    """
    where = [(k, low, high) for k, text in enumerate(texts) for low, high in stretches(text)]
    out: list[list[Span]] = [[] for _ in texts]
    for (k, low, high), tags in zip(where, tagger.decode([codes(texts[k][low:high]) for k, low, high in where]), strict=True):
        for a, kind, b in spans_of(tags):
            value = texts[k][low + a : low + b]
            a, b = a + len(value) - len(value.lstrip(" \n\t,;:\"'")), b - len(value) + len(value.rstrip(" \n\t,;:.\"'(["))
            start, end = low + a, low + b
            if a < b and not any(start < d and c < end for c, _, d in base[k]) and _plausible(kind, texts[k], start, end):
                out[k].append((start, kind, end))
    return out


def _plausible(kind: int, text: str, start: int, end: int) -> bool:
    value = text[start:end]
    if any("0" <= c <= "9" and "0" <= d <= "9" for c, d in ((text[start - 1 : start], value[0]), (value[-1], text[end : end + 1])) if c and d):
        return False  # a part of a longer number
    if KINDS[kind] == "ip":
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and _fits(kind, ".".join(parts)) and len(value) <= 32
    if KINDS[kind] == "email":
        return bool(re.search(r"[A-Za-z0-9]\s?(?:@|[\[({] ?at ?[\])}])\s?[A-Za-z0-9]", value, re.IGNORECASE)) and bool(re.search(r"\.|[\[({] ?dot ?[\])}]", value, re.IGNORECASE)) and len(value) <= 254
    return _fits(kind, value) and not re.search(r"[^0-9 ()./+-]", value)


def find(docs: DataFrame, tagger: Tagger, *keep: str | Column) -> DataFrame:
    """``keep`` (doc_id by default), n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of every row of ``docs``.

    Spans are ``kind:start:end`` in code points, the end exclusive, by start and then kind; base_sha256 is of the patterns'
    spans, the counts are theirs too, spans has the tagger's besides and n_added says how many. Null counts as empty: no
    spans, and the hash of the empty text. Repeated rows give repeated rows; other columns play no part.
    """
    from hashlib import sha256

    kept = docs.select(*(keep or ("doc_id",)), "text")
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            texts = [t.decode() for t in texts_as_bytes(batch)]
            base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
            added = added_spans(texts, base, tagger)
            counts = [pa.array([sum(s[1] == k for s in own) for own in base], pa.int64()) for k in range(len(KINDS))]
            sha = pa.array([sha256(joined(own).encode()).hexdigest() for own in base], pa.string())
            spans = pa.array([joined(sorted(a + b)) for a, b in zip(base, added, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts, sha, spans, pa.array(list(map(len, added)), pa.int64())], names=[*names, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kinds = "".join(f"`{c}` {kept.schema[c].dataType.simpleString()}, " for c in names)
    return kept.mapInArrow(run, f"{kinds}{', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")
