"""Operator 9: personal data by fixed patterns plus a linear-chain conditional random field.

The base spans are leftmost non-overlapping matches of four patterns (email, ip, card, phone) with their tests.
The random field labels every white-space separated word of the whole text with its kind or none, from the
shapes of the word and of its neighbours (letters, digits and marks; runs of letters are collapsed). It is
trained here by maximum likelihood on the small labelled table of ``labelled_rows`` and decoded exactly by
Viterbi in numpy batches: words that no run of kinds on the best path can hold are found by sums first, the chain
falls apart there, and only the stretches between are decoded, many of equal length at a time.

Spans of the field are runs of words of one kind without outer punctuation, kept if they hold a plausible number
of digits (cards: passing Luhn, as other long numbers are no cards; emails: an at sign or its spelling) and touch
no base span; base spans always stay.

Cases: null and empty texts have no spans; offsets are code points, ends exclusive; very long texts take linear
time; repeated rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import chunks, doc_columns

#: Text decoded at once, and words remembered by a worker: both bound memory only.
_CHUNK, _MEMO = 2 << 20, 150_000
KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Runs of digits are taken whole (possessive, from their first digit), so no text takes more than linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns that pass their tests, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        past = 0
        for m in _AT.finditer(text):
            begin = m.start()
            while begin > past and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < m.start():
                out.append((begin, 0, m.end()))
                past = m.end()
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


_SHAPE = bytes(120 if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 100 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"x+|d{5,}|([^xd])\1+")


def _run(m: re.Match[bytes]) -> bytes:
    run = m[0]
    return run[:1] if run[:1] != b"d" else b"ddddd" if len(run) < 12 else b"D" if len(run) <= 19 else b"L"


def shape(word: str) -> str:
    """Letters become x, digits d, other marks stay, over the whole word; runs of letters and marks count once, of digits up to five."""
    return _RUNS.sub(_run, word.encode("utf-8", "surrogatepass").translate(_SHAPE)).decode("ascii")


_CUES = {w: k for k, line in enumerate((("at", "arobase", "(at)", "[at]"), ("dot", "(dot)", "[dot]", "punkt", "punto", "point"), ("call", "phone", "tel", "telephone", "fax", "mobile", "telefon", "téléphone", "teléfono", "dial"), ("card", "visa", "mastercard", "karte", "carte", "tarjeta"), ("mail", "email", "e-mail", "contact", "write"))) for w in line}


def feature(word: str) -> str:
    """The shape, or the cue that a word is."""
    cue = _CUES.get(word.strip(".,:;!?").lower()) if len(word) < 16 else None
    return shape(word) if cue is None else f"cue{cue}"


def labelled_rows(seed: int = 7, rows: int = 800) -> list[list[tuple[str, int]]]:
    """The labelled table: sentences of (word, label), made of plain words, numbers of all sorts and personal data."""
    rng = random.Random(seed)
    low = "abcdefghijklmnopqrstuvwxyz"
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def name() -> str:
        return "".join(rng.choice(low) for _ in range(rng.randint(2, 9)))

    def plain() -> str:
        w = name()
        w = w.capitalize() if rng.random() < 0.15 else w
        return w + (rng.choice([",", ".", ";", ":", "!", "?"]) if rng.random() < 0.15 else "")

    def number() -> list[str]:
        return rng.choice([
            [num(rng.randint(1, 4))], [num(4) + rng.choice(".,")], [num(2) + "." + num(2)], [num(1) + "," + num(3)], [num(rng.randint(5, 11))], [num(2) + "%"], ["$" + num(3)], ["(" + num(4) + ")"],
            [num(4) + "-" + num(2) + "-" + num(2)], [num(2) + ":" + num(2)], ["v" + num(1) + "." + num(1) + "." + num(1)], [name().upper() + num(3)], [name() + num(2) + name() + num(3)],
            [num(3) + "-" + num(3)], [num(1) + "."], [num(3), num(3)], [num(20) + num(12)], ['"' + num(3) + name() + num(2) + name() + '"'], [name() + "=" + num(2) + name()], [num(1) + "/" + num(2)], [name() + "_" + num(2)], ["§" + num(2)], [name() + "-" + name()], ["|"], ["-"], ["@" + name()], ["#" + num(3)], ["http://" + name() + "." + name()], ["{" + name() + "}"], [num(3) + "-" + num(2)], [num(2) + "-" + num(3)],
        ])

    def personal() -> tuple[list[str], int]:
        kind = rng.randint(1, 4)
        if kind == 1:
            host = rng.choice([[name() + "." + rng.choice(["com", "org", "net", "de"])]])
            form = rng.random()
            if form < 0.5:
                return [rng.choice([name(), name() + "." + name(), name() + "." + num(2), name() + num(3)]) + "@" + host[0]], 1
            at = rng.choice(["at", "(at)", "[at]"])
            if form < 0.75:
                return [name(), at, name(), rng.choice(["dot", "(dot)", "[dot]"]), rng.choice(["com", "org", "net"])], 1
            return [name() + num(2), rng.choice(["(at)", "[at]"]), host[0]], 1
        if kind == 2:
            return [".".join(num(rng.choice([1, 2, 2, 3])) for _ in range(4))], 2
        if kind == 3:
            return rng.choice([[num(16)], [num(4), num(4), num(4), num(4)], ["-".join(num(4) for _ in range(4))], [num(15)], [num(4), num(6), num(5)], [num(13)]]), 3
        return rng.choice([
            ["+" + num(1), "(" + num(3) + ")", num(3) + "-" + num(4)], ["(" + num(3) + ")", num(3) + "-" + num(4)], [num(3) + "-" + num(3) + "-" + num(4)], ["+" + num(2), num(3), num(7)], ["+" + num(2) + num(9)], ["+" + num(2), num(2), num(2), num(2), num(2), num(2)], [num(3) + "." + num(3) + "." + num(4)], ["+" + num(1) + "-" + num(3) + "-" + num(3) + "-" + num(4)],
        ]), 4

    table = []
    for _ in range(rows):
        row: list[tuple[str, int]] = []
        for _ in range(rng.randint(2, 5)):
            row += [(plain(), 0) for _ in range(rng.randint(1, 5))]
            pick = rng.random()
            if pick < 0.4:
                row += [(w, 0) for w in number()]
            elif pick < 0.9:
                ws, y = personal()
                if rng.random() < 0.3:
                    row.append((rng.choice({1: ["mail", "contact:"], 2: ["from"], 3: ["card", "visa"], 4: ["call", "phone:", "tel"]}[y]), 0))
                if rng.random() < 0.2:
                    ws = [*ws[:-1], ws[-1] + rng.choice(".,;")]
                row += [(w, y) for w in ws]
        row += [(plain(), 0) for _ in range(rng.randint(0, 3))]
        table.append(row)
    for cue in _CUES:  # cue words in plain use
        table += [[(plain(), 0), (cue, 0), (plain(), 0), (plain(), 0)] for _ in range(12)]
    return table


class _Codes(dict[str, int]):
    """Words to feature numbers; each distinct word is worked out once while it is remembered."""

    def __init__(self, features: dict[str, int]):
        super().__init__()
        self.features = features

    def __missing__(self, word: str) -> int:
        k = self.features.get(feature(word), Field.UNKNOWN)
        if len(word) <= 40:
            self[word] = k
        return k

    def __reduce__(self) -> tuple:
        return _Codes, (self.features,)


@dataclass
class Field:
    """Weights of the chain: one row of label weights per feature, for the word, the one before and the one after."""

    features: dict[str, int]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    move: np.ndarray
    memo: dict[str, int] = field(init=False, repr=False)

    UNKNOWN, EDGE = 0, 1

    def __post_init__(self) -> None:
        self.memo = _Codes(self.features)

    def code(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        return np.fromiter(map(memo.__getitem__, words), np.int32, len(words))

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        edged = np.concatenate([[self.EDGE], codes, [self.EDGE]])
        return self.own[codes] + self.before[edged[:-2]] + self.after[edged[2:]]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best labelling of one chain."""
        return self.decode_all([codes])[0]

    def possible(self, e: np.ndarray) -> np.ndarray:
        """Words that may have a kind on the best path, given emissions with a bar of minus infinity between chains.

        A run of kinds on the best path beats leaving its words unlabelled. What it can gain is at most the sum over
        its words of the lead of the best kind plus the best move into a kind, and the best move out of one; words
        that lie in no run with a gain, by sums over the best run to either side, are unlabelled for certain.
        """
        m = self.move
        gain = (e[:, 1:].max(1) - e[:, 0]).astype(np.float64) + float(m[:, 1:].max() - m[0, 0])
        total = np.cumsum(gain)
        ahead = total - gain
        upto = total - np.minimum.accumulate(ahead)
        onward = np.maximum.accumulate(total[::-1])[::-1] - ahead
        return upto + onward - gain + float(max(m[:, 0].max() - m[0, 0], 0.0)) + 1e-6 >= 0

    def decode_all(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([len(c) for c in chains], np.int64)
        bar = np.array([self.EDGE], np.int32)
        codes = np.concatenate([bar, *(x for c in chains for x in (c, bar))])
        out = np.zeros(len(codes), np.int8)
        starts = np.cumsum(sizes + 1) - sizes
        inner = codes != self.EDGE
        e = self.own[codes]
        e[1:] += self.before[codes[:-1]]
        e[:-1] += self.after[codes[1:]]
        e[~inner] = (1e4, 0, 0, 0, 0)
        idx = np.flatnonzero(self.possible(e) & inner)
        if len(idx):
            cut = np.flatnonzero(np.diff(idx) > 1) + 1
            first, last = idx[np.concatenate([[0], cut])], idx[np.concatenate([cut - 1, [len(idx) - 1]])]
            length = last - first + 1
            head, tail = ~inner[first - 1], ~inner[last + 1]  # the chain begins or ends here: no label beyond
            for n in np.unique(length):
                which = np.flatnonzero(length == n)
                at = first[which][:, None] + np.arange(n)
                out[at] = self._viterbi(e[at], head[which], tail[which])
        return [out[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist())]

    def _viterbi(self, e: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Labels of equally long stretches e[stretch, word, label] whose outer neighbours, if any, are ``none``."""
        b, n, labels = e.shape
        score = e[:, 0] + np.where(head[:, None], 0, self.move[0])
        back = np.zeros((b, n, labels), np.int8)
        for t in range(1, n):
            through = score[:, :, None] + self.move
            back[:, t] = through.argmax(1)
            score = through.max(1) + e[:, t]
        y = np.zeros((b, n), np.int8)
        y[:, -1] = (score + np.where(tail[:, None], 0, self.move[:, 0])).argmax(1)
        for t in range(n - 1, 0, -1):
            y[:, t - 1] = back[np.arange(b), t, y[:, t]]
        return y


def fit(table: list[list[tuple[str, int]]], l2: float = 3e-4, steps: int = 150, rate: float = 0.2) -> Field:
    """Maximum likelihood by Adam on the exact gradient (forward-backward over all rows at once)."""
    from collections import Counter

    seen = Counter(feature(w) for row in table for w, _ in row)
    features = {"": Field.UNKNOWN, "\n": Field.EDGE} | {f: k + 2 for k, f in enumerate(sorted(f for f, n in seen.items() if n > 2))}
    n, width, k = len(table), max(map(len, table)), len(LABELS)
    codes = np.full((n, width + 2), Field.EDGE)
    gold = np.zeros((n, width), np.int64)
    mask = np.zeros((n, width), bool)
    for i, row in enumerate(table):
        codes[i, 1 : len(row) + 1] = [features.get(feature(w), Field.UNKNOWN) for w, _ in row]
        gold[i, : len(row)] = [y for _, y in row]
        mask[i, : len(row)] = True
    own, before, after = codes[:, 1:-1], codes[:, :-2], codes[:, 2:]
    params = [np.zeros((len(features), k)) for _ in range(3)] + [np.zeros((k, k))]
    params[0][:, 0] = 0.1
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    onehot = np.eye(k)[gold] * mask[:, :, None]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    rows = np.arange(n)
    ends = mask.sum(1) - 1
    for step in range(1, steps + 1):
        w0, wb, wa, move = params
        e = w0[own] + wb[before] + wa[after]
        alpha, beta, grow = np.zeros_like(e), np.zeros_like(e), np.exp(move)
        alpha[:, 0] = e[:, 0]
        for t in range(1, width):
            top = alpha[:, t - 1].max(1, keepdims=True)
            alpha[:, t] = np.log(np.exp(alpha[:, t - 1] - top) @ grow) + top + e[:, t]
        z = np.logaddexp.reduce(alpha[rows, ends], axis=1)
        for t in range(width - 2, -1, -1):
            nxt = beta[:, t + 1] + e[:, t + 1]
            top = nxt.max(1, keepdims=True)
            beta[:, t] = np.where((t < ends)[:, None], np.log(np.exp(nxt - top) @ grow.T) + top, 0)
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * mask[:, :, None]
        d = p - onehot
        grads = [np.zeros_like(w0) for _ in range(3)]
        for g, c in zip(grads, (own, before, after)):
            for y in range(k):
                g[:, y] = np.bincount(c[mask], d[mask][:, y], len(g))
        expect = np.zeros((k, k))
        for t in range(width - 1):
            on = mask[:, t + 1]
            if on.any():
                x = alpha[on, t][:, :, None] + move + (e[on, t + 1] + beta[on, t + 1])[:, None, :] - z[on][:, None, None]
                expect += np.exp(np.minimum(x, 0)).sum(0)
        grads.append(expect - pairs)
        for i, g in enumerate(grads):
            g = g / n + l2 * params[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Field(features, *params)


@lru_cache(maxsize=1)
def default_field() -> Field:
    return fit(labelled_rows())


_OUTER = ".,;:!?\"'()[]{}<>|"


def _added(text: str, labels: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of labelled words of a text that touch no base span."""
    at = [m.span() for m in _WORD.finditer(text)]
    out: list[Span] = []
    k, n = 0, len(labels)
    hits = np.flatnonzero(labels)
    taken = base
    for k in hits.tolist():
        if k and labels[k - 1] == labels[k]:
            continue
        last = k
        while last + 1 < n and labels[last + 1] == labels[k]:
            last += 1
        a, b = at[k][0], at[last][1]
        while a < b and text[a] in _OUTER and not (text[a] == "(" and labels[k] == 4):
            a += 1
        while b > a and text[b - 1] in _OUTER:
            b -= 1
        kind, span = int(labels[k]) - 1, text[a:b]
        digits = sum(c.isdigit() and c.isascii() for c in span)
        low = span.lower()
        fits = {0: "@" in span.strip("@") or re.search(r"\S[ (\[]+at[ )\]]+\S.*(\.|[ (\[]dot[ )\]])\S*[a-z]", low) is not None, 1: span.count(".") == 3 and 4 <= digits <= 12, 2: 12 <= digits <= 19 and luhn("".join(c for c in span if c.isdigit() and c.isascii())), 3: 7 <= digits <= 15}[kind]
        if fits and a < b and not any(s < b and a < e for s, _, e in taken):
            out.append((a, kind, b))
    return out


def all_spans(texts: list[str], model: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text."""
    chains = [model.code(t.split()) if t else np.zeros(0, np.int32) for t in texts]
    out = []
    for t, y in zip(texts, model.decode_all(chains)):
        base = base_spans(t)
        out.append((base, _added(t, y, base) if y.any() else []))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of whole texts."""
    model = model or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=_CHUNK):
            found = all_spans([t or "" for t in batch.column(1).to_pylist()], model)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)],
                    pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([written(base + more) for base, more in found], pa.string()),
                    pa.array([len(more) for _, more in found], pa.int64()),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    return doc_columns(docs).mapInArrow(run, RESULT)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    parts, past = [], 0
    for a, k, b in sorted(spans):
        if a >= past:
            parts += (text[past:a], f"<{KINDS[k].upper()}>")
        past = max(past, b)
    return "".join(parts) + text[past:]


def redact_column(text: str = "text", model: Field | None = None) -> Column:
    """The text column without its personal data; null stays null."""
    model = model or default_field()

    @F.arrow_udf("string")
    def redact(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for batch in chunks([pa.RecordBatch.from_arrays([texts.cast(pa.string())], names=["text"])], most=_CHUNK):
            rows = batch.column(0).to_pylist()
            found = all_spans([t or "" for t in rows], model)
            out += [None if t is None else redacted(t, base + more) if base or more else t for t, (base, more) in zip(rows, found)]
        return pa.array(out, pa.string())

    return redact(F.col(text).cast("string"))
