"""Operator 11: personal data by a linear-chain conditional random field over word-shape features.

A text is cut into tokens. Every token is described by the shape of its characters (classes, their order and
number, length), by the bytes around it, by the words of a small cue vocabulary, and by the same of its neighbours. The
field's weights are trained on the driver from a small labelled table (``labelled()`` by default: about 2,000 sentences made by a rule from
the patterns that are written below): gradient ascent on the penalised log-likelihood, with forward and
backward sums over all sentences at once. Labels are the kinds of personal data and ``o``; a span is a run of one kind.

Decoding is Viterbi in numpy batches, and exact: a token for which ``o`` beats every other label under the best and
worst transitions on both sides is ``o`` on the best path, so that paths are searched between such tokens alone, all stretches of
like length at once. Long texts are decoded whole.

Besides, patterns that are fixed by their form (``base_spans``: email, ip, card, phone) are found without a model. They
always stay; spans of the field that overlap one of them are dropped, and spans of these four kinds that the field adds have to
pass the same checks (an @, parts of at most 255, Luhn, number of digits).

Cases: null and empty texts have no span; equal texts have equal spans; an empty table gives an empty one; a kept
column that has the name of a new one gives way to it; a model learnt from no labelled row finds base spans alone.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The kinds with patterns, in their order, then those that are found by the field alone.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "id", "name", "secret"]
LABELS = ["o", *KINDS]
#: Bytes of text whose tokens and scores are held at once (a longer text goes alone).
SLICE = common.CHUNK_BYTES // 4
#: Added to the score of ``o`` after training: real texts hold far less personal data than the labelled table.
MARGIN = 3.0
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"

_set = lambda s: common.byte_table(lambda b: chr(b) in s and b < 0x80)
DIGIT = common.byte_table(lambda b: 0x30 <= b <= 0x39)
ALPHA = common.byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
LOCAL, DOMAIN = ALPHA | DIGIT | _set("._%+-"), ALPHA | DIGIT | _set("-")
PHONE = DIGIT | _set(" ().-")
INNER = ALPHA | DIGIT | common.byte_table(lambda b: b >= 0x80)
TOKEN = common.NOT_SPACE & ~_set("\"'`=<>[]{}|,;")


def luhn(digits: bytes) -> bool:
    """Digits as ASCII bytes."""
    d = [b - 48 for b in digits[::-1]]
    return (sum(d[::2]) + sum((2 * x) % 10 + (2 * x) // 10 for x in d[1::2])) % 10 == 0


def _only_digits(raw: bytes) -> bytes:
    return bytes(b for b in raw if 48 <= b <= 57)


def _octets(raw: bytes) -> bool:
    parts = [p.lstrip(b"0") for p in raw.split(b".")]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts)


def _chains(starts: np.ndarray, ends: np.ndarray, text: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last run of every chain of runs; linked[i]: run i goes on in run i + 1."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = linked & (text[1:] == text[:-1]) & (starts[1:] == ends[:-1] + 1)
    return np.flatnonzero(np.r_[True, ~joined]), np.flatnonzero(np.r_[~joined, True])


def base_spans(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each kind of ``BASE`` the (start, end) bytes of its matches, in order: leftmost, not overlapping, checked."""
    none = np.zeros((0, 2), np.int64)
    if len(data) == 0:
        return [none] * 4
    padded = np.r_[data, np.zeros(2, np.uint8)]
    text_at = lambda p: np.searchsorted(offsets, p, side="right") - 1
    starts, ends, first = common.word_spans(data, offsets, DIGIT)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    digit_at = np.flatnonzero(DIGIT[data])

    # emails: everything hangs on an @, its run before and its labels behind
    emails, done = [], 0
    at = np.flatnonzero(data == 64)
    at = at[(at > 0) & (at + 1 < len(data))]
    if len(at):
        low, high = offsets[text_at(at)], offsets[text_at(at) + 1]
        fits = (at > low) & (at + 1 < high) & LOCAL[data[at - 1]] & DOMAIN[padded[at + 1]]
        at, low, high = at[fits], low[fits], high[fits]
        other = np.flatnonzero(~LOCAL[data])
        run = np.maximum(low, np.r_[-1, other][np.searchsorted(other, at)] + 1)
        other = np.flatnonzero(~(DOMAIN[data] | (data == 46)))
        stop = np.minimum(high, np.r_[other, len(data)][np.searchsorted(other, at + 1)])
        dots = np.flatnonzero(data == 46)
        last = np.isin(dots + 1, offsets) | ~DOMAIN[padded[dots + 1]]
        bad = dots[last]
        stop = np.minimum(stop, np.r_[bad, len(data)][np.searchsorted(bad, at + 1)])
        inside = np.searchsorted(dots, stop) - np.searchsorted(dots, at + 1)
        for a, s, e, n in zip(at.tolist(), run.tolist(), stop.tolist(), inside.tolist()):
            if n and max(s, done) < a:
                emails.append((max(s, done), e))
                done = e

    # addresses: chains of runs joined by dots, four by four
    ips = []
    a, b = _chains(starts, ends, text, padded[ends[:-1]] == 46)
    for i, j in zip(a[b - a >= 3].tolist(), b[b - a >= 3].tolist()):
        for k in range(i, j - 2, 4):
            if _octets(data[starts[k] : ends[k + 3]].tobytes()):
                ips.append((int(starts[k]), int(ends[k + 3])))

    # cards: chains of runs joined by a space or hyphen
    cards = []
    a, b = _chains(starts, ends, text, np.isin(padded[ends[:-1]], (0x20, 0x2D)))
    if len(a):
        many = np.r_[0, np.cumsum(ends - starts)]
        n = many[b + 1] - many[a]
        for i, j in zip(a[(n >= 13) & (n <= 19)].tolist(), b[(n >= 13) & (n <= 19)].tolist()):
            if luhn(_only_digits(data[starts[i] : ends[j]].tobytes())):
                cards.append((int(starts[i]), int(ends[j])))

    # phones: from a plus to the last digit of the run behind it
    plus = np.flatnonzero(data == 43)
    phones = none
    if len(plus):
        high = offsets[text_at(plus) + 1]
        fits = (plus + 1 < high) & DIGIT[padded[plus + 1]]
        plus, high = plus[fits], high[fits]
        other = np.flatnonzero(~PHONE[data])
        stop = np.minimum(high, np.r_[other, len(data)][np.searchsorted(other, plus + 1)])
        j, i = np.searchsorted(digit_at, stop) - 1, np.searchsorted(digit_at, plus)
        last, n = digit_at[j] if len(digit_at) else j, j - i + 1
        fits = (last >= plus + 3) & (n >= 9) & (n <= 15)
        phones = np.stack([plus[fits], last[fits] + 1], axis=1)
    as_array = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return [as_array(emails), as_array(ips), as_array(cards), phones.astype(np.int64)]


# ---------------------------------------------------------------- features

#: Classes of bytes as bits: lower, upper, digit, beyond ASCII, and marks.
_BITS = np.zeros(256, np.uint16)
for _b in range(256):
    _c = chr(_b)
    _BITS[_b] = 1 if 0x61 <= _b <= 0x7A else 2 if 0x41 <= _b <= 0x5A else 4 if 0x30 <= _b <= 0x39 else 8 if _b >= 0x80 else {"@": 16, ".": 32, "-": 64, "_": 128, ":": 256, "/": 256}.get(_c, 512)
_KIND = np.array([int(b).bit_length() for b in _BITS], np.uint8)
_LENGTH = np.array([min(n, 6) if n < 7 else 6 + min(int(np.log2(n / 6) * 2) + 1, 9) for n in range(1, 257)], np.int64)
_CHANGE = np.array([0, 1, 2, 3, 4, 4, 5, 5, 5, 5, *[6] * 10, 7], np.int64)

#: Features of a token that are small whole numbers, then those that are looked up in a dictionary.
DENSE = ["class", "class_length", "class_changes", "digits", "before", "after", "gap", "class_before", "class_after", "class_turn", "sum_ok"]
LOOKED_UP = ["shape", "word", "word_before", "word_after", "word_before_2"]


class Tokens:
    """Tokens of a slice of texts: place of the core, text, features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, self.first = common.word_spans(data, offsets, TOKEN)
        self.text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        inner = np.flatnonzero(INNER[data])
        if len(inner) and len(starts):
            s = np.r_[inner, len(data)][np.searchsorted(inner, starts)]
            e = inner[np.maximum(np.searchsorted(inner, ends) - 1, 0)] + 1
            some = s < ends
            starts, ends = np.where(some, s, starts), np.where(some, e, ends)
        self.start, self.end = starts, ends
        n = len(starts)
        self.dense: dict[str, np.ndarray] = {}
        if not n:
            return
        bits, lens = _BITS[data], ends - starts
        edges = np.stack([starts, ends], axis=1).ravel()
        kind = np.bitwise_or.reduceat(np.r_[bits, np.uint16(0)], edges)[::2].astype(np.int64)
        classes = _KIND[data]
        change = np.r_[True, classes[1:] != classes[:-1]]
        change[starts] = True
        seen = np.r_[0, np.cumsum(change)]
        changes = seen[ends] - seen[starts] - 1
        digits = np.r_[0, np.cumsum(bits == 4)]
        digits = digits[ends] - digits[starts]
        edge = np.zeros(len(data), bool)
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True
        before = np.where(edge[starts], 0, data[np.maximum(starts - 1, 0)])
        after = np.where(np.isin(ends, offsets), 0, data[np.minimum(ends, len(data) - 1)])
        same = np.r_[False, self.text[1:] == self.text[:-1]]
        behind = np.r_[0, ends[:-1]]
        gap = np.zeros(n, np.int64)
        for i, byte in enumerate((61, 58, 10)):
            many = np.r_[0, np.cumsum(data == byte)]
            gap += (many[starts] > many[np.where(same, behind, starts)]).astype(np.int64) << i
        gap = np.where(same, gap, 8)
        marks = np.r_[0, np.cumsum((data == 46) | (data == 33) | (data == 63))]
        stop = same & (marks[starts] > marks[np.where(same, behind, starts)])  # a sentence may end in between
        odd = np.r_[0, np.cumsum((bits == 512) & common.NOT_SPACE[data] & ~np.isin(data, (44, 39, 34, 61)))]
        odd = same & (odd[starts] > odd[np.where(same, behind, starts)]) & ~stop
        plain = np.r_[False, (kind[:-1] & 2) == 0] & same  # what stands before has no capital
        turn = np.where(same, stop + 2 * (odd | ((gap & 4) > 0)) + 4 * plain, 3)
        ok = np.zeros(n, np.int64)
        for i in np.flatnonzero((digits >= 13) & (digits <= 19)):
            ok[i] = 1 + luhn(_only_digits(data[starts[i] : ends[i]].tobytes()))
        length = _LENGTH[np.minimum(lens, 256) - 1]
        pos = lambda x, k: np.where(same_at(k), np.roll(x, k), 1023)

        def same_at(k: int) -> np.ndarray:
            out = np.roll(self.text, k) == self.text
            if k > 0:
                out[:k] = False
            else:
                out[k:] = False
            return out

        self.dense = {
            "class": kind, "class_length": kind * 16 + length, "class_changes": kind * 8 + _CHANGE[np.minimum(changes, 20)], "digits": np.minimum(digits, 20),
            "before": before.astype(np.int64), "after": after.astype(np.int64), "gap": gap, "class_before": pos(kind, 1), "class_after": pos(kind, -1), "class_turn": kind * 8 + turn, "sum_ok": ok,
        }
        # the order of classes, runs as one letter
        kept = np.flatnonzero(change)
        self.shape = common.word_hashes(classes[kept], seen[starts], np.maximum(seen[ends], seen[starts] + 1), False)
        self.word = common.word_hashes(data, starts, ends, True)
        self.same_at, self.stop = same_at, stop
        self.left = np.roll(self.word, 1) ^ np.where(stop, np.uint64(0x9E3779B97F4A7C15), np.uint64(0))


_SIZE = {"class": 1024, "class_length": 1024 * 16, "class_changes": 1024 * 8, "digits": 21, "before": 256, "after": 256, "gap": 9, "class_before": 1024, "class_after": 1024, "class_turn": 1024 * 8, "sum_ok": 3}


class Field:
    """The conditional random field: weights of features for each label, and of pairs of labels."""

    def __init__(self, shapes: np.ndarray, words: np.ndarray, lefts: np.ndarray) -> None:
        k = len(LABELS)
        self.shapes, self.words, self.lefts = shapes, words, lefts
        self.dense = {f: np.zeros((_SIZE[f], k), np.float32) for f in DENSE}
        self.looked_up = {f: np.zeros((3 + len({"shape": shapes, "word_before": lefts}.get(f, words)), k), np.float32) for f in LOOKED_UP}
        self.pairs = np.zeros((k, k), np.float32)
        self.bias = np.zeros(k, np.float32)

    @staticmethod
    def _find(known: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Index of each value in the sorted known ones; their number if it is not there."""
        if not len(known):
            return np.zeros(len(values), np.int64)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return np.where(known[at] == values, at, len(known))

    def ids(self, t: Tokens) -> dict[str, np.ndarray]:
        word, none = self._find(self.words, t.word), len(self.words)
        moved = lambda k: np.where(t.same_at(k), np.roll(word, k), none)
        left, unknown = self._find(self.lefts, t.left), len(self.lefts)  # then: unknown, unknown and a sentence may end, none
        left = np.where(t.same_at(1), np.where((left == unknown) & t.stop, unknown + 1, left), unknown + 2)
        return t.dense | {"shape": self._find(self.shapes, t.shape), "word": word, "word_before": left, "word_after": moved(-1), "word_before_2": moved(2)}

    def emissions(self, t: Tokens) -> np.ndarray:
        out = np.tile(self.bias, (len(t.start), 1))
        for f, at in self.ids(t).items():
            out += (self.dense.get(f) if f in self.dense else self.looked_up[f])[at]
        return out

    # ---- training

    def fit(self, t: Tokens, y: np.ndarray, rounds: int = 90, rate: float = 0.15, penalty: float = 0.02) -> None:
        """Gradient ascent (Adam) on the log-likelihood of all texts at once."""
        k, ids = len(LABELS), self.ids(t)
        params = {**self.dense, **self.looked_up, "pairs": self.pairs, "bias": self.bias}
        used = {f: np.unique(at) for f, at in ids.items()}
        index = {f: np.searchsorted(used[f], at) for f, at in ids.items()}
        small = {f: np.zeros((len(u), k)) for f, u in used.items()} | {"pairs": np.zeros((k, k)), "bias": np.zeros(k)}
        n = np.diff(t.first)
        n = n[n > 0]
        longest, rows = int(n.max()), np.repeat(np.arange(len(n)), n)
        cols = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        gold = np.eye(k)[y]
        before = np.where(cols == 0, 0, np.r_[0, y[:-1]])
        order = {f: np.argsort(at, kind="stable") for f, at in index.items()}
        bounds = {f: np.searchsorted(at[order[f]], np.arange(len(used[f]))) for f, at in index.items()}
        gold_pairs = np.zeros((k, k))
        np.add.at(gold_pairs, (before, y), 1)
        np.add.at(gold_pairs, (y[np.cumsum(n) - 1], np.zeros(len(n), np.int64)), 1)
        m, v = ({f: np.zeros_like(p) for f, p in small.items()} for _ in range(2))
        for step in range(1, rounds + 1):
            e = np.tile(small["bias"], (len(rows), 1))
            for f in ids:
                e += small[f][index[f]]
            node, pair = self._marginals(e, small["pairs"], rows, cols, len(n), longest, n)
            missing = gold - node
            grads = {"bias": missing.sum(axis=0), "pairs": gold_pairs - pair}
            for f in ids:
                grads[f] = np.add.reduceat(missing[order[f]], bounds[f])
            now = rate * (1 - step / (rounds + 1)) + 0.01
            for f, g in grads.items():
                g = g - penalty * small[f] * (f != "bias")
                m[f], v[f] = 0.9 * m[f] + 0.1 * g, 0.999 * v[f] + 0.001 * g * g
                small[f] += now * (m[f] / (1 - 0.9**step)) / (np.sqrt(v[f] / (1 - 0.999**step)) + 1e-8)
        for f, p in params.items():
            if f in used:
                p[used[f]] = small[f]
            else:
                p[:] = small[f]

    @staticmethod
    def _marginals(e: np.ndarray, pairs: np.ndarray, rows: np.ndarray, cols: np.ndarray, texts: int, longest: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected labels of every token, expected number of every pair of neighbours; before and behind a text is ``o``."""
        k = e.shape[1]
        grid = np.zeros((texts, longest + 1, k))
        grid[:, :, 0] = 1  # behind a text
        grid[rows, cols] = np.exp(e - e.max(axis=1, keepdims=True))
        p = np.exp(pairs)
        scaled = lambda x: x / x.sum(axis=1, keepdims=True)  # noqa: E731  every step's sums are scaled: only ratios count
        ahead, back = np.zeros_like(grid), np.ones_like(grid)
        ahead[:, 0] = scaled(grid[:, 0] * p[0])
        for i in range(1, longest + 1):
            ahead[:, i] = scaled((ahead[:, i - 1] @ p) * grid[:, i])
        for i in range(longest - 1, -1, -1):
            back[:, i] = scaled((grid[:, i + 1] * back[:, i + 1]) @ p.T)
        node = scaled((ahead * back)[rows, cols])
        expected = np.zeros((k, k))
        expected[0] += scaled(ahead[:, 0] * back[:, 0]).sum(axis=0)
        for i in range(1, longest + 1):
            live = n >= i
            a, b = ahead[live, i - 1], (grid[:, i] * back[:, i])[live]
            expected += p * (a.T @ (b / ((a @ p) * b).sum(axis=1, keepdims=True)))
        return node, expected

    # ---- decoding

    def decode(self, t: Tokens) -> np.ndarray:
        """The label of every token on the best path of its text."""
        out = np.zeros(len(t.start), np.int64)
        if not len(out):
            return out
        e, p = self.emissions(t), self.pairs
        least = e[:, 0] + p[:, 0].min() + p[0].min()
        most = (e[:, 1:] + (p.max(axis=0) + p.max(axis=1))[1:]).max(axis=1)
        open_ = np.flatnonzero(least <= most)  # elsewhere the best path is at o
        if not len(open_):
            return out
        new = np.r_[True, (np.diff(open_) != 1) | (t.text[open_[1:]] != t.text[open_[:-1]])]
        begin = open_[new]
        size = np.diff(np.r_[np.flatnonzero(new), len(open_)])
        width = np.int64(1) << np.ceil(np.log2(size)).astype(np.int64)
        for w in np.unique(width):
            these = np.flatnonzero(width == w)
            block = max(1, (1 << 18) // int(w))
            for at in range(0, len(these), block):
                self._viterbi(e, begin[these[at : at + block]], size[these[at : at + block]], out)
        return out

    def _viterbi(self, e: np.ndarray, begin: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        """Best paths of stretches between two tokens at o."""
        p, w, s = self.pairs, int(size.max()), len(begin)
        best = e[begin] + p[0]
        come = np.zeros((w, s, p.shape[0]), np.int8)
        for i in range(1, w):
            live = size > i
            step = best[:, :, None] + p[None]
            come[i] = np.where(live[:, None], step.argmax(axis=1), np.arange(p.shape[0]))
            best = np.where(live[:, None], step.max(axis=1) + e[np.minimum(begin + i, len(e) - 1)], best)
        label = (best + p[:, 0]).argmax(axis=1)
        for i in range(w - 1, -1, -1):
            live = size > i
            out[begin[live] + i] = label[live]
            label = come[i][np.arange(s), label]


# ---------------------------------------------------------------- the labelled table

#: Patterns of labelled sentences; a name in braces is filled by a rule, and its kind is the part before an underscore.
PATTERNS = [
    "write to {email} or call {phone} before noon", "contact : {email} , phone : {phone} .", "you can reach me at {email}", "E-Mail : {email}",
    "{w} {w} {email} {w} {w}", "{w} {w} , {w} {phone} {w} {w} .", "{w} {phone} {w}", "call {phone} {w} {w}", "Tel. {phone_local} , {w}", "phone ( {phone_local} ) {w}",
    "call me on {phone_local} after {w}", "mobile : {phone_local}", "téléphone {phone_local}", "Telefon : {phone_local}", "llame al {phone_local} {w}",
    "{w} {ip} {w} {w}", "host {ip} is down", "from {ip} port 22", "server = \"{ip}\"", "{w} {w} {card} {w} {w} .", "card number {card} expires 04/27", "paid with {card_spaced} on 3 May",
    "Karte {card_spaced} , {w}", "carte {card} {w}", "{w} {w} token = \"{secret_hex}\" {w} {w}", "token = \"{secret_hex}\" {w}", "{w} {w}### token = \"{secret_hex}\"### {w}", "api_key = \"{secret_mixed}\"", "api_key : {secret_mixed} {w}", "secret = '{secret_mixed}'",
    "password = \"{secret_short}\"", "password : {secret_short}", "the password is {secret_short} .", "export SECRET_KEY={secret_mixed}", "Authorization : Bearer {secret_mixed}", "{w} token = \"{secret_hex}\"&&& {w}", "private key {secret_hex} {w}",
    "Dear Mr. {name} , {w} {w}", "Dear Mrs. {name} , thank you", "Mr. {name} {w} {w} {w}", "Ms. {name} {w} the {w}", "Dr. {name} will see you", "my name is {name} and {w} {w}", "name : {name}", "Name : {name_full}", "my name is {name_full} .",
    "patient : {name_full} , born 3 May 1971", "signed , {name_full}", "Herr {name} {w} {w}", "Frau {name} {w}", "ich heiße {name_full} .", "Sehr geehrter Herr {name} ,", "Monsieur {name} {w} {w}", "Madame {name} {w}", "je m'appelle {name_full} .", "Señor {name} {w}",
    "Señora {name} , {w}", "me llamo {name_full} .", "customer name : {name_full} , email : {email}", "SSN {id_ssn} {w}", "SSN : {id_ssn}", "social security number {id_ssn}", "passport {id_pass} {w}", "passport no. : {id_pass}", "IBAN {id_iban}", "IBAN : {id_iban} , {w}", "{w} {w} {email}&&& {w}", "{w}### {ip}### {w}",
    # nothing personal here
    "{w} {w} {w} {w} {w} {w} .", "{W} {w} {w} , {w} {w} .", "{W} {w} {w} {W} {w} .", "{w} {n} {w} {w} {n} .", "version {v} of {w} {w}", "{w} {v} {w}", "on {date} at {time} {w}", "{date} {time} {w} {w} {v}",
    "the price was {price} , not {price}", "order {order} shipped", "{w} {order} {w} {w}", "ISBN {isbn} {w}", "{w} {badcard} {w} {w}", "number {badcard} {w}", "commit {commit} {w} {w}", "see {url} for {w}", "{w} {url} {w}", "Licensed under the Apache License , Version 2.0",
    "GNU General Public License version 3", "All Rights Reserved . Copyright {year} {W} {W}", "{U} {U} {U}!! {U} {U}", "{w}### {w}&&& {w}%%% {w}$$$", "{W}### {w}*** {W}&&& {w}", "def {w}_{w}(x) : return x + {n}", "for i in range({n}) : {w}", "{w} = {n} ; {w} = \"{w}\"", "{W} {W} {W} {w}", "the name of the {w} is {w}",
    "my name for it is {w}", "Dear reader , {w} {w}", "password must have {n} characters", "a token of {w} {w}", "token {w} {w}", "the key to {w} {w}", "phone {w} {w}", "call {w} at {n}", "card {w} {n}", "{w} @ {w}", "@{w} {w}", "{n} % of {n} {w}", "{n} - {n} {w}", "room {n} , floor {n}", "page {n} of {n}",
    "{w} {year} - {year} {w}", "{w} \"{w}\" {w} '{w}'", "{W} . {W} {w} . {W}", "- {w}", "# {W} {w}", "| {w} | {n} | {n} |", "{badip} {w}", "section {v} {w}", "{w} {long} {w}", "id = \"{w}\" {w}", "email {w} {w}", "{x} {x} {x} {x}", "{x} , {x} {x} .", "{X} {x} {X} {x}", "{X} , {X} {X} !",
    *["{prose}"] * 60,
]
_FIRST = "Anna Ben Clara David Elena Frank Greta Hugo Ines Jan Karla Luis Maria Nils Olga Paul Rosa Sven Tina Omar Wei Aisha Jürgen José".split()
_LAST = "Adams Berg Castillo Dubois Evans Fischer García Hansen Ivanov Jensen Keller Lopez Moreau Novak Okafor Petersen Quinn Rossi Schmidt Tanaka Ueda Vogel Weber Young Müller Núñez".split()
_SYLLABLES = "an er in the on re st ou ing ed le ch ei ge un qu es ta mo ra ci".split()
_ACCENTED = "é è ê ç ó í ñ ú ä ö ü ß".split()


def _fill(what: str, rng: np.random.Generator) -> str:
    some = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    digits = lambda n: some("0123456789", n)
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 5))))

    def checked(n: int) -> str:
        body = pick("3456") + digits(n - 2)
        return next(body + d for d in "0123456789" if luhn((body + d).encode()))

    if what == "email":
        return f"{word()}{pick(['', '.', '_', '-'])}{pick([word(), digits(2), ''])}x@{word()}{pick(['', '-' + word(), digits(1)])}.{pick(['com', 'org', 'example.com', 'co.uk', 'de', 'net'])}"
    if what == "phone":
        return f"+{pick(['1', '44', '49', '33', '34'])} {pick(['({}) {}-{}', '{} {} {}', '{}-{}-{}', '{}.{}.{}'])}".format(digits(3), digits(3), digits(4))
    if what == "phone_local":
        return pick(["({}) {}-{}", "{}-{}-{}", "({}) {} {}"]).format(digits(3), digits(3), digits(4))
    if what == "ip":
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if what == "badip":
        return ".".join(str(x) for x in rng.integers(256, 999, 4))
    if what == "card":
        return checked(pick([16, 16, 16, 15, 13]))
    if what == "card_spaced":
        c = checked(16)
        return pick([" ", "-"]).join(c[i : i + 4] for i in range(0, 16, 4))
    if what == "badcard":
        c = checked(16)
        return c[:-1] + str((int(c[-1]) + int(rng.integers(1, 10))) % 10)
    if what == "secret_hex":
        return some("0123456789abcdef", int(pick([32, 40, 40, 40, 64])))
    if what == "secret_mixed":
        return pick(["", "sk-", "ghp_", "AKIA"]) + some("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", int(rng.integers(20, 44)))
    if what == "secret_short":
        return some("abcdefghkmnpqrstuvwxyz", 4) + digits(2) + some("ABCDEFGH", 2) + pick("!?#")
    if what == "name":
        return pick(_LAST)
    if what == "name_full":
        return f"{pick(_FIRST)} {pick(_LAST)}"
    if what == "id_ssn":
        return f"{digits(3)}-{digits(2)}-{digits(4)}"
    if what == "id_pass":
        return some("CFGHJK", 2) + digits(7)
    if what == "id_iban":
        return f"{pick(['DE', 'FR', 'ES'])}{digits(20)}"
    if what == "w":
        return pick([word(), word(), word() + pick(_ACCENTED), word() + pick(_ACCENTED) + word(), pick(["the", "of", "and", "is", "a", "der", "und", "la", "de", "que"])])
    if what == "U":
        return word().upper()
    if what in ("x", "X", "W"):  # words of many lengths, with letters beyond ASCII
        x = "".join(pick(_SYLLABLES + _ACCENTED) for _ in range(int(rng.integers(*((2, 5) if what == "W" else (3, 9))))))
        return x if what == "x" else x.capitalize()
    if what == "prose":  # sentences without personal data, with marks and line breaks anywhere
        one = lambda: _fill(pick(["w", "w", "x", "W", "X"]), rng)
        return "".join(one() + pick([" ", " ", " ", " ", ", ", ". ", ".", ".\n", "\n", "! ", "? ", " | ", "### ", "*** ", "&&&\n"]) for _ in range(int(rng.integers(6, 24))))
    if what == "n":
        return digits(int(rng.integers(1, 6)))
    if what == "v":
        return ".".join(str(x) for x in rng.integers(0, 20, int(rng.integers(2, 4))))
    if what == "date":
        return pick(["2024-0{}-1{}", "{}/1{}/2023", "1{}.0{}.2022"]).format(int(rng.integers(1, 9)), int(rng.integers(0, 9)))
    if what == "time":
        return f"{rng.integers(10, 24)}:{rng.integers(10, 60)}"
    if what == "price":
        return pick(["$", "€", ""]) + f"{rng.integers(1, 999)}.{rng.integers(10, 99)}"
    if what == "order":
        return digits(int(rng.integers(6, 13)))
    if what == "isbn":
        return "978" + digits(10)
    if what == "commit":
        return some("0123456789abcdef", int(pick([7, 8, 40])))
    if what == "url":
        return f"https://{word()}.org/{word()}/{digits(3)}"
    if what == "year":
        return f"19{digits(2)}"
    if what == "long":
        return some("abcdefghijklmnopqrstuvwxyz", int(rng.integers(20, 60)))
    raise ValueError(what)


def labelled(rounds: int = 5, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Rows of the labelled table: (text, [(kind, start, end)] in code points)."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(rounds):
        for pattern in PATTERNS:
            text, spans, at = "", [], 0
            while (i := pattern.find("{", at)) >= 0:
                j = pattern.index("}", i)
                text += pattern[at:i]
                value = _fill(pattern[i + 1 : j], rng)
                if (kind := pattern[i + 1 : j].split("_")[0]) in KINDS:
                    spans.append((kind, len(text), len(text) + len(value)))
                text, at = text + value, j + 1
            out.append((text + pattern[at:], spans))
    return out


def learn(table: Iterable[tuple[str, list[tuple[str, int, int]]]] | None = None) -> Field:
    """Train the field from labelled rows (text, [(kind, start, end)]), which are few by contract; by default ``labelled()``."""
    rows = [r for r in (labelled() if table is None else table) if r[0]]
    none = np.zeros(0, np.uint64)
    if not rows:
        field = Field(none, none, none)
        field.bias[0] = 1
        return field
    data, offsets = common.utf8(pa.array([r[0] for r in rows]))
    t = Tokens(data, offsets)
    y = np.zeros(len(t.start), np.int64)
    for i, (text, spans) in enumerate(rows):
        mine = slice(int(t.first[i]), int(t.first[i + 1]))
        for kind, a, b in spans:
            low, high = (offsets[i] + len(text[:x].encode()) for x in (a, b))
            y[mine][(t.start[mine] < high) & (t.end[mine] > low)] = LABELS.index(kind)
    # cues are words outside spans that several labelled tokens have; likewise neighbours, and orders of classes
    frequent = lambda x, least: (lambda v, n: v[n >= least])(*np.unique(x, return_counts=True))
    field = Field(frequent(t.shape, 4), frequent(t.word[y == 0], 6), frequent(t.left[t.same_at(1) & np.r_[True, y[:-1] == 0]], 4))
    field.fit(t, y)
    field.bias[0] += MARGIN
    return field


# ---------------------------------------------------------------- the operator


def _checked(kind: str, raw: bytes) -> bool:
    """Whether a span of the field passes what its kind asks for; a name has at most four words."""
    if kind == "name":
        return len(raw.split()) <= 4
    if kind == "email":
        return 0 < raw.find(b"@") < len(raw) - 1
    if kind == "ip":
        return _octets(raw) if raw.count(b".") == 3 and all(p.isdigit() for p in raw.split(b".")) else False
    n = _only_digits(raw)
    return 13 <= len(n) <= 19 and luhn(n) if kind == "card" else 9 <= len(n) <= 15 if kind == "phone" else True


def spans(data: np.ndarray, offsets: np.ndarray, field: Field | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, start byte, end byte, whether it is a base span) of all spans, by text, kind and start."""
    found = base_spans(data, offsets)
    kind = np.repeat(np.arange(len(BASE)), [len(x) for x in found])
    place = np.concatenate(found)
    more: list[tuple[int, int, int]] = []
    if field is not None and len(data):
        t = Tokens(data, offsets)
        y = field.decode(t)
        hit = np.flatnonzero(y)
        if len(hit):
            new = np.r_[True, (np.diff(hit) != 1) | (y[hit[1:]] != y[hit[:-1]]) | (t.text[hit[1:]] != t.text[hit[:-1]])]
            cover = np.zeros(len(data) + 1, np.int32)
            np.add.at(cover, place[:, 0], 1)
            np.add.at(cover, place[:, 1], -1)
            covered = np.r_[0, np.cumsum(np.cumsum(cover)[:-1] > 0)]
            first, last = hit[new], hit[np.r_[np.flatnonzero(new)[1:] - 1, len(hit) - 1]]
            for i, j in zip(first.tolist(), last.tolist()):
                k, s, e = int(y[i]) - 1, int(t.start[i]), int(t.end[j])
                if KINDS[k] == "phone" and s > offsets[t.text[i]] and data[s - 1] in b"(+":
                    s -= 1
                if covered[e] == covered[s] and _checked(KINDS[k], data[s:e].tobytes()):
                    more.append((k, s, e))
    extra = np.array(more, np.int64).reshape(-1, 3)
    kind, place = np.r_[kind, extra[:, 0]], np.concatenate([place, extra[:, 1:]])
    base = np.arange(len(kind)) < len(kind) - len(extra)
    text = np.searchsorted(offsets, place[:, 0], side="right") - 1
    order = np.lexsort((place[:, 1], place[:, 0], kind, text))
    return kind[order], place[order, 0], place[order, 1], base[order]


def find(df: DataFrame, keep: list[str], field: Field | None = None, text: str = "text") -> DataFrame:
    """The kept columns, base_spans and spans: arrays of (kind, start, end) in code points, by kind and start.

    field: of ``learn``; None: base spans alone."""

    def fn(col: pa.Array) -> dict[str, pa.Array]:
        data, offsets = common.utf8(col)
        kind, start, end, base = spans(data, offsets, field)
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        where = np.searchsorted(offsets, start, side="right") - 1
        zero = points[offsets[where]] if len(where) else where
        names = np.array(KINDS)[kind] if len(kind) else np.zeros(0, "U1")
        out = {}
        for name, mask in (("base_spans", base), ("spans", np.ones(len(kind), bool))):
            n = np.bincount(where[mask], minlength=len(col))
            s = pa.StructArray.from_arrays([pa.array(names[mask].tolist(), pa.string()), pa.array((points[start] - zero)[mask], pa.int64()), pa.array((points[end] - zero)[mask], pa.int64())], ["kind", "start", "end"])
            out[name] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), s)
        return out

    return common.map_appending(df, keep, text, f"base_spans {SPAN}, spans {SPAN}", fn, most=SLICE)


def written(spans: str) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, keep: list[str], field: Field | None = None, text: str = "text") -> DataFrame:
    """The kept columns, and as redacted the text in which each span (of overlapping ones, their union) is its first kind in brackets; null: null."""

    def fn(col: pa.Array) -> dict[str, pa.Array]:
        data, offsets = common.utf8(col)
        kind, start, end, _ = spans(data, offsets, field)
        out: list[str | None] = []
        order = np.argsort(start, kind="stable")
        bounds = np.searchsorted(start[order], offsets)
        for i, value in enumerate(col):
            if not value.is_valid:
                out.append(None)
                continue
            parts, at = [], int(offsets[i])
            for k in order[bounds[i] : bounds[i + 1]]:
                if start[k] >= at:
                    parts += [data[at : start[k]].tobytes(), f"[{KINDS[kind[k]].upper()}]".encode()]
                at = max(at, int(end[k]))
            out.append(b"".join([*parts, data[at : offsets[i + 1]].tobytes()]).decode())
        return {"redacted": pa.array(out, pa.string())}

    return common.map_appending(df, keep, text, "redacted string", fn, most=SLICE)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, ["doc_id"], learn())
    kinds = F.transform("base_spans", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *count, F.sha2(written("base_spans"), 256).alias("base_sha256"), written("spans").alias("spans"))
