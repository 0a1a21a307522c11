"""Linear-chain conditional random field over the shapes of words."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
STEPS, RATE, DECAY = 300, 0.5, 0.01

# Labelled rows: {kind:text} marks a span.  Fixed example values.
TRAINING = [
    "write to {email:anna.berg@mail.example.org} today", "mail {email:j_doe77@post.example.com}, thanks",
    "{email:info@firma.example.de} or {email:kontakt@firma.example.de}", "<{email:x.y-z@a1.example.net}>",
    "contact: {email:12.34@mail7.example.com} please", "cc {email:sales+eu@shop.example.co}",
    "the host {ip:10.0.0.12} answered", "from {ip:192.168.1.254}: timeout", "{ip:8.8.4.4} and {ip:172.16.31.9}",
    "ping {ip:203.0.113.77}.", "| {ip:97.51.17.173} |", "({ip:45.33.2.1})",
    "card {card:4111 1111 1111 1111} expires", "paid with {card:4012888888881881} yesterday",
    "{card:5500-0055-5555-5559} was charged", "number {card:5105105105105100}, code", "{card:4222 2222 2222 2220}",
    "card no. {card:6011000990139424}.", "{card:3566 0020 2036 0505} ok", "use {card:4000-0566-5566-5556}",
    "call {phone:+1 (974) 555-3436} now", "tel {phone:+49 30 1234 5678} in the morning", "{phone:+44 20 7946 0018}",
    "phone {phone:+1 (301) 555-0346}.", "ring {phone:+33 1 23 45 67 89}", "fax {phone:+34-91-123-4567}",
    "call {phone:(974) 555-3436} now", "phone {phone:(301) 555-0346}, ask", "{phone:(212) 555-7719} home",
    "tel {phone:(044) 555-1200} work", "reach me at {phone:974-555-3436} today", "{phone:301-555-0346}",
    "ring {phone:212-555-7719} or {phone:(212) 555-7720}", "office {phone:020-555-1234}.", "mobile {phone:415-555-0199}",
    "in 2019 and 2021", "about 12,500 people", "3.14 is near 22/7", "version 1.2.3 of it", "at 10:30 on 12.05.2020",
    "room 7 floor 3", "chapter 12 verse 4", "order 1234567890123456 shipped", "id 9807915762804491 done",
    "number 4736962573099580 here", "8123456789012345 rows", "serial 77-88-99", "pages 100-250", "2020-11-30",
    "build 10.300.4.999", "section 1.2.3.400.5", "user@host only", "@someone said", "a@b", "99% of 1000",
    "555-7713 units", "0.5 to 1.5", "covid-19 cases", "mp3 and h264", "$1,299.00", "16 + 4 = 20", "1st 2nd 3rd",
    "code 0810992847249405", "ratio 4:3", "[12] [13]", "1990s", "24/7", "no. 5", "x1 y2 z3", "500 000 000 years",
    "12 34 56 78", "2019 2020 2021 2022", "10 20 30 40 50 60", "phi 1.618033988749", "0x1f 0b11", "v2.0.1-rc1",
]

_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_MARK = re.compile(r"[0-9@]+")


@dataclass
class Token:
    start: int
    end: int


def candidates(text: str) -> list[list[Token]]:
    """Maximal runs of neighbouring words that hold a digit or an @ sign.

    The field gives every other word the label O, so each run is a chain by itself.
    """
    runs: list[list[Token]] = []
    end = -1
    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        start, floor = m.start(), max(end, 0)
        while start > floor and not text[start - 1].isspace():
            start -= 1
        near = end >= 0 and start - end <= 4 and text[end:start].isspace()
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        if near:
            runs[-1].append(Token(start, end))
        else:
            runs.append([Token(start, end)])
    return runs


def shape(word: str) -> str:
    """Digits as d with their number up to 5, letters as a, other signs as they are."""
    word = word.strip(".,;:!?\"'<>[]{}|*%$#&")[:64]
    word = re.sub(r"[^\W\d_]+", "a", word)
    return re.sub(r"[0-9]+", lambda m: f"d{min(5, len(m[0]))}", word)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def features(text: str, run: list[Token]) -> list[list[str]]:
    words = [text[t.start:t.end] for t in run]
    shapes = [shape(w) for w in words]
    digits = [re.sub(r"[^0-9]", "", w[:64]) for w in words]
    every = "".join(digits)[:64]
    whole = f"{min(20, len(every))}{'v' if 16 <= len(every) <= 19 and luhn(every) else ''}"
    rows = []
    for k, (w, s, d) in enumerate(zip(words, shapes, digits)):
        octets = w.strip(".,;:()|").split(".")
        flags = (("@" in w and "." in w.rpartition("@")[2].strip(".")) * "m"
                 + (len(octets) == 4 and all(o.isascii() and o.isdigit() and len(o) < 9 and int(o) < 256 for o in octets)) * "i"
                 + (16 <= len(d) <= 19 and luhn(d)) * "c")
        rows.append([
            f"shape={s}", f"digits={min(20, len(d))}", f"flags={flags}", f"first={w[:1] if not w[:1].isalnum() else ''}",
            f"run={whole}", f"words={min(4, len(run))},{min(k, 4)}", f"shape+run={s},{whole}",
            f"before={shapes[k - 1] if k else '^'},{s}", f"after={shapes[k + 1] if k + 1 < len(run) else '$'},{s}"])
    return rows


class Field:
    """Weights of features and label changes; decoding works on many chains at a time."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, change: np.ndarray, first: np.ndarray):
        self.index, self.weights, self.change, self.first = index, weights, change, first

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(LABELS)))
        for k, names in enumerate(rows):
            known = [self.index[n] for n in names if n in self.index]
            if known:
                out[k] = self.weights[known].sum(axis=0)
        return out

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each chain by Viterbi; chains of like length go through together."""
        out: list = [None] * len(chains)
        order = sorted(range(len(chains)), key=lambda k: len(chains[k]))
        at = 0
        while at < len(order):
            group = order[at:at + 512]
            most = len(chains[group[0]]) * 2
            group = [k for k in group if len(chains[k]) <= most]
            at += len(group)
            length = max(len(chains[k]) for k in group)
            emit = np.zeros((len(group), length, len(LABELS)))
            size = np.array([len(chains[k]) for k in group])
            for g, k in enumerate(group):
                emit[g, :size[g]] = chains[k]
            best = emit[:, 0] + self.first
            back = np.zeros((len(group), length, len(LABELS)), np.int8)
            ends = np.where((size == 1)[:, None], best, -np.inf)
            for t in range(1, length):
                step = best[:, :, None] + self.change
                back[:, t] = step.argmax(axis=1)
                best = step.max(axis=1) + emit[:, t]
                ends = np.where((size == t + 1)[:, None], best, ends)
            label = ends.argmax(axis=1)
            path = np.zeros((len(group), length), np.int8)
            for t in range(length - 1, -1, -1):
                inside = size > t
                path[inside, t] = label[inside]
                follow = inside & (t > 0)
                label = np.where(follow, back[np.arange(len(group)), t, label], label)
            for g, k in enumerate(group):
                out[k] = path[g, :size[g]]
        return out


def _parsed(row: str) -> tuple[str, list[tuple[int, int, str]]]:
    text, spans, at = "", [], 0
    for m in re.finditer(r"\{(email|ip|card|phone):([^}]*)\}", row):
        text += row[at:m.start()]
        spans.append((len(text), len(text) + len(m[2]), m[1]))
        text += m[2]
        at = m.end()
    return text + row[at:], spans


def examples(rows: list[str]) -> list[tuple[list[list[str]], list[int]]]:
    """Feature rows and labels of every run of the labelled rows."""
    out = []
    for row in rows:
        text, spans = _parsed(row)
        for run in candidates(text):
            labels, last = [], None
            for t in run:
                own = next((s for s in spans if s[0] < t.end and t.start < s[1]), None)
                labels.append(LABELS.index(f"{'I' if own is last else 'B'}-{own[2]}") if own else 0)
                last = own
            out.append((features(text, run), labels))
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(rows: list[str] | None = None) -> Field:
    """Maximise the conditional likelihood of the labelled rows by gradient steps."""
    data = examples(TRAINING if rows is None else rows)
    index = {n: k for k, n in enumerate(sorted({n for f, _ in data for row in f for n in row}))}
    many, length, size = len(data), max((len(y) for _, y in data), default=1), len(LABELS)
    field = Field(index, np.zeros((len(index), size)), np.zeros((size, size)), np.zeros(size))
    # I-x follows B-x or I-x only.
    for k in range(2, size, 2):
        field.first[k] = -1e4
        field.change[[j for j in range(size) if j not in (k - 1, k)], k] = -1e4
    if not data:
        return field
    chain = [(s, t, [index[n] for n in names]) for s, (f, _) in enumerate(data) for t, names in enumerate(f)]
    rows_ = np.array([s for s, t, n in chain for _ in n])
    cols = np.array([t for s, t, n in chain for _ in n])
    feats = np.array([i for _, _, n in chain for i in n])
    there = np.zeros((many, length), bool)
    gold = np.zeros((many, length), np.int64)
    for s, (_, y) in enumerate(data):
        there[s, :len(y)] = True
        gold[s, :len(y)] = y
    target = np.eye(size)[gold] * there[:, :, None]
    pair_gold = np.zeros((size, size))
    np.add.at(pair_gold, (gold[:, :-1][there[:, 1:]], gold[:, 1:][there[:, 1:]]), 1)
    sums_w, sums_c = np.full(field.weights.shape, 1e-8), np.full(field.change.shape, 1e-8)
    for _ in range(STEPS):
        emit = np.zeros((many, length, size))
        np.add.at(emit, (rows_, cols), field.weights[feats])
        ahead = np.zeros((many, length, size))
        ahead[:, 0] = emit[:, 0] + field.first
        for t in range(1, length):
            ahead[:, t] = np.where(there[:, t, None], _log_sum(ahead[:, t - 1, :, None] + field.change, 1) + emit[:, t],
                                   ahead[:, t - 1])
        total = _log_sum(ahead[:, -1], 1)
        behind = np.zeros((many, length, size))
        expected = np.zeros((size, size))
        for t in range(length - 2, -1, -1):
            follow = field.change + (emit[:, t + 1] + behind[:, t + 1])[:, None, :]
            behind[:, t] = np.where(there[:, t + 1, None], _log_sum(follow, 2), behind[:, t + 1])
            p = np.exp(ahead[:, t, :, None] + follow - total[:, None, None])
            expected += (p * there[:, t + 1, None, None]).sum(axis=0)
        wrong = (target - np.exp(ahead + behind - total[:, None, None])) * there[:, :, None]
        grad = np.zeros_like(field.weights)
        np.add.at(grad, feats, wrong[rows_, cols])
        grad -= DECAY * field.weights
        sums_w += grad ** 2
        field.weights += RATE * grad / np.sqrt(sums_w)
        open_ = field.change > -1e3
        step = np.where(open_, pair_gold - expected - DECAY * field.change, 0)
        sums_c += step ** 2
        field.change += RATE * step / np.sqrt(sums_c)
    return field


def spans_of(text: str, run: list[Token], labels: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a labelled run, without the signs around them."""
    out: list[list] = []
    for t, y in zip(run, labels.tolist()):
        name = LABELS[y]
        if name[0] == "B":
            out.append([name[2:], t.start, t.end])
        elif name[0] == "I" and out:
            out[-1][2] = t.end
    found = []
    for kind, start, end in out:
        m = _CORE.search(text, start, end)
        if m:
            start, end = m.start(), m.end()
            if kind == "phone" and start and text[start - 1] in "(+" and text[start - 1:end].count("(") == text[start - 1:end].count(")"):
                start -= 1
            found.append((kind, start, end))
    return found
