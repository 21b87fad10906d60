"""Personal data by a semi-Markov conditional random field, beside four fixed patterns.

Candidates are whole spans: stretches of digit runs (up to RUNS of them, with what stands between) as
address, card or phone number, and a local part, an "at" and labels with "dots" as mail address, also
written out or bracketed. Whole-span features (number of digits, check digit, grouping, separators,
prefix, what touches the span) score each candidate for each kind; a dynamic program over the ends of
candidates chooses boundaries and kinds together, as the segmentation with the highest sum; text outside
spans scores 0. Weights are learned by conditional likelihood (forward and backward sums over all
segmentations) from windows made by rule: entities in plain and disguised forms, look-alikes (dates,
versions, ids, amounts, failing check digits), next to each other and among words of a bounded sample
of the table's texts.

Spans of the fixed patterns always stay, and the field adds spans that overlap none of them: numbers
that run into each other, groups of four with other separators, bracketed dots, written-out addresses.

Defined results: null and empty texts have no spans; a failing match of a fixed pattern is dropped
without another try, as the patterns' definition says; ties go to fewer spans, then to the spans that
end first; overlapping spans of different fixed patterns all stay. Every row is kept, repeated and null
ids too; equal texts get equal results; an empty table gives no rows. Only the id and the text are read,
whole. Places are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces

KINDS = ("email", "ip", "card", "phone")
#: Digit runs in a candidate at most, and its digits at least and at most.
RUNS, LEAST, MOST = 20, 7, 20

#: The fixed patterns (fixed values), written so that each takes linear time: a mail address is found from its "@".
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NUMBERS = re.compile(r"[0-9]++(?:(?:[ \t.()/\- ‐-―]{1,4}+|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s)[0-9]++)*+", re.I)
RUN = re.compile(r"[0-9]+")
DOTTED = re.compile(r"\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s", re.I)
#: What shows that addresses are written out, and the "at" and labels of such addresses.
SPELLED = re.compile(r"[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]|\sdot\s", re.I)
AT = re.compile(r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s|\s?@\s?", re.I)
LABELS = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s)[A-Za-z0-9-]+)*", re.I)
LABEL = re.compile(r"[A-Za-z0-9-]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed patterns, in order."""
    out, done = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                done = m.end()
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


# ---------------------------------------------------------------- candidates and their features

#: Kinds of what stands between two runs.
NONE, BLANK, DASH, DOT, PAREN, SPELT, SLASH, OTHER = range(8)
N_NUMBER, N_MAIL = 38, 16


def between(text: str) -> int:
    """What a separator is; in brackets it is a spelt dot or part of a number's brackets."""
    if text in (" ", " "):
        return BLANK
    if text in ("-", "‐", "‑", "‒", "–"):
        return DASH
    if text == ".":
        return DOT
    if DOTTED.fullmatch(text):
        return SPELT
    if "(" in text or ")" in text:
        return PAREN
    return SLASH if text == "/" else OTHER


def touching(c: str) -> int:
    """What touches a span: 0 nothing or a blank, 1 a letter, digit or underscore, 2 a sentence's mark, 3 something else."""
    if not c or c.isspace():
        return 0
    return 1 if c.isalnum() or c == "_" else 2 if c in ".,;:!?\"'()" else 3


class Numbers:
    """Candidates of digit runs in a batch of texts: text, start, end and features of each."""

    def __init__(self, texts: list[str]):
        runs, digits = [], []
        zones = 0
        for t, text in enumerate(texts):
            for m in NUMBERS.finditer(text):
                if m.end() - m.start() < LEAST:
                    continue
                own = [(r.start(), r.end()) for r in RUN.finditer(text, m.start(), m.end())]
                if sum(e - s for s, e in own) < LEAST:
                    continue
                before = m.start()
                for s, e in own:
                    lead = text[s - 1 : s]
                    kind = between(text[before:s]) if s > m.start() else NONE
                    at = s - 1 if lead in ("+", "(") else s
                    runs.append((t, zones, s, e, kind, lead == "+", lead == "(", text[e : e + 1] == ")", touching(text[at - 1 : at] if at else ""), touching(text[e : e + 1]), int(text[s:e][-4:]) > 255 or e - s > 3))
                    digits.append(text[s:e])
                    before = e
                zones += 1
        self.text, self.start, self.end = (np.zeros(0, np.int64) for _ in range(3))
        self.x = np.zeros((0, N_NUMBER), bool)
        if not runs:
            return
        text, zone, s, e, kind, plus, opened, closed, left, right, over = np.array(runs, np.int64).T
        length = e - s
        upto = lambda v: np.concatenate([[0], np.cumsum(v)])
        at = upto(length)
        d = np.frombuffer("".join(digits).encode(), np.uint8).astype(np.int64) - ord("0")
        twice = np.where(2 * d > 9, 2 * d - 9, 2 * d)
        even = np.arange(len(d)) % 2 == 0
        sums = (upto(np.where(even, twice, d)), upto(np.where(even, d, twice)))  # doubled at even places, at odd places
        fours, ones, large, shuts = upto(length == 4), upto(length == 1), upto(over), upto(closed)
        seps = [upto(kind == k) for k in range(8)]
        lead = np.where(d[at[:-1]] >= 3, d[at[:-1]] <= 6, False)
        parts = []
        for size in range(1, min(RUNS, len(zone)) + 1):
            i = np.flatnonzero(zone[size - 1 :] == zone[: len(zone) - size + 1])
            j = i + size - 1
            n = at[j + 1] - at[i]
            keep = (n >= LEAST) & (n <= MOST)
            i, j, n = i[keep], j[keep], n[keep]
            if not len(i):
                continue
            inner = [c[j + 1] - c[i + 1] for c in seps]
            kinds = sum((c > 0).astype(int) for c in inner)
            x, y = at[i], at[j + 1]
            check = np.where(y % 2 == 0, sums[0][y] - sums[0][x], sums[1][y] - sums[1][x]) % 10 == 0
            long = (n >= 13) & (n <= 19)
            bracket = (opened[i] == 1) & (shuts[j + 1] > shuts[i])
            dots = inner[DOT] + inner[SPELT] == size - 1
            small = large[j + 1] == large[i]
            after = np.where((j + 1 < len(zone)) & (zone[np.minimum(j + 1, len(zone) - 1)] == zone[j]), kind[np.minimum(j + 1, len(zone) - 1)], NONE)
            tight = lambda k: (k != NONE) & (k != BLANK)
            calls = (length[j] == 4) & (size >= 3) & (length[np.maximum(j - 1, 0)] == 3) & (length[np.maximum(j - 2, 0)] == 3)
            groups = (fours[j + 1] - fours[i] == 4) & (size == 4)
            parts.append(
                (text[i], np.where((plus[i] == 1) | bracket, s[i] - 1, s[i]), e[j],
                 np.stack([
                     n >= 0, n < 8, n == 10, (n == 11) | (n == 12), (n >= 13) & (n <= 15), n == 16, (n >= 17) & (n <= 19), n > 19,
                     long & check, long & ~check, n * 0 + size == 1, groups, plus[i] == 1, bracket | (inner[PAREN] > 0), calls,
                     dots & small & (size == 4) & (inner[SPELT] == 0), dots & small & (size == 4) & (inner[SPELT] > 0), dots & ~small & (size == 4), dots & (n * 0 + size > 1) & (n * 0 + size != 4),
                     (kinds > 1) & (inner[PAREN] == 0), n * 0 + size > 6, (ones[j + 1] - ones[i] == size) & (size > 7), left[i] == 1, right[j] == 1,
                     tight(kind[i]) & (plus[i] == 0), kind[i] == BLANK, tight(after), after == BLANK, inner[SLASH] > 0, left[i] == 3, lead[i] & (n > 12),
                     (plus[i] == 1) & (n >= 8) & (n <= 15), inner[OTHER] > 0, (n == 16) & check & ((n * 0 + size == 1) | groups), calls & (n == 10) & (bracket | (inner[DASH] == 2) | (inner[DOT] == 2)),
                     (plus[i] == 1) & (n >= 8) & (n <= 15) & calls, right[j] == 3, (plus[i] == 1) & ((n < 8) | (n > 15)),
                 ], 1))
            )
        if parts:
            self.text, self.start, self.end, self.x = (np.concatenate(c) for c in zip(*parts, strict=True))


class Mails:
    """Candidates of mail addresses in a batch of texts: local part, "at" and labels, written in any way."""

    def __init__(self, texts: list[str]):
        rows, x = [], []
        for t, text in enumerate(texts):
            spelled = SPELLED.search(text)
            if not spelled and "@" not in text:
                continue
            for m in AT.finditer(text):
                found = LABELS.match(text, m.end())
                if not found or not m.start() or text[m.start() - 1] not in LOCAL:
                    continue
                starts = [m.start()]
                while starts[0] and text[starts[0] - 1] in LOCAL:
                    starts[0] -= 1
                for lead in DOTTED.finditer(text, max(0, starts[0] - 12), starts[0]):  # "john dot smith": the local part goes on
                    if lead.end() == starts[0] and lead.start() and text[lead.start() - 1] in LOCAL:
                        more = lead.start()
                        while more and text[more - 1] in LOCAL:
                            more -= 1
                        starts.append(more)
                sign = m[0].strip()
                labels = [(r.start(), r.end()) for r in LABEL.finditer(text, m.end(), found.end()) if not (r[0].lower() == "dot" and DOTTED.fullmatch(text, r.start() - 1, r.end() + 1))]
                for size in range(2, min(len(labels), 6) + 1):
                    end = labels[size - 1][1]
                    seps = [text[a[1] : b[0]] for a, b in zip(labels, labels[1:size], strict=False)]
                    last = text[labels[size - 1][0] : end]
                    spelt = sum(s != "." for s in seps)
                    for start in starts:
                        plain = sign == "@"
                        x.append([
                            True, plain and m[0] == sign, plain and m[0] != sign, sign.lower() == "at", sign[:1] in "[({<", spelt == 0, spelt == len(seps), 0 < spelt < len(seps),
                            last.isalpha() and 2 <= len(last) <= 6, not last.isalpha(), last.isalpha() and len(last) == 1 or len(last) > 6, size == len(labels), size < len(labels) and seps[0] == text[end : labels[size][0]],
                            start == starts[-1], sign.lower() == "at" and spelt == 0, touching(text[end : end + 1]) == 1 or (start > 0 and touching(text[start - 1 : start]) == 1),
                        ])
                        rows.append((t, start, end))
        self.text, self.start, self.end = np.array(rows, np.int64).reshape(-1, 3).T
        self.x = np.array(x, bool).reshape(-1, N_MAIL)


# ---------------------------------------------------------------- the field


class Field:
    """Weights: a row for each kind of number (address, card, phone) and one for mail addresses."""

    def __init__(self, numbers: np.ndarray, mails: np.ndarray):
        self.numbers, self.mails = numbers, mails


def segments(texts: list[str]) -> tuple[Numbers, Mails]:
    return Numbers(texts), Mails(texts)


def scores(numbers: Numbers, mails: Mails, field: Field) -> tuple[np.ndarray, ...]:
    """text, start, end, kind and score of every segment: each number as each of three kinds."""
    n = len(numbers.text)
    text = np.concatenate([mails.text, *[numbers.text] * 3])
    start = np.concatenate([mails.start, *[numbers.start] * 3])
    end = np.concatenate([mails.end, *[numbers.end] * 3])
    kind = np.concatenate([np.zeros(len(mails.text), np.int64), np.repeat([1, 2, 3], n)])
    return text, start, end, kind, np.concatenate([mails.x @ field.mails, (numbers.x @ field.numbers.T).T.ravel()])


def best(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The segmentation with the highest sum of scores: (start, end, kind, score) segments that do not overlap."""
    found = sorted((s for s in found if s[3] > 0), key=lambda s: (s[1], s[0], s[2]))
    value, back = [0.0], []
    ends: list[int] = []
    for start, end, _, score in found:
        before = int(np.searchsorted(ends, start, "right"))
        take = value[before] + score
        back.append(before if take > value[-1] else -1)
        value.append(max(take, value[-1]))
        ends.append(end)
    out, k = [], len(found)
    while k:
        if back[k - 1] < 0:
            k -= 1
        else:
            out.append(found[k - 1])
            k = back[k - 1]
    return out[::-1]


def spans_of(texts: list[str], field: Field) -> list[list[tuple[int, int, int, bool, float]]]:
    """(kind, start, end, fixed, score) of each text's spans, by kind and start; a fixed span's score is null."""
    held = [fixed_spans(t) if any(c in t for c in "0123456789@") else [] for t in texts]
    text, start, end, kind, score = scores(*segments(texts), field)
    often: dict[int, list] = {}
    for t, s, e, k, v in zip(*(c[score > 0].tolist() for c in (text, start, end, kind, score)), strict=True):
        often.setdefault(t, []).append((s, e, k, v))
    out = []
    for t, fixed in enumerate(held):
        spans = [(k, s, e, True, None) for k, s, e in fixed]
        if t in often:
            taken = sorted((s, e) for _, s, e in fixed)
            # fixed spans are walls: of overlapping ones the furthest end counts
            begins, reach = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]).tolist()
            free = [c for c in often[t] if not (k := int(np.searchsorted(begins, c[1], "left"))) or reach[k - 1] <= c[0]]
            spans += [(k, s, e, False, v) for s, e, k, v in best(free)]
        out.append(sorted(spans, key=lambda x: x[:3]))
    return out


# ---------------------------------------------------------------- learning


def _check_digit(r: random.Random, n: int) -> str:
    body = str(r.choice([3, 4, 5, 6])) + "".join(r.choice("0123456789") for _ in range(n - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _digits(r: random.Random, n: int) -> str:
    return str(r.randint(1, 9)) + "".join(r.choice("0123456789") for _ in range(n - 1))


def entity(r: random.Random, kind: int, word) -> str:
    """An entity in one of its forms."""
    if kind == 0:
        local = r.choice([word(), f"{word()}.{word()}", f"{word()}{r.randint(0, 99)}", f"{word()}.{r.randint(0, 99):02d}"])
        labels = [word() + r.choice(["", str(r.randint(1, 9))]) for _ in range(r.choice([1, 1, 2]))] + [r.choice(["com", "org", "net", "de", "fr", "es", "info"])]
        at, dot = r.choice([("@", "."), (" at ", " dot "), ("[at]", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), ("@", " dot "), ("@", "[.]")])
        return local + at + dot.join(labels)
    if kind == 1:
        return r.choice([".", ".", "[.]", "(.)", " dot ", "[dot]"]).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == 2:
        number = _check_digit(r, r.choice([16, 16, 16, 16, 15, 19, 13]))
        if len(number) == 16 and r.random() < 0.6:
            return r.choice([" ", "-", ".", " ", "  ", "/"]).join(number[k : k + 4] for k in range(0, 16, 4))
        return number if r.random() < 0.95 else " ".join(number)
    a, b, c = _digits(r, 3), _digits(r, 3), f"{r.randint(0, 9999):04d}"
    country = r.choice(["1", "44", "49", "33", "34"])
    return r.choice([f"+{country} ({a}) {b}-{c}", f"+{country} ({a}) {b}-{c}", f"+{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}", f"+{country}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{country} {a}{b}{c}", f"+{country}.{a}.{b}.{c}"])


def decoy(r: random.Random, word) -> str:
    """What looks like an entity and is none."""
    big = lambda: r.randint(256, 999)
    wrong = next(x for x in iter(lambda: _digits(r, r.choice([13, 15, 16, 16, 16, 17, 18, 19])), "") if not luhn(x))
    parts = [str(r.randint(0, 255)) for _ in range(4)]
    parts[r.randrange(4)] = str(big())
    return r.choice([
        f"{r.randint(1900, 2100)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2100)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2100)}",
        wrong, "-".join(wrong[k : k + 4] for k in range(0, len(wrong), 4)), _digits(r, r.randint(7, 12)), _digits(r, r.randint(20, 30)), ".".join(parts), ".".join(str(r.randint(0, 30)) for _ in range(r.choice([5, 6]))),
        " ".join(str(r.randint(0, 99999)) for _ in range(r.randint(2, 8))), f"{_digits(r, 4)}.{_digits(r, 6)}", f"{r.randint(1, 9)} {_digits(r, 3)} {_digits(r, 3)}", f"{r.randint(1900, 2000)}-{r.randint(2001, 2030)}", f"{word()} at {word()}.{word()}", f"{_digits(r, 3)}-{_digits(r, 4)}",
        f"{word()}{_digits(r, r.choice([8, 10, 16]))}{word()}", f"{_digits(r, 10)}{word()}", "".join(r.choice("0123456789abcdef") for _ in range(32)), f"978-{r.randint(0, 9)}-{_digits(r, 3)}-{_digits(r, 5)}-{r.randint(0, 9)}", f"@{word()} at {word()}", f"{word()} @ {word()}",
        f"{_digits(r, 2)}/{_digits(r, 3)}/{_digits(r, 4)}", f"#{_digits(r, 9)}", f"{r.randint(0, 23)}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}.{_digits(r, 6)}", " ".join(r.choice("0123456789") for _ in range(r.randint(8, 20))),
    ])


def windows(words: list[str], n: int, seed: int = 42) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with their (kind, start, end), made by rule and the same at each call."""
    r = random.Random(seed)
    word = lambda: r.choice(words)
    plain = [w for w in words if w.isascii() and w.isalpha()] or ["example", "mail", "info"]
    name = lambda: r.choice(plain)
    out = []
    for _ in range(n):
        text, gold = word() + " " if r.random() < 0.8 else "", []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.6:
                kind = r.randrange(4)
                value = entity(r, kind, name)
                gold.append((kind, len(text), len(text) + len(value)))
            else:
                value = decoy(r, name)
            text += value + r.choice([" ", " ", ", ", ". ", "\n", "; ", "### ", f" {word()} ", f" {word()} {word()} "])
        out.append((text, gold))
    return out


def fit(examples: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 150, rate: float = 0.2, ridge: float = 1e-3) -> Field:
    """Weights of the highest conditional likelihood of the examples' segmentations, less `ridge` times their squares."""
    numbers, mails = segments([t for t, _ in examples])
    field = Field(np.zeros((3, N_NUMBER)), np.zeros(N_MAIL))
    text, start, end, kind, score = scores(numbers, mails, field)
    spots = np.unique(np.stack([np.concatenate([text, text]), np.concatenate([start, end])], 1), axis=0)
    first = np.searchsorted(spots[:, 0], np.arange(len(examples) + 1))
    number_of = {(t, p): k for k, (t, p) in enumerate(spots.tolist())}
    at = lambda p: np.array([number_of[x] for x in zip(text.tolist(), p.tolist(), strict=True)], np.int64) - first[text]
    a, b = at(start), at(end)
    there = {x: k for k, x in enumerate(zip(text.tolist(), kind.tolist(), start.tolist(), end.tolist(), strict=True))}
    gold = np.zeros(len(text))
    lost = set()
    for t, (_, spans) in enumerate(examples):
        for k, s, e in spans:
            if (t, k, s, e) in there:
                gold[there[t, k, s, e]] = 1
            else:
                lost.add(t)  # a form that no candidate has
    used = ~np.isin(text, list(lost))
    last = int(b.max(initial=0))
    by_end, by_start = [np.flatnonzero(used & (b == p)) for p in range(last + 1)], [np.flatnonzero(used & (a == p)) for p in range(last + 1)]
    n_mail = len(mails.text)
    moment, scale = [0.0, 0.0], [0.0, 0.0]
    for step in range(1, steps + 1):
        score = scores(numbers, mails, field)[4]
        ahead, behind = np.zeros((len(examples), last + 1)), np.zeros((len(examples), last + 1))
        for p in range(1, last + 1):
            ahead[:, p] = ahead[:, p - 1]
            np.logaddexp.at(ahead[:, p], text[by_end[p]], ahead[text[by_end[p]], a[by_end[p]]] + score[by_end[p]])
        for p in range(last - 1, -1, -1):
            behind[:, p] = behind[:, p + 1]
            np.logaddexp.at(behind[:, p], text[by_start[p]], behind[text[by_start[p]], b[by_start[p]]] + score[by_start[p]])
        chance = np.where(used, np.exp(ahead[text, a] + score + behind[text, b] - ahead[text, last]), 0)
        rest = np.where(used, gold - chance, 0)
        slopes = [np.stack([rest[n_mail + k * len(numbers.text) : n_mail + (k + 1) * len(numbers.text)] @ numbers.x for k in range(3)]) / len(examples), rest[:n_mail] @ mails.x / len(examples)]
        for k, w in enumerate((field.numbers, field.mails)):  # steps scaled by the slopes' running moments
            slope = slopes[k] - ridge * w
            moment[k] = 0.9 * moment[k] + 0.1 * slope
            scale[k] = 0.99 * scale[k] + 0.01 * slope**2
            w += rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(scale[k] / (1 - 0.99**step)) + 1e-8)
    return field


def learn(docs: DataFrame, text: str = "text", sample: int = 200, examples: int = 1500) -> Field:
    """A field learned from `examples` windows, among words from the beginnings (2,000 characters) of at most `sample` texts that a hash of the text draws."""
    rows = docs.where(F.col(text).isNotNull()).select(F.substring(F.col(text), 1, 2000).alias("_t"), F.xxhash64(F.lit("pii"), text).alias("_h"))
    share = min(1.0, 8 * sample / max(rows.count(), 1))  # thinned where it lies, so that tasks do not each send a sample
    drawn = rows.where(F.pmod("_h", F.lit(1 << 30)) <= int(share * (1 << 30))).dropDuplicates(["_h"])
    words = sorted({w for x in drawn.orderBy("_h", "_t").limit(sample).collect() for w in re.findall(r"[^\W\d_]{2,12}", x["_t"])})
    return fit(windows(words or ["name"], examples))


SPANS = "array<struct<kind: string, start: long, end: long, fixed: boolean, score: double>>"


def find(docs: DataFrame, field: Field, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and spans of every row (kind, start, end, whether by a fixed pattern, and the field's score where not), by kind and start; no shuffle."""
    rows = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("fixed", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch, "_text"):
                made = [[{"kind": KINDS[k], "start": s, "end": e, "fixed": fixed, "score": v} for k, s, e, fixed, v in spans] for spans in spans_of(texts, shared.value)]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(first, len(texts)), pa.array(made, kind)], names=["_id", "spans"])

    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, spans {SPANS}").withColumnRenamed("_id", id)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: numbers and digest of the fixed patterns' spans, and all spans written out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find(docs, learn(docs))
    fixed = F.filter("spans", lambda s: s["fixed"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["fixed"] & (s["kind"] == k))).cast("long")

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(written(fixed), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
