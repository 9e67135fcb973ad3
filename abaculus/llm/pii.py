"""Personal data: pattern rules, plus candidates that boosted trees accept.

The base rules (email, ip, card, phone) always count. Beside them, high-recall
generators propose overlapping candidates: spelled-out addresses, keys and
passwords, hexadecimal and mixed tokens, account numbers, loose digit groups.
Gradient-boosted trees score each candidate from its form and its context; the
scores are calibrated on rows the trees did not see, and per kind the lowest
threshold with the wanted precision there selects redactions. Accepted
candidates that overlap a base span or a better candidate are dropped.

The trees learn from generated examples (fixed seed), so a query needs no
labels; other labelled candidates may be given to ``train``.

Defined results: null counts as empty; texts without candidates have empty span
lists; kinds without an accepted threshold add nothing; repeated rows give equal
rows; extra columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abaculus.llm.shared import prepare_workers


BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "account")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outward: linear even in long runs of letters."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base rules' spans, by kind and start; matches that fail their test are dropped."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if p.lstrip("0") else "0") <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


#: High-recall generators of further candidates: kind, what may hold one, and the group that is its span.
GENERATORS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.)[A-Za-z]{2,}+)+")),
    ("secret", re.compile(r"(?i:token|secret|password|passwd|pwd|api[_-]?key|key|auth)\"? ?[=:] ?[\"']?([^\s\"']{8,})")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])[A-Z]{4}[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])[0-9a-f]{16,}+(?![A-Za-z0-9])")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("account", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9-])")),
)
HEX = 3  # the generator of hexadecimal keys, which need a digit
CONTEXT = 24
HINTS = tuple(re.compile(p, re.I) for p in (r"mail|contact", r"tel|phone|call|fax|mobile", r"token|secret|passw|pwd|key|auth|credential", r"iban|account|ssn|social", r"price|\$|€|total|page|version|isbn|id\b|no\."))


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, generator), overlapping."""
    return [(kind, *m.span(1 if p.groups else 0), g) for g, (kind, p) in enumerate(GENERATORS) for m in p.finditer(text) if g != HEX or not m[0].isalpha()]


def remainder97(digits: str) -> int:
    """The number modulo 97, in pieces: linear, and without int()'s limit on digits."""
    rest = 0
    for i in range(0, len(digits), 1000):
        piece = digits[i : i + 1000]
        rest = (rest * pow(10, len(piece), 97) + int(piece)) % 97
    return rest


def features(text: str, start: int, end: int, generator: int) -> list[float]:
    """Form of the span and of what stands around it."""
    s, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + 8]
    n, counts = max(1, len(s)), Counter(s)
    digits = digits_of(s)
    iban = s.replace(" ", "").upper()
    mod97 = iban[:2].isalpha() and iban.isascii() and iban.isalnum() and remainder97("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) == 1
    return [
        generator,
        n,
        len(digits) / n,
        sum(map(str.isupper, s)) / n,
        sum(map(str.islower, s)) / n,
        sum(c in "0123456789abcdefABCDEF" for c in s) / n,
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        len(counts),
        sum(not c.isalnum() for c in s),
        sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:])) / n,
        float(bool(digits) and luhn(digits)),
        float(mod97),
        float(s.isalpha()),
        *[float(bool(h.search(before))) for h in HINTS],
        float(before[-1:] in "=:\"'"),
        float(after[:1].isalnum()),
    ]


class Trees:
    """Gradient-boosted regression trees for log-odds, as arrays; each tree has depth ``DEPTH``."""

    DEPTH = 3

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, least: int = 5):
        grid = [np.unique(np.quantile(c, np.linspace(0.03, 0.97, 16))) for c in x.T]
        score, self.bias = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        self.feature, self.cut, self.value = [], [], []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p) + 1e-6
            feature, cut = np.zeros(2**self.DEPTH - 1, int), np.full(2**self.DEPTH - 1, np.inf)
            leaf = np.zeros(len(y), int)
            for depth in range(self.DEPTH):
                for node in range(2**depth):
                    rows, best = np.flatnonzero(leaf == node), 1e-6
                    if len(rows) < 2 * least:
                        continue
                    g, h, whole = grad[rows], hess[rows], grad[rows].sum() ** 2 / (hess[rows].sum() + 1)
                    for f, cuts in enumerate(grid):
                        right = x[rows, f][None] > cuts[:, None]
                        gr, hr, nr = right @ g, right @ h, right.sum(1)
                        gain = gr**2 / (hr + 1) + (g.sum() - gr) ** 2 / (h.sum() - hr + 1) - whole
                        gain[(nr < least) | (len(rows) - nr < least)] = 0
                        if gain.max(initial=0) > best:
                            best, k = gain.max(), int(gain.argmax())
                            feature[2**depth - 1 + node], cut[2**depth - 1 + node] = f, cuts[k]
                leaf = 2 * leaf + (x[np.arange(len(y)), feature[2**depth - 1 + leaf]] > cut[2**depth - 1 + leaf])
            value = rate * np.bincount(leaf, grad, 2**self.DEPTH) / (np.bincount(leaf, hess, 2**self.DEPTH) + 1)
            score = score + value[leaf]
            self.feature.append(feature), self.cut.append(cut), self.value.append(value)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            leaf = np.zeros(len(x), int)
            for depth in range(self.DEPTH):
                node = 2**depth - 1 + leaf
                leaf = 2 * leaf + (x[rows, feature[node]] > cut[node])
            out += value[leaf]
        return out


class Redactor:
    """Trees, their calibration (slope and intercept of a logistic curve) and a threshold per kind."""

    def __init__(self, trees: Trees, slope: float, intercept: float, thresholds: dict[str, float]):
        self.trees, self.slope, self.intercept, self.thresholds = trees, slope, intercept, thresholds

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.scores(x) + self.intercept)))

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and the spans added by the trees."""
        base, found = base_spans(text), candidates(text)
        if not found:
            return base, []
        p = self.probability(np.array([features(text, a, b, g) for _, a, b, g in found]))
        starts, ends, added = [], [], []  # what is taken, as disjoint spans in order
        for a, b in sorted((a, b) for _, a, b in base):
            if ends and a < ends[-1]:
                ends[-1] = max(b, ends[-1])
            else:
                starts.append(a), ends.append(b)
        for i in np.argsort(-p, kind="stable"):
            kind, a, b, _ = found[i]
            at = bisect_right(ends, a)  # the first taken span that ends behind the beginning
            if p[i] >= self.thresholds.get(kind, 2.0) and (at == len(starts) or b <= starts[at]):
                starts.insert(at, a), ends.insert(at, b)
                added.append((kind, a, b))
        return base, added


def examples(n: int = 3000, seed: int = 7) -> list[tuple[str, int, int, int, str, int]]:
    """Generated candidates: (text, start, end, generator, kind, whether it is personal data)."""
    r = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(r.choice(list(chars), k))
    low, hexa, dig, up = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: pick(low, r.integers(2, 10))

    def iban(valid: bool) -> str:
        country, body = pick(up, 2), pick(dig, int(r.integers(12, 25)))
        rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{(98 - rest if valid else (98 - rest) % 97 + 1) % 100:02d}{body}"

    good = (
        lambda: f"{word()}.{word()} (at) {word()} (dot) com",
        lambda: f"{word()} [at] {word()} [dot] {pick(low, 3)}",
        lambda: f'{r.choice(["token", "secret", "api_key", "key"])} = "{pick(hexa, int(r.choice([32, 40, 64])))}"',
        lambda: f"password={pick(hexa, int(r.integers(12, 24)))}",
        lambda: f"password: {pick(low + up + dig + '!#%', int(r.integers(10, 20)))}",
        lambda: "AKIA" + pick(up + dig, 16),
        lambda: f"auth key {pick(hexa, 40)}",
        lambda: f"IBAN {iban(True)}",
        lambda: iban(True),
        lambda: f"SSN {pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}",
        lambda: f"call ({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}",
        lambda: f"tel: {pick(dig, 3)} {pick(dig, 3)} {pick(dig, 4)}",
    )
    bad = (
        lambda: f"{word()} at {word()} dot {word()}",
        lambda: f"{word()} at {word()}.{word()[:3].title()}",
        lambda: f"key: {word()}{word()}",
        lambda: f"token = {word()}_{word()}{word()}",
        lambda: f"the password: {word()}{word()}",
        lambda: pick(up, 20),
        lambda: pick(dig, int(r.integers(16, 30))),
        lambda: f"id {pick(dig, 18)}",
        lambda: iban(False),
        lambda: f"total {pick(dig, 3)} {pick(dig, 3)} {pick(dig, 3)}",
        lambda: f"page {pick(dig, 2)}-{pick(dig, 3)}-{pick(dig, 4)}",
        lambda: f"no. {pick(dig, 3)}-{pick(dig, 2)}-{pick(dig, 4)}",
        lambda: f"price {pick(dig, 2)}.{pick(dig, 3)}.{pick(dig, 3)}",
    )
    out = []
    for i in range(n):
        makers, label = (good, 1) if i % 2 else (bad, 0)
        text = " ".join(word() for _ in range(r.integers(0, 6))) + " " + makers[r.integers(len(makers))]() + " " + " ".join(word() for _ in range(r.integers(0, 4)))
        out += [(text, a, b, g, kind, label) for kind, a, b, g in candidates(text)]
    return out


def train(rows: list[tuple[str, int, int, int, str, int]] | None = None, precision: float = 0.98) -> Redactor:
    """Fit trees on two thirds of the labelled candidates; calibrate and set thresholds on the rest."""
    rows = examples() if rows is None else rows
    x, y = np.array([features(t, a, b, g) for t, a, b, g, _, _ in rows]), np.array([r[5] for r in rows], float)
    kinds, held = np.array([r[4] for r in rows]), np.arange(len(rows)) % 3 == 2
    trees = Trees(x[~held], y[~held])
    s, slope, intercept = trees.scores(x[held]), 1.0, 0.0
    for _ in range(50):  # Newton steps of the calibration curve, slightly regularised
        p = 1 / (1 + np.exp(-(slope * s + intercept)))
        w, d = p * (1 - p) + 1e-6, p - y[held]
        hess = np.array([[(w * s * s).sum() + 1, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
        slope, intercept = np.array([slope, intercept]) - np.linalg.solve(hess, [(d * s).sum() + slope - 1, d.sum()])
    p, thresholds = 1 / (1 + np.exp(-(slope * s + intercept))), {}
    for kind in KINDS:
        own = kinds[held] == kind
        for t in np.unique(np.r_[0.8, p[own][p[own] >= 0.8]]):
            chosen = own & (p >= t)
            if chosen.sum() >= 10 and y[held][chosen].mean() >= precision:
                thresholds[kind] = float(t)
                break
    return Redactor(trees, float(slope), float(intercept), thresholds)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the union is replaced once."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, redactor: Redactor | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, counts of base spans, their SHA-256, all spans, the number added, and on request the redacted text."""
    prepare_workers(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(redactor or train())
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "redacted"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                base, added = model.value.spans(text)
                counts = Counter(k for k, _, _ in base)
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((doc_id, *(counts[k] for k in BASE), digest, joined(base + added), len(added), redacted(text, base + added) if with_text else None))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string")
    return found if with_text else found.drop("redacted")
