"""Secret scan: three plain patterns, and a password guess-cost program for values in a credential context."""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_tables, id_text, slices

#: The plain patterns, in the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")
#: What stands before a credential value: a credential word, then a separator or "is", then perhaps a quote.
CONTEXT = re.compile(r"""(?:password|passwd|passphrase|pwd|secret|token|api[_ -]?key|credentials?|bearer)["']?(?:\x20*[:=]\x20*|\x20+is\x20+|\x20+)["'`]?""", re.ASCII | re.IGNORECASE)
#: Where a value ends: at a quote, angle bracket, comma, semicolon, or anything but visible ASCII.
STOP = re.compile(r"""["'`<>,;]|[^!-~]""")
HINTS = ("passw", "passp", "pwd", "secret", "token", "api", "credential", "bearer")
#: Common words of passwords, the likeliest first.
WORDS = """password qwerty admin welcome login letmein monkey dragon master secret shadow sunshine princess football baseball superman iloveyou
trustno hello freedom whatever test guest user root default changeme example sample token access system server database company summer winter spring
autumn monday friday january love money flower orange banana computer internet samsung google server pass word""".split()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
LONGEST_WORD = max(map(len, WORDS))
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
NEXT = {(a, b) for row in ROWS for a, b in [*zip(row, row[1:], strict=False), *zip(row[1:], row, strict=False)]} | {
    p for up, down in zip(ROWS, ROWS[1:], strict=False) for i, c in enumerate(down) for q in (i, i + 1) if q < len(up) for p in ((c, up[q]), (up[q], c))}
DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d)$")
LEET = str.maketrans("@4301$5!7", "aaeoissit")
LEAST_COST = 10.0


#: Longest word, date, and unit of a repeat; repeats and walks of any length count.
WINDOW = 24


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.islower() else 26 if c.isupper() else 33)


class Guesses:
    """The spans of a value and what they cost, each by log10 of its own guesses.

    A word: its rank, times two for capitals and two for swapped characters; a date: days of 100 years, or years; a repeat: the cost of its unit, times its count (the last one may be cut short); a walk: 40
    starts, times its length, times 1.6 for each turn. Runs of a unit and of neighbouring keys come from tables, so that a repeat or walk is known to its full length.
    """

    def __init__(self, value: str):
        self.value, self.n, self.low = value, len(value), value.lower()
        self.plain = self.low.translate(LEET)
        self.single = [_alphabet(c) for c in value]
        n, low = self.n, self.low
        #: walk_to[i]: end of the walk from i; turns[i]: turns before place i.
        self.walk_to, self.turns = [n] * n, [0] * (n + 1)
        for i in range(n - 2, -1, -1):
            self.walk_to[i] = self.walk_to[i + 1] if (low[i], low[i + 1]) in NEXT else i + 1
        for i in range(1, n):
            self.turns[i + 1] = self.turns[i] + (i + 1 < n and ord(low[i + 1]) - ord(low[i]) != ord(low[i]) - ord(low[i - 1]))
        #: same[u][i]: characters from i that equal the one u later.
        self.same: dict[int, list[int]] = {}
        code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for u in range(1, min(WINDOW, n // 2) + 1):
            differ = np.flatnonzero(code[:-u] != code[u:])
            stop = np.append(differ, n - u)
            run = stop[np.searchsorted(stop, np.arange(n - u))] - np.arange(n - u)
            if (run >= u).any():
                self.same[u] = run.tolist()

    def spans(self, i: int) -> Iterator[tuple[int, float]]:
        """(end, cost) of the words, dates, repeats and walks from i. Of repeats and walks, those within the window and the full run."""
        value, low, plain, n = self.value, self.low, self.plain, self.n
        for e in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            if (part := plain[i:e]) in RANK:
                yield e, math.log10(RANK[part] + 1) + (0.3 if value[i:e] != low[i:e] else 0) + (0.3 if part != low[i:e] else 0)
        if value[i].isdigit():
            for e in range(i + 3, min(n, i + 10) + 1):
                if DATE.match(value, i, e):
                    yield e, 2.0 if e - i <= 4 else math.log10(36_500) + (0.5 if e - i > 8 else 0)
        for u, same in self.same.items():
            if i < len(same) and same[i] >= u:
                unit, end = _unit_cost(value[i:i + u]), i + u + same[i]
                for e in {*range(i + max(3, 2 * u), min(end, i + WINDOW) + 1), end}:
                    if e - i > 2:
                        yield e, unit + math.log10(-(-(e - i) // u))
        if (end := self.walk_to[i]) - i > 2:
            for e in {*range(i + 3, min(end, i + WINDOW) + 1), end}:
                yield e, math.log10(40) + math.log10(e - i) + 0.2 * (self.turns[e - 1] - self.turns[i + 1])


@functools.lru_cache(10_000)
def _unit_cost(unit: str) -> float:
    """A repeat's unit is itself made of words, dates, walks and shorter repeats."""
    return guess_cost(unit)


def guess_cost(value: str, enough: float = math.inf) -> float:
    """log10 of the guesses for the cheapest segmentation of a value into words, dates, repeats, keyboard walks (see `Guesses`) and single guessed characters. Every
    span but one at the start costs another log10(2). Infinite as soon as every way to reach or pass a place, and so any longer value, costs `enough` or more."""
    g, n = Guesses(value), len(value)
    best = [0.0] + [math.inf] * n
    far: list[tuple[int, float]] = []
    for i in range(n):
        here = best[i]
        if here >= enough and min(best[i:i + WINDOW + 1]) >= enough and all(c >= enough for e, c in far if e > i):
            return math.inf
        if here < math.inf:
            best[i + 1] = min(best[i + 1], here + g.single[i])
            for e, cost in g.spans(i):
                total = here + cost + (0.3 if i else 0)
                if total < best[e]:
                    best[e] = total
                    if e > i + WINDOW:
                        far.append((e, total))
    return best[n]


def suffix_costs(value: str) -> list[float]:
    """guess_cost of value[i:] for every i, in one pass from the end."""
    g, n = Guesses(value), len(value)
    best, out = [0.0] * (n + 1), [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        single = g.single[i] + best[i + 1]
        span = min((cost + best[e] for e, cost in g.spans(i)), default=math.inf)
        out[i], best[i] = min(single, span), min(single, span + 0.3)
    return out


def _kinds(value: str) -> int:
    return sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search("[^A-Za-z0-9]", value[1:-1]))))


def _secrets(text: str, run: list[tuple[int, int]]) -> list[bool]:
    """Whether each value text[a:b] of an unbroken run (all end at b) has two kinds of characters and a guess cost of LEAST_COST or more. Of a long value, no more is read
    than decides; a run with many contexts is judged in one pass from its end."""
    start, end = run[0]
    costs = suffix_costs(text[start:end]) if len(run) > 4 and end - start > 100 else None
    out = []
    for a, b in run:
        if _kinds(text[a:min(b, a + 200)]) < 2 and _kinds(text[a:b]) < 2:
            out.append(False)
        elif costs is None and b - a > 2000 and guess_cost(text[a:a + 1000], LEAST_COST) < math.inf:
            costs = suffix_costs(text[start:end])
            out.append(costs[a - start] >= LEAST_COST)
        else:
            out.append((costs[a - start] if costs else guess_cost(text[a:min(b, a + 2000)], LEAST_COST)) >= LEAST_COST)
    return out


def _values(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the values in a credential context, by start. Each context has its value, also one that stands in the value of another.
    Closing punctuation is no part of them."""
    end = 0
    for m in CONTEXT.finditer(text):
        a = m.end()
        if a >= end:
            end = m.start() if (m := STOP.search(text, a)) else len(text)
        b = end
        while b > a and text[b - 1] in ".!?:)]}":
            b -= 1
        if b - a >= 6:
            yield a, b


def find(text: str, tails: bool = False) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start, then in the order of KINDS.

    assign: the whole match, if its value has 6 characters or more; access: 20 or more; hex: 24 or more. guess: a value in a credential context that lies
    in none of the other spans (it may overlap them), of 6 visible ASCII characters or more, with two kinds of characters or more (lower, upper, digit,
    other), whose guess cost is at least 10 (ten thousand million guesses). Closing punctuation is no part of it. With `tails`, a value of any cost that
    starts in one of the other spans and ends after it is a guess span too: it is the rest of what that span holds for a secret.
    """
    spans: list[tuple[int, int, int]] = []
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    if hinted:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if hinted:
        base, i, reach = sorted(spans), 0, 0
        for _, run in itertools.groupby(_values(text), key=lambda v: v[1]):
            open_ = []
            for a, b in run:
                while i < len(base) and base[i][0] <= a:
                    reach = max(reach, base[i][2])
                    i += 1
                if b > reach:
                    open_.append((a, b, tails and a < reach))
            judged = _secrets(text, [(a, b) for a, b, _ in open_]) if any(not sure for _, _, sure in open_) else [True] * len(open_)
            spans += [(a, 3, b) for (a, b, sure), guessed in zip(open_, judged, strict=True) if sure or guessed]
    return [(KINDS[k], s, e) for s, k, e in sorted(spans)]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans. A null text counts as empty (no span); repeated rows give
    repeated rows. Row-wise, whole texts, no shuffle."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_tables()
        for frame in frames:
            for some in slices(frame):
                rows = []
                for doc_id, text in zip(some["doc_id"], some["text"], strict=True):
                    spans = find(text)
                    base = [s for s in spans if s[0] != "guess"]
                    n = [sum(s[0] == k for s in spans) for k in KINDS]
                    rows.append((doc_id, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
                yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]).astype({"doc_id": "Int64"})

    return id_text(docs).mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents, all columns kept, with each secret span (overlapping ones as one, to the end of the value) replaced by `mark`; n_chars, where it is a column, follows the new text.
    Null texts stay null."""
    def hide(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for _, s, e in find(text, tails=True):
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]]) if out else text

    @F.pandas_udf("string")
    def hidden(texts: pd.Series) -> pd.Series:
        forget_tables()
        return texts.map(hide, na_action="ignore")

    out = docs.withColumn("text", hidden("text"))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
