"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns (``base_spans``) give e-mail addresses, IP addresses, card and
phone numbers.  The field reads windows of tokens around digits and ``@``: a
segment of up to ``MAX_SEGMENT`` tokens gets whole-span features (digit and
letter counts, checksum, address shape, what stands before, whether it cuts a
longer run), a segmentation is scored by its segments and label transitions,
and bounded-entity dynamic programming picks boundaries and kinds together.
Segments it finds beside the patterns' spans are added; base spans stay.

``fit`` trains by conditional likelihood (forward-backward over segments) on
windows of at most ``max_texts`` texts (those with the smallest hash among
texts with a trigger).  Training spans are the patterns' spans, and secrets
named by a key word and an assignment.

Defined results: null and empty texts have no spans.  Texts are read whole;
windows have no size limit, segments have one.  Offsets are code points, end
exclusive.  Without training windows nothing is added to the base.  Repeated
rows give equal results; other columns pass through, the result columns
replace columns of the same names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import bounded_batches

KINDS = ("email", "ip", "card", "phone", "secret")
MAX_SEGMENT = 16
MAX_TEXTS = 500
_CONTEXT = 4
EPOCHS = 8

# ---------------------------------------------------------------- base spans

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number never starts inside a run of digits: where the run's first digit
# fails, all its digits fail.  This keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with the whole run before it: the leftmost match has no
    other start, and no run is scanned twice."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _byte(part: str) -> bool:
    """Whether digits, of which any number may be leading zeros, are 255 at most."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), by start, then kind."""
    out = [(s, e, 0) for s, e in _emails(text)]
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(_byte(p) for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda x: (x[0], x[2]))
    return out


# ------------------------------------------------------- windows, segments

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_TRIGGER = re.compile(r"[0-9@]")
_KEY = re.compile(r"(?i)(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?$")
_SILVER = re.compile(r"(?i)(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?"
                     r"([a-z0-9]{12,})(?![a-z0-9])")
_NUMBERLIKE = re.compile(r"[+(]?[0-9][0-9 ().-]*")
_EMAILLIKE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IPLIKE = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token offsets around triggers: a trigger token with ``_CONTEXT`` tokens
    on either side; windows that touch are one."""
    if not _TRIGGER.search(text):
        return
    current: list[tuple[int, int]] = []
    recent: list[tuple[int, int]] = []
    left = 0
    for m in _TOKEN.finditer(text):
        token = m.span()
        if _TRIGGER.search(text, *token):
            if not current:
                current = recent[-_CONTEXT:]
            current.append(token)
            left = 2 * _CONTEXT
        elif current:
            current.append(token)
            left -= 1
            if not left:
                yield current
                recent, current = current[-_CONTEXT:], []
        if not current:
            recent.append(token)
            if len(recent) > 64:
                del recent[:-_CONTEXT]
    if current:
        yield current


def segments_from(text: str, tokens: list[tuple[int, int]], i: int) -> Iterator[int]:
    """Ends (last token + 1) of the candidate segments that start at token
    ``i``: they hold a trigger, start and end with a letter, digit or ``+``,
    and only number-like ones cross a blank."""
    s = tokens[i][0]
    if not (text[s].isalnum() or text[s] in "+("):
        return
    trigger = letters = blank = False
    for j in range(i, min(i + MAX_SEGMENT, len(tokens))):
        a, b = tokens[j]
        if j > i and a != tokens[j - 1][1]:
            if text[tokens[j - 1][1]:a] != " " or letters:
                return
            blank = True
        token = text[a:b]
        if any(c.isalpha() for c in token):
            letters = True
            if blank:
                return
        trigger = trigger or _TRIGGER.search(token) is not None
        if trigger and token[-1].isalnum():
            yield j + 1


def segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidate segments (first token, last token + 1)."""
    return [(i, j) for i in range(len(tokens)) for j in segments_from(text, tokens, i)]


#: Feature numbers: groups of one-of-many values.
_DIGIT_STEPS = (0, 1, 4, 7, 9, 12, 13, 16, 17, 20)
_LETTER_STEPS = (0, 1, 4, 12, 24)
_FLAGS = 16
FEATURES = 1 + len(_DIGIT_STEPS) + len(_LETTER_STEPS) + _FLAGS
_OUTSIDE = 4        # features of an outside token: bias, trigger, letter, other


def span_features(text: str, start: int, end: int) -> list[int]:
    s = text[start:end]
    digits = _digits(s)
    letters = sum(c.isalpha() for c in s)
    before, after = text[start - 1:start], text[end:end + 1]
    numberlike = _NUMBERLIKE.fullmatch(s) is not None
    out = [0,
           1 + sum(len(digits) >= x for x in _DIGIT_STEPS[1:]),
           1 + len(_DIGIT_STEPS) + sum(letters >= x for x in _LETTER_STEPS[1:])]
    at = 1 + len(_DIGIT_STEPS) + len(_LETTER_STEPS)
    flags = (
        "@" in s,
        _EMAILLIKE.fullmatch(s) is not None,
        _IPLIKE.fullmatch(s) is not None,
        _IPLIKE.fullmatch(s) is not None and all(int(p) <= 255 for p in s.split(".")),
        numberlike,
        numberlike and 12 <= len(digits) <= 19 and luhn(digits),
        s[0] == "+" and 9 <= len(digits) <= 15,
        s[0] == "+",
        s.isalnum() and len(digits) >= 4 and letters >= 4 and len(s) >= 16,
        _KEY.search(text[max(0, start - 40):start]) is not None,
        before.isalnum() or before in ("+", "@", "%", "_") and before != "",
        after.isalnum() or after in ("@", "_") and after != "",
        after in (".", "-", " ") and after != "" and text[end + 1:end + 2].isdigit(),
        before in (".", "-", " ") and before != "" and start >= 2 and text[start - 2].isdigit(),
        " " in s,
        s.isalnum() and not letters,
    )
    out += [at + k for k, f in enumerate(flags) if f]
    return out


class Window:
    """A window's tokens, candidate segments and their feature rows."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.tokens = tokens
        n = len(tokens)
        self.spans = segments(text, tokens)
        self.phi = np.zeros((len(self.spans), FEATURES))
        for r, (i, j) in enumerate(self.spans):
            self.phi[r, span_features(text, tokens[i][0], tokens[j - 1][1])] = 1
        self.outside = np.zeros((n, _OUTSIDE))
        self.outside[:, 0] = 1
        for r, (a, b) in enumerate(tokens):
            token = text[a:b]
            self.outside[r, 1 if _TRIGGER.search(token) else 2 if token.isalpha() else 3] = 1
        self.ending: list[list[int]] = [[] for _ in range(n + 1)]
        for r, (_, j) in enumerate(self.spans):
            self.ending[j].append(r)


class Field:
    """Weights: whole-span features per kind, outside tokens, transitions.
    State 0 is outside, state k the kind k - 1."""

    def __init__(self):
        self.span = np.zeros((FEATURES, len(KINDS)))
        self.out = np.zeros(_OUTSIDE)
        self.step = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def scores(self, w: Window):
        return w.phi @ self.span, w.outside @ self.out

    def decode(self, w: Window) -> list[tuple[int, int, int]]:
        """Best segmentation: (first token, last token + 1, kind)."""
        span, out = self.scores(w)
        n, states = len(w.tokens), len(KINDS) + 1
        best = np.full((n + 1, states), -np.inf)
        best[0, 0] = 0
        into = np.empty((n + 1, states))     # best before, with the transition
        back: list[list] = [[None] * states for _ in range(n + 1)]
        came = np.zeros((n + 1, states), int)
        for j in range(n + 1):
            if j:
                best[j, 0] = into[j - 1, 0] + out[j - 1]
                back[j][0] = j - 1
                for r in w.ending[j]:
                    i = w.spans[r][0]
                    here = into[i, 1:] + span[r]
                    for k in np.flatnonzero(here > best[j, 1:]):
                        best[j, k + 1] = here[k]
                        back[j][k + 1] = i
            reach = best[j][:, None] + self.step
            came[j] = reach.argmax(axis=0)
            into[j] = reach.max(axis=0)
        found, j, state = [], n, int(best[n].argmax())
        while j:
            i = back[j][state]
            if state:
                found.append((i, j, state - 1))
            j, state = i, int(came[i][state])
        return found[::-1]

    def segment(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """What ``decode`` finds, for windows of any length: segments are made
        where they start, scored, and forgotten; of the scores only those of
        the next ``MAX_SEGMENT`` tokens are kept, of the past a few bytes a
        token."""
        n, states = len(tokens), len(KINDS) + 1
        band = MAX_SEGMENT + 1
        best = np.full((band, states), -np.inf)              # of token ends, round and round
        best[0, 0] = 0
        length = np.zeros((n + 1, states), np.uint8)         # tokens of the segment that ends here
        came = np.zeros((n + 1, states), np.uint8)
        for i in range(n + 1):
            here = best[i % band]
            reach = here[:, None] + self.step
            came[i] = reach.argmax(axis=0)
            into = reach.max(axis=0)
            if i == n:
                break
            best[i % band] = -np.inf                         # from now on the place of i + band
            a, b = tokens[i]
            token = text[a:b]
            outside = into[0] + self.out[0] + self.out[1 if _TRIGGER.search(token) else 2 if token.isalpha() else 3]
            after = best[(i + 1) % band]
            if outside > after[0]:
                after[0], length[i + 1, 0] = outside, 1
            for j in segments_from(text, tokens, i):
                score = into[1:] + self.span[span_features(text, a, tokens[j - 1][1])].sum(axis=0)
                row = best[j % band]
                for k in np.flatnonzero(score > row[1:]):
                    row[k + 1], length[j, k + 1] = score[k], j - i
        found, j, state = [], n, int(best[n % band].argmax())
        while j:
            i = j - int(length[j, state])
            if state:
                found.append((i, j, state - 1))
            j, state = i, int(came[i][state])
        return found[::-1]

    def learn(self, w: Window, gold: dict[int, int], grad: dict[str, np.ndarray]) -> None:
        """Add the gradient of the log-likelihood: observed minus expected.
        ``gold``: segment number -> kind."""
        span, out = self.scores(w)
        n, states = len(w.tokens), len(KINDS) + 1
        alpha = np.full((n + 1, states), -np.inf)
        alpha[0, 0] = 0
        into = np.empty((n + 1, states))
        for j in range(n + 1):
            if j:
                alpha[j, 0] = into[j - 1, 0] + out[j - 1]
                if w.ending[j]:
                    alpha[j, 1:] = np.logaddexp.reduce([into[w.spans[r][0], 1:] + span[r] for r in w.ending[j]])
            into[j] = np.logaddexp.reduce(alpha[j][:, None] + self.step)
        total = np.logaddexp.reduce(alpha[n])
        beta = np.full((n + 1, states), -np.inf)
        beta[n] = 0
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for r, (i, _) in enumerate(w.spans):
            starting[i].append(r)
        p_out, p_span = np.zeros(n), np.zeros((len(w.spans), len(KINDS)))
        for i in range(n - 1, -1, -1):
            leave = np.full(states, -np.inf)
            leave[0] = out[i] + beta[i + 1, 0]
            p_out[i] = np.exp(into[i, 0] + leave[0] - total)
            if starting[i]:
                ways = [span[r] + beta[w.spans[r][1], 1:] for r in starting[i]]
                leave[1:] = np.logaddexp.reduce(ways)
                for r, way in zip(starting[i], ways, strict=True):
                    p_span[r] = np.exp(into[i, 1:] + way - total)
            grad["step"] -= np.exp(alpha[i][:, None] + self.step + leave - total)
            beta[i] = np.logaddexp.reduce(self.step + leave, axis=1)
        grad["out"] -= w.outside.T @ p_out
        grad["span"] -= w.phi.T @ p_span
        starts = {w.spans[r][0]: (r, k) for r, k in gold.items()}
        at = state = 0
        while at < n:
            if at in starts:
                r, k = starts[at]
                grad["span"][:, k] += w.phi[r]
                grad["step"][state, k + 1] += 1
                at, state = w.spans[r][1], k + 1
            else:
                grad["out"] += w.outside[at]
                grad["step"][state, 0] += 1
                at, state = at + 1, 0


def silver(text: str) -> list[tuple[int, int, int]]:
    """Training spans: the patterns' and assigned secrets; the longest of
    overlapping ones."""
    spans = base_spans(text) + [(m.start(1), m.end(1), 4) for m in _SILVER.finditer(text)]
    kept: list[tuple[int, int, int]] = []
    for s in sorted(spans, key=lambda x: (x[0] - x[1], x)):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return kept


def train(texts: list[str]) -> Field | None:
    """A field from short texts, or None without a window."""
    cases = []
    for text in texts:
        gold = {(a, b): k for a, b, k in silver(text)}
        for tokens in windows(text):
            w = Window(text, tokens)
            own = {r: gold[key] for r, (i, j) in enumerate(w.spans)
                   if (key := (tokens[i][0], tokens[j - 1][1])) in gold}
            cases.append((w, own))
    if not cases:
        return None
    field = Field()
    squares = {"span": 1e-6, "out": 1e-6, "step": 1e-6}
    order = np.random.default_rng(5)
    for _ in range(EPOCHS):
        shuffled = order.permutation(len(cases))
        for lo in range(0, len(shuffled), 16):
            part = shuffled[lo:lo + 16]
            grad = {k: -0.002 * len(part) * getattr(field, k) for k in squares}
            for c in part:
                field.learn(*cases[c], grad)
            for k, g in grad.items():
                squares[k] = squares[k] + g * g
                setattr(field, k, getattr(field, k) + 0.5 * g / np.sqrt(squares[k]))
    return field


# ------------------------------------------------------------------- Spark

#: Most characters of one training window.
_WINDOW_CHARS = 4000


def fit(df: DataFrame, text_col: str = "text", max_texts: int = MAX_TEXTS) -> Field | None:
    """Train on windows of ``max_texts`` texts that hold a trigger."""
    texts = bounded_batches(df).select(F.col(text_col).alias("t")).where(F.col("t").rlike("[0-9@]"))
    marks = texts.select(F.xxhash64("t").alias("h")).distinct().orderBy("h").limit(max_texts).collect()
    if not marks:
        return None

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["t"]:
                for tokens in windows(t):
                    a, z = max(0, tokens[0][0] - 40), tokens[-1][1] + 2
                    if z - a <= _WINDOW_CHARS:
                        out.append(t[a:z])
                        break
            yield pd.DataFrame({"w": out})

    got = (texts.where(F.xxhash64("t") <= marks[-1][0]).mapInPandas(cut, "w string").distinct()
           .orderBy(F.xxhash64("w"), "w").limit(max_texts).collect())
    return train([r[0] for r in got])


def find(text: str, field: Field | None) -> list[tuple[int, int, int, bool]]:
    """All spans of a text: (start, end, kind number, base)."""
    base = base_spans(text)
    spans = [(a, b, k, True) for a, b, k in base]
    if field is not None:
        for tokens in windows(text):
            for i, j, k in field.segment(text, tokens):
                a, b = tokens[i][0], tokens[j - 1][1]
                if all(b <= x[0] or a >= x[1] for x in base):
                    spans.append((a, b, k, False))
    return sorted(spans, key=lambda x: (x[0], x[2]))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def detect(df: DataFrame, field: Field | None, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``df`` with the spans of every whole text."""
    shared = bounded_batches(df).sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b, "base": base}
                              for a, b, k, base in find(t, shared.value)] for t in texts], dtype=object)

    # most texts hold no trigger and never leave the JVM
    text = F.when(F.col(text_col).rlike("[0-9@]"), F.col(text_col)).otherwise("")
    return df.withColumn(out, spans(F.coalesce(text, F.lit(""))))


def digest(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, field: Field | None, text_col: str = "text") -> DataFrame:
    """``df`` with every span replaced by its kind in angle brackets."""
    shared = bounded_batches(df).sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                parts, at = [], 0
                for a, b, k, _ in find(t, shared.value) if t else ():
                    if a >= at:
                        parts += [t[at:a], f"<{KINDS[k].upper()}>"]
                    at = max(at, b)
                out.append("".join([*parts, t[at:]]) if t is not None else None)
            yield pd.Series(out, dtype=object)

    text = F.col(text_col)
    return df.withColumn(text_col, F.when(text.rlike("[0-9@]"), masked(F.when(text.rlike("[0-9@]"), text))).otherwise(text))
