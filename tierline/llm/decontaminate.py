"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared lower-cased, with every run of characters other
than letters and digits as one blank.  An item of m characters may occur with
up to ``floor(m * ERROR_RATE)`` edits.  It is cut into one piece more than
that: an occurrence within the budget leaves at least one piece untouched.
Exact piece hits come from one automaton over the pieces of all items; each
hit's neighbourhood is verified with Myers' bit-parallel edit distance.

The items are a query set that meets all texts in blocks of at most
``BLOCK_BYTES`` of item text (checked, not assumed); a block is one pass over
the texts, and no text leaves its task.

Defined results: null and empty texts hold nothing; items without a letter or
digit match nothing; an item that occurs several times in a text is reported
once, with its smallest distance and the end of the first place that has it
(offsets in the compared form).  Repeated items (same id and text) count once.
Items without an id take no part unless ``null_ids`` is set: then each text
among them is an item of its own, reported with a null id after the others.
Other columns pass through; the result column replaces one of the same name.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import bounded_batches

ERROR_RATE = 0.08
BLOCK_BYTES = 1 << 20
_GAP = re.compile(r"[\W_]+")
MATCHES = "array<struct<item_id:bigint,distance:int,end:int>>"


def compared(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 adjoining pieces of about equal length, with their offsets."""
    n = min(errors + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any substring of the text, and
    the first end where it occurs.  Columns of the distance matrix are two bit
    vectors of vertical differences."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best, at = m, 0
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        cross = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(cross | plus))
        down = plus & cross
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        if distance < best:
            best, at = distance, j + 1
        up = (up << 1) & full           # a match may start anywhere: no carry in
        down = (down << 1) & full
        stay = eq | minus
        plus = down | (full & ~(stay | up))
        minus = up & stay
    return best, at


class Matcher:
    def __init__(self, items: tuple[tuple[int | None, str], ...], rate: float):
        self.items = [(i, t, budget(t, rate)) for i, t in items if t]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                found[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def matches(self, text: str) -> list[dict]:
        """Items within their budget anywhere in the text."""
        text = compared(text)
        if not self.any or not text:
            return []
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                starts[n].append(end + 1 - size - offset)
        out = []
        for n, where in starts.items():
            item_id, item, errors = self.items[n]
            best = None
            where.sort()
            k = 0
            while k < len(where):
                # hits whose neighbourhoods overlap are verified together
                lo, hi = where[k], where[k]
                while k < len(where) and where[k] <= hi + errors + 1 and hi - lo <= len(item):
                    hi = where[k]
                    k += 1
                a = max(0, lo - errors)
                distance, end = myers(item, text[a:hi + len(item) + errors])
                if distance <= errors and (best is None or distance < best[0]):
                    best = (distance, a + end)
                    if not distance:
                        break
            if best:
                out.append({"item_id": item_id, "distance": best[0], "end": best[1]})
        return sorted(out, key=lambda x: (x["item_id"] is None, x["item_id"] or 0))


@functools.lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int | None, str], ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def _item_blocks(items: DataFrame, id_col: str, text_col: str, null_ids: bool) -> Iterator[tuple[tuple[int | None, str], ...]]:
    rows = (items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
            .where((F.col("i").isNotNull() | F.lit(null_ids)) & F.col("t").isNotNull()).distinct())
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        yield tuple(sorted({(r["i"], compared(r["t"])) for r in got}, key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def _matched(items, rate: float):
    @F.pandas_udf(MATCHES)
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = _matcher(items.value, rate)
        for texts in batches:
            yield pd.Series([m.matches(t) for t in texts], dtype=object)

    return matched


def match(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", rate: float = ERROR_RATE, out: str = "matches", null_ids: bool = False) -> DataFrame:
    """``docs`` with the benchmark items each whole text holds."""
    context = bounded_batches(docs).sparkSession.sparkContext
    found = F.array().cast(MATCHES)
    text = F.coalesce(F.col(text_col), F.lit(""))
    for block in _item_blocks(items, item_id, item_text, null_ids):
        found = F.concat(found, _matched(context.broadcast(block), rate)(text))
    return docs.withColumn(out, found)
