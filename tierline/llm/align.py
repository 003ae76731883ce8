"""Cross-tokenizer alignment by divide and conquer at shared cuts.

Tokenizer A is a byte-level BPE file, tokenizer B a piece model that adds a
space before the text; both give tokens over the same bytes, a space and the
text.  A byte offset where a token of A and one of B end is a shared cut.  An
interval between two cuts is split at the shared cut nearest to its middle,
looked for outward from the middle with a bisect into B's ends; both halves
go on, and an interval without an inner cut is a leaf group.  All intervals of
one depth of all texts of a slice are worked on together.

A link is a pair of overlapping occurrences, one of A and one of B, inside a
group.  Links of an id pair are counted over all rows; ``n_best`` counts a
row's links whose pair count is the highest that their B id has, ``count_sum``
adds the pair counts of its links.

How the work is spread: one pass tokenizes and writes ids and, for each task,
counts by id pair (pre-aggregated); the counts are summed by pair.  The pairs
with the highest counts (at most ``SHARED_PAIRS``, 16 bytes each) are shared
with all tasks; links of the others are joined to their counts by pair.

Texts are tokenized in units cut at single spaces between two characters that
are not white space: no token of A spans such a place, nor does one of B as
long as no piece holds a space after another character (checked when the
model is read; else texts are tokenized whole).  Units are kept with their
ids in a table of bounded size.  A text without such a place is one unit.

Defined results: null and empty texts, and texts whose joined token bytes
differ from a space and the text (a text with U+2581, or one that B's
normaliser changes), have no tokens: zeros, and empty ``groups``.  Repeated
rows and ids are rows of their own and count as often as they stand there.
Columns named in ``keep`` pass through; only they and the results are
returned, and a kept column of a result's name gives way to the result.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.llm.common import bounded_batches, slices, staged

#: Most id pairs whose counts every task holds.
SHARED_PAIRS = 1 << 21
#: Units a generation of kept ones has, the longest kept, text of a numpy step.
CACHE_UNITS, CACHE_CHARS, STEP_BYTES = 150_000, 48, 1 << 18
#: Units that one call of either library gets as one string.
JOINED = 64
#: Distinct pairs that a task holds before it writes them out, and pairs of a row.
HELD_PAIRS, ROW_PAIRS = 1 << 19, 1 << 15
_UNIT = re.compile(r"(?<=\S) (?=\S)")
_MORE_SPACE = re.compile(r"\s | \s|\A | \Z")
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for
    themselves, the others follow from U+0100 on in ascending order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class Pair:
    """Both tokenizers with their token bytes."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int32)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int32)
        # decimal ids with a separator, filled up with zero bytes: A's before a
        # token of the group, A's last, B's before one, B's last
        self.printed = np.array([b"%d%s" % (i, sep) for n, seps in ((self.n_a, b",|"), (self.n_b, b",;")) for sep in (seps[:1], seps[1:])
                                 for i in range(n)])
        self.printed_len = np.char.str_len(self.printed)
        self.printed = self.printed.view(np.uint8).reshape(len(self.printed), -1)
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def _encode(self, units: list[str], alone: set[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of units; two empty strings where the bytes differ.
        Units go to A and B side by side, as if in one text, and are cut again
        at the bytes where they end; but for those of ``alone``."""
        if alone and len(units) > 1:
            rest = [u for u in units if u not in alone]
            coded = dict(zip(rest, self._encode(rest, set()), strict=True))
            return [coded.get(u) or self._encode([u], alone)[0] for u in units]
        out = []
        for lo in range(0, len(units), JOINED):
            own = units[lo:lo + JOINED]
            joined = "".join([" " + u for u in own])
            a = self.a.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            b = self.b.encode(" ".join(own))
            want = joined.encode()
            unit_end = np.cumsum([len(u.encode()) + 1 for u in own])
            if (b"".join(map(self.a_bytes.__getitem__, a)) == want
                    and b"".join(map(self.b_bytes.__getitem__, b)) == want):
                a, b = np.array(a, "<u4"), np.array(b, "<u4")
                a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
                a_cut, b_cut = np.searchsorted(a_end, unit_end), np.searchsorted(b_end, unit_end)
                same = bool((a_end[a_cut] == unit_end).all() and (b_end[b_cut] == unit_end).all())
            else:
                same = False
            if same:
                a, b, a_cut, b_cut = a.tobytes(), b.tobytes(), (4 * a_cut + 4).tolist(), (4 * b_cut + 4).tolist()
                out += [(a[x:y], b[v:w]) for x, y, v, w in zip([0, *a_cut], a_cut, [0, *b_cut], b_cut)]
            elif len(own) == 1:
                out.append((b"", b""))
            else:
                out += [ids for u in own for ids in self._encode([u], alone)]
        return out

    def _units(self, text: str | None) -> list[str]:
        if not text or "▁" in text:
            return []
        if self.whole:
            return [text]
        return _UNIT.split(text) if _MORE_SPACE.search(text) else text.split(" ")

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Packed ids of whole texts by A and B.  Units are kept in two
        generations; those of the older one that are met again stay."""
        cut = [self._units(t) for t in texts]
        known = self.kept.get
        got = [list(map(known, units)) for units in cut]
        missing = {u for units, ids in zip(cut, got, strict=True) if None in ids
                   for u, x in zip(units, ids, strict=True) if x is None}
        coded = {u: self.older[u] for u in missing if u in self.older}
        new = [u for u in missing if u not in coded]
        # white space at a unit's end stands only at the ends of texts
        ends = {u for units in cut if units for u in (units[0], units[-1]) if self.whole or u[0].isspace() or u[-1].isspace()}
        coded.update(zip(new, self._encode(new, ends), strict=True))
        self.kept.update(coded)
        for u in new:
            if len(u) > CACHE_CHARS:
                del self.kept[u]
        if len(self.kept) > CACHE_UNITS:
            self.kept, self.older = {}, self.kept
        out = []
        for units, ids in zip(cut, got, strict=True):
            ids = [x or coded[u] for u, x in zip(units, ids, strict=True)] if None in ids else ids
            if all([x for x, _ in ids]):
                out.append((b"".join([x for x, _ in ids]), b"".join([y for _, y in ids])))
            else:
                out.append((b"", b""))
        return out


@functools.lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


# ------------------------------------------------------------- shared cuts


def _near(a: np.ndarray, b: np.ndarray, lo: int, hi: int, mid: int, reach: int) -> int:
    """Index in [lo, hi) of the common end nearest to ``mid`` but farther than
    ``reach`` from it, or -1: blocks of doubling width on either side."""
    width = reach
    while mid - width > lo or mid + width < hi:
        parts = np.concatenate([np.arange(max(lo, mid - 2 * width), max(lo, mid - width + 1)),
                                np.arange(min(hi, mid + width), min(hi, mid + 2 * width + 1))])
        at = np.searchsorted(b, a[parts])
        hits = parts[b[np.minimum(at, len(b) - 1)] == a[parts]]
        if len(hits):
            return int(hits[np.abs(hits - mid).argmin()])
        width *= 2
    return -1


def shared_cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices into the ascending ends ``a`` of all ends that ``b`` has too.
    The last end must be common."""
    if not len(a):
        return np.empty(0, np.int64)
    lo, hi = np.zeros(min(1, len(a) - 1), np.int64), np.full(min(1, len(a) - 1), len(a) - 1)     # inner ends: [lo, hi)
    found = [np.array([len(a) - 1])]

    def common(at: np.ndarray) -> np.ndarray:
        ends = a[at]
        return b[np.searchsorted(b, ends)] == ends              # b's last end is a's last

    while len(lo):
        mid = (lo + hi) >> 1
        hit = np.where(common(mid), mid, -1)
        todo = np.flatnonzero(hit < 0)
        for step in range(1, 9):
            if not len(todo):
                break
            for at, inside in ((mid[todo] - step, mid[todo] - step >= lo[todo]), (mid[todo] + step, mid[todo] + step < hi[todo])):
                inside = np.flatnonzero(inside & (hit[todo] < 0))
                good = inside[common(at[inside])]
                hit[todo[good]] = at[good]
            todo = todo[(hit[todo] < 0) & ((mid[todo] - step > lo[todo]) | (mid[todo] + step < hi[todo] - 1))]
        for k in todo.tolist():
            hit[k] = _near(a, b, int(lo[k]), int(hi[k]), int(mid[k]), 8)
        split = np.flatnonzero(hit >= 0)
        cut, lo, hi = hit[split], lo[split], hi[split]
        found.append(cut)
        # halves side by side: intervals stay in order
        lo, hi = np.stack([lo, cut + 1], 1).ravel(), np.stack([cut, hi], 1).ravel()
        more = lo < hi
        lo, hi = lo[more], hi[more]
    return np.sort(np.concatenate(found))


class Step:
    """A slice of texts: ids, ends, groups and links, texts laid end to end."""

    def __init__(self, p: Pair, a: list[bytes], b: list[bytes]):
        self.p = p
        self.a, self.b = (np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in (a, b))
        self.per_a, self.per_b = (np.array([len(t) >> 2 for t in x], np.int64) for x in (a, b))
        self.a_end, self.b_end = (np.cumsum(x, dtype=np.int32) for x in (p.a_len[self.a], p.b_len[self.b]))
        self.last = np.cumsum(self.per_a) - 1            # of each text, in a; meaningless for those without tokens

    def groups(self) -> None:
        self.a_cut = shared_cuts(self.a_end, self.b_end)
        self.b_cut = np.searchsorted(self.b_end, self.a_end[self.a_cut])

    def links(self) -> np.ndarray:
        """Id pair of every link as one number, in order.  Overlaps of two
        partitions of the same bytes are the pieces between all their ends."""
        ends = np.sort(np.concatenate([self.a_end, self.b_end]), kind="stable")
        ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])] if len(ends) else ends
        self.link_end = ends
        return self.a[np.searchsorted(self.a_end, ends)].astype(np.int64) * self.p.n_b + self.b[np.searchsorted(self.b_end, ends)]

    def per_text(self, ends: np.ndarray) -> np.ndarray:
        """How many of the ascending byte ends lie in each text."""
        if not len(self.a):
            return np.zeros(len(self.per_a), np.int64)
        byte_end = np.where(self.last >= 0, self.a_end[np.maximum(self.last, 0)], 0)
        return np.diff(np.searchsorted(ends, byte_end, "right"), prepend=0)

    def printed(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text."""
        p, out = self.p, np.empty(len(self.a) + len(self.b), np.int64)
        group_a = np.searchsorted(self.a_cut, np.arange(len(self.a)))
        group_b = np.searchsorted(self.b_cut, np.arange(len(self.b)))
        before = np.concatenate([[0], self.b_cut[:-1] + 1]).astype(np.int64)
        code_a, code_b = self.a.copy(), self.b + 2 * p.n_a
        code_a[self.a_cut] += p.n_a
        code_b[self.b_cut] += p.n_b
        if len(self.a):
            out[np.arange(len(self.a)) + before[group_a]] = code_a
            out[np.arange(len(self.b)) + self.a_cut[group_b] + 1] = code_b
        flat = p.printed[out].ravel()
        flat = flat[flat != 0].tobytes()
        end = np.concatenate([[0], np.cumsum(p.printed_len[out])])[np.cumsum(self.per_a + self.per_b)].tolist()
        return [flat[x:y - 1].decode() if y > x else "" for x, y in zip([0, *end[:-1]], end, strict=True)]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Exact sums of consecutive runs of ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


# ------------------------------------------------------------------- Spark


class _Held:
    """Counts by pair: merged ones, and the latest not yet merged."""

    def __init__(self):
        self.codes = self.counts = np.empty(0, np.int64)
        self.new, self.size = [], 0

    def add(self, codes: np.ndarray) -> None:
        if len(codes):
            self.new.append(np.unique(codes, return_counts=True))
            self.size += len(self.new[-1][0])
        if self.size > max(HELD_PAIRS >> 2, len(self.codes)):
            self.merge()

    def merge(self) -> None:
        codes = np.concatenate([self.codes, *[c for c, _ in self.new]])
        counts = np.concatenate([self.counts, *[n for _, n in self.new]])
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
        self.codes, self.counts = codes[first], np.add.reduceat(counts, first) if len(first) else counts
        self.new, self.size = [], 0

    def flush(self, all_of_it: bool) -> Iterator[tuple[bytes, bytes]]:
        if all_of_it:
            self.merge()
        if all_of_it or len(self.codes) > HELD_PAIRS:
            for lo in range(0, len(self.codes), ROW_PAIRS):
                yield self.codes[lo:lo + ROW_PAIRS].tobytes(), self.counts[lo:lo + ROW_PAIRS].tobytes()
            self.codes = self.counts = np.empty(0, np.int64)


def _tokens(df: DataFrame, a_path: str, b_path: str, text_col: str) -> DataFrame:
    """Rows of ``df`` with packed ids (__a, __b) and a row number, and rows
    with nothing but id pairs and their counts in a task (__codes, __counts)."""
    keep = [T.StructField(f.name, f.dataType, True) for f in df.schema if f.name != text_col]
    own = {"__row": (T.LongType(), pa.int64())} | {c: (T.BinaryType(), pa.binary()) for c in ("__a", "__b", "__codes", "__counts")}
    schema = T.StructType([*keep, *(T.StructField(c, t) for c, (t, _) in own.items())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held = pair(a_path, b_path), _Held()
        row, types = TaskContext.get().partitionId() << 33, []

        def out(kept, n, **given):
            columns = [pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, (_, t) in own.items()]
            return pa.RecordBatch.from_arrays([*kept, *columns], names=schema.names)

        def counted(last):
            for codes, counts in held.flush(last):
                yield out([pa.nulls(1, t) for t in types], 1, __codes=[codes], __counts=[counts])

        for batch in batches:
            kept = [batch.column(f.name) for f in keep]
            types = [c.type for c in kept]
            texts = batch.column(text_col)
            for lo, hi in slices(pc.coalesce(pc.binary_length(texts), 0).to_pylist(), STEP_BYTES):
                ids = p.encode(texts.slice(lo, hi - lo).to_pylist())
                a, b = [x for x, _ in ids], [y for _, y in ids]
                held.add(Step(p, a, b).links())
                yield out([c.slice(lo, hi - lo) for c in kept], hi - lo, __row=range(row, row + hi - lo), __a=a, __b=b)
                row += hi - lo
            yield from counted(False)
        if types:
            yield from counted(True)

    return staged(bounded_batches(df).mapInArrow(work, schema), "aligned-tokens")


def _pairs(tokens: DataFrame, n_b: int) -> DataFrame:
    """code, n (its links in all rows), best (the most of its B id)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(codes, np.int64)), pa.array(np.frombuffer(counts, np.int64))],
                                                 names=["code", "n"])

    counts = (tokens.where("__codes is not null").select("__codes", "__counts").mapInArrow(unpack, "code long, n long")
              .groupBy("code").agg(F.sum("n").alias("n")))
    counts = staged(counts, "pair-counts").withColumn("b", F.col("code") % n_b)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return staged(counts.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def _least_shared(pairs: DataFrame, limit: int) -> int:
    """The smallest count such that at most ``limit`` pairs have it or more,
    to within a sixteenth of a power of two."""
    steps = pairs.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least"))
    least, total = None, 0
    for step in sorted(steps.collect(), key=lambda r: -r["step"]):       # at most 16 x 63 rows
        total += step["pairs"]
        if total > limit:
            break
        least = step["least"]
    return least if least is not None else (1 << 62)


class _Counts:
    def __init__(self, codes: np.ndarray, counts: np.ndarray, best: np.ndarray):
        self.codes, self.packed = codes, counts << 1 | best

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count and best of each link (0 where not held), and which are held."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        held = self.codes[at] == codes
        packed = np.where(held, self.packed[at], 0)
        return packed >> 1, packed & 1, held


def align(df: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
          shared_pairs: int | None = None) -> DataFrame:
    """``keep`` columns and, for every whole text: n_a, n_b (tokens), n_groups,
    n_links, n_best, count_sum (long) and ``groups`` (string)."""
    spark = df.sparkSession
    kept = [c for c in keep if c not in RESULTS and c != text_col]
    tokens = _tokens(df.select(*kept, text_col), a_path, b_path, text_col)
    pairs = _pairs(tokens, pair(a_path, b_path).n_b)
    limit = SHARED_PAIRS if shared_pairs is None else shared_pairs
    least = _least_shared(pairs, limit)
    top = pairs.where(F.col("n") >= least).toArrow()                     # at most ``limit`` rows
    codes, n, best = (top.column(c).to_numpy() for c in ("code", "n", "best"))
    order = np.argsort(codes)
    shared = spark.sparkContext.broadcast(_Counts(codes[order], n[order].astype(np.int64), best[order].astype(np.int64)))
    rare = pairs.where(F.col("n") < least)
    rows = tokens.where("__codes is null").drop("__codes", "__counts")
    if rare.limit(1).count():
        rows = rows.join(_rare_links(rows, rare, shared, a_path, b_path), "__row", "left")
    else:
        rows = rows.withColumns({"__best": F.lit(0).cast("long"), "__sum": F.lit(0).cast("long")})
    fields = [f for f in df.schema if f.name in kept]
    out = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in fields),
                        *(T.StructField(c, T.LongType()) for c in RESULTS[:-1]), T.StructField("groups", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        for batch in batches:
            a, b = batch.column("__a").to_pylist(), batch.column("__b").to_pylist()
            more = [np.array([x or 0 for x in batch.column(c).to_pylist()], np.int64) for c in ("__best", "__sum")]
            for lo, hi in slices([len(x) for x in a], STEP_BYTES):
                step = Step(p, a[lo:hi], b[lo:hi])
                step.groups()
                count, best, _ = shared.value.find(step.links())
                links = step.per_text(step.link_end)
                results = [step.per_a, step.per_b, step.per_text(step.a_end[step.a_cut]), links,
                           _sums(best, links) + more[0][lo:hi], _sums(count, links) + more[1][lo:hi], step.printed()]
                own = [batch.column(f.name).slice(lo, hi - lo) for f in fields]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, results)], names=out.names)

    return rows.mapInArrow(work, out)


def _rare_links(rows: DataFrame, rare: DataFrame, shared, a_path: str, b_path: str) -> DataFrame:
    """__row, __best, __sum over links whose pairs the tasks do not hold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        for batch in batches:
            a, b = batch.column("__a").to_pylist(), batch.column("__b").to_pylist()
            number = batch.column("__row").to_numpy()
            for lo, hi in slices([len(x) for x in a], STEP_BYTES):
                step = Step(p, a[lo:hi], b[lo:hi])
                codes = step.links()
                open_ = ~shared.value.find(codes)[2]
                text = np.repeat(np.arange(hi - lo), step.per_text(step.link_end))[open_]
                found, times = np.unique(np.stack([text, codes[open_]]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(number[lo:hi][found[0]]), pa.array(found[1]), pa.array(times)],
                                                 names=["__row", "code", "times"])

    links = rows.select("__row", "__a", "__b").mapInArrow(work, "__row long, code long, times long")
    return (links.join(rare, "code").groupBy("__row")
            .agg(F.sum(F.col("best").cast("long") * F.col("times")).alias("__best"), F.sum(F.col("n") * F.col("times")).alias("__sum")))
