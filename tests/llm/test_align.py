"""Cross-tokenizer alignment against a version by plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tierline.llm import align
from tierline.llm.queries import op12_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by row."""
    a_side = Tokenizer.from_file(A)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in own} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in own)}
    docs, count = [], Counter()
    for doc, text in rows:
        groups, links = [], []
        if text:
            x = a_side.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(chars[c] for c in t)) for i, t in zip(x.ids, x.tokens, strict=True)]
            b = [(i, bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode())
                 for i in b_side.encode(text) for p in [b_side.id_to_piece(i)]]
            want = b" " + text.encode()
            if b"".join(t for _, t in a) == want == b"".join(t for _, t in b):
                i = j = end_a = end_b = 0
                left, right = [], []
                while i < len(a) or j < len(b):
                    if end_a <= end_b:
                        end_a += len(a[i][1])
                        left.append(a[i][0])
                        i += 1
                    else:
                        end_b += len(b[j][1])
                        right.append(b[j][0])
                        j += 1
                    if left and right:
                        links.append((left[-1], right[-1]))
                    if end_a == end_b:
                        groups.append((left, right))
                        left, right = [], []
        docs.append((doc, groups, links))
        count.update(links)
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                    sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links),
                    ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)) for doc, groups, links in docs), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("doc_id", *align.RESULTS).collect()), key=repr)


EDGES = [(1, None), (2, ""), (3, " "), (4, "   lead and trail  "), (5, "a▁b"), (6, "<|endoftext|> <s> </s> <unk> <0x41>"),
         (7, "\U0001f600 emoji 你好世界 مرحبا"), (8, "line\n\n\tone\r\n two  three four five　six"),
         (9, "x" * 3000), (10, "naïve café don't I'll we've 1234567 a\x00b\x1cc \x1d d"), (None, "one two"), (9, "one two"), (11, "one two"),
         (12, "ﬁ ① Å Å"), (13, "​ zero ﻿"), (14, "!!!??? ---- ____ ....")]


@pytest.mark.parametrize("shared", [1 << 20, 200, 0])
def test_equals_plain_loops(spark, shared):
    """Also where few or no pair counts are held by the tasks."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = docs + EDGES + docs[:3]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, groups string, n_a int, code int").repartition(5)
    assert collected(align.align(df, A, B, shared_pairs=shared)) == brute(rows)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[1] else "")
            for r in brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])]
    out = op12_align(spark, sf)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table_and_kept_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 9), (1, "a b", None, None)], "doc_id long, text string, lang string, n_a int")
    out = align.align(df, A, B, keep=("lang", "n_a"))
    assert out.columns == ["lang", *align.RESULTS] and sorted(r.lang or "" for r in out.collect()) == ["", "x"]
    assert align.align(df.where("doc_id < 0"), A, B).count() == 0


def test_long_text_without_and_with_cuts(spark):
    words = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, words), (2, "z" * 200_000), (3, "世" * 20_000)]
    got = {r[0]: r for r in collected(align.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B))}
    want = {r[0]: r for r in brute(rows)}
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_cuts_of_random_ends(seed):
    rng = np.random.default_rng(seed)
    n = 3000
    a = np.unique(np.append(rng.integers(1, n * 3, n), n * 3))
    b = np.unique(np.append(rng.integers(1, n * 3, [5, 50, n][seed % 3]), n * 3))
    if seed > 2:
        b = np.unique(np.append(rng.integers(1, 40, 30), n * 3))        # all cuts at one end
    assert a[align.shared_cuts(a, b)].tolist() == np.intersect1d(a, b).tolist()
    assert align.shared_cuts(a[-1:], a[-1:]).tolist() == [0] and len(align.shared_cuts(a[:0], a[:0])) == 0


class _Calls:
    def __init__(self, real):
        self.real, self.seen = real, []

    def encode(self, given, **more):
        self.seen.append(given)
        return self.real.encode(given, **more)


def test_units_of_both_sides_are_coded_side_by_side():
    """B gets joined units in one string, not a list; each unit's ids are those it has alone."""
    rng = np.random.default_rng(5)
    parts = ["the", "naïve", "世界", "x" * 70, "12,5", "don't", "e\u0301", "\u0308a", "\U0001f600", "a\n\nb", "a  b", "\ufb01n", "\u2581q", "re-do"]
    units = sorted({"".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(600)})
    p = align.Pair(A, B)
    alone = {u: p._encode([u], set())[0] for u in units}
    p.b = calls = _Calls(p.b)
    plain = [u for u in units if alone[u][0]]
    assert len(plain) > 3 * align.JOINED
    assert p._encode(plain, set()) == [alone[u] for u in plain]
    assert all(isinstance(x, str) for x in calls.seen) and len(calls.seen) <= -(-len(plain) // align.JOINED)
    assert p._encode(units, set()) == [alone[u] for u in units]          # also where some have no ids
