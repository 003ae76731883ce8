"""Top-k search, separator scan and license scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierline.llm import license_scan, separator_scan, topk
from tierline.session import scratch_dir


def brute_topk(rows, k):
    out = []
    vectors = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows
               if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    for q, x in vectors:
        if q % 50 == 0:
            scores = sorted((-int(x @ y), i) for i, y in vectors if i != q and len(y) == len(x))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_topk_equals_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(topk, "CANDIDATES", 40)
        monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 256]) for i in range(400)]       # many ties
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0]), (1050, [float("nan")] * 5), (1100, [float("inf")] + [0.0] * 4),
             (1150, []), (1200, [0.5, 0.25]), (1201, [1.0, 1.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = sorted(tuple(r) for r in topk.topk(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_topk(rows, 5)


def test_topk_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (3, [2.0]), (3, [2.0]), (4, [1.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.topk(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 131072), (0, 2, 3, 131072), (0, 3, 4, 65536)]
    assert topk.topk(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_large_values_stay_exact():
    x = np.array([[2 ** 30, 1], [2 ** 30, 2], [-2 ** 30, 5]], np.int64)
    found = {int(r): s.tolist() for r, _, s in topk._block_topk(x, np.array([1, 2, 3]), x[:1], np.array([1]), 2)}
    assert found[0] == [2 ** 60 + 2, -2 ** 60 + 5]


@pytest.mark.parametrize("block", [3, 7, 1 << 21])
def test_separator_scan_stitches_blocks(spark, tmpdir_path, monkeypatch, block):
    monkeypatch.setattr(separator_scan, "_CHUNK", 2)
    files = {"a": [5, 5, 0, 0, 7, 7, 7, 7, 7, 7, 7, 7, 7, 0, 1], "b": [], "c": [0], "d": [4] * 20}
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(f"{tmpdir_path}/{name}")
    df = spark.createDataFrame([(f"{tmpdir_path}/{n}",) for n in files], "file string")
    got = sorted((r.file[-1], r.ordinal, r.start, r.n_tokens, r.closed) for r in separator_scan.scan(df, 0, block_tokens=block).collect())
    assert got == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 9, True), ("a", 3, 14, 1, False),
                   ("c", 0, 0, 0, True), ("d", 0, 0, 20, False)]


def test_token_counts_of_texts(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 50_000), (None, "x"), (1, "one two three")]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, file string, ordinal int")
    got = separator_scan.token_counts(df, scratch_dir(spark, "t"), lambda: lambda text: [len(w) for w in text.split()], 0)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got.collect()) == sorted(
        (i or -1, len((t or "").split())) for i, t in rows)
    assert separator_scan.token_counts(df.where("doc_id < 0"), scratch_dir(spark, "t"), lambda: lambda text: [len(w) for w in text.split()], 0).count() == 0


def test_token_count_query(spark):
    from tierline.llm.queries import _tiktoken, op2_token_counts

    sf, encode = "/root/testdata/sf0.001", _tiktoken()
    want = {r.doc_id: len(encode(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in op2_token_counts(spark, sf).collect()} == want


def test_license_phrases_and_templates(spark):
    long = "word " * 200_000 + "All Rights Reserved"
    rows = [(1, None), (2, ""), (3, "...!"), (4, "CC-BY 4.0 and cc by, all rights. Reserved"), (5, "x\nReleased under the MIT License.\ny"),
            (6, "released under mit license"), (7, long), (8, "GENERAL general public license public license"),
            (9, "Released\nunder the\nMIT\nLicense."), (5, "x\nReleased under the MIT License.\ny"), (None, "cc by")]
    df = spark.createDataFrame([(*r, "old", 7) for r in rows], "doc_id long, text string, labels string, score int")
    out = license_scan.scan(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    pick = lambda i: (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels, got[i].score)
    assert pick(1) == pick(2) == pick(3) == (0, 0, None, None, "", "", 0.0)
    assert pick(4) == (10, 3, 0, 7, "cc-by,reserved", "cc-by,reserved", 1.0)
    assert pick(5) == (7, 0, None, None, "", "mit", 1.0)
    assert pick(6) == (4, 0, None, None, "", "mit", 0.8)
    assert pick(7) == (200_003, 1, 200_000, 200_000, "reserved", "reserved", 1.0)
    assert pick(8)[1:4] == (1, 1, 1) and pick(9)[5] == "" and pick(None)[4] == "cc-by"
    assert license_scan.scan(df.where("doc_id < 0")).count() == 0


def test_license_join_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    vocabulary = "a b c d e f g h i j".split()
    templates = [(" ".join(rng.choice(vocabulary, rng.integers(3, 9), replace=False)), f"t{n}") for n in range(8)]
    texts = [(n, "\n".join(" ".join(rng.choice(vocabulary, rng.integers(1, 12))) for _ in range(3))) for n in range(120)]
    for threshold in (0.5, 0.8, 1.0):
        got = {(r.key, r.template): r.containment for r in license_scan.template_matches(
            spark.createDataFrame(texts, "key long, t string"), templates, threshold).collect()}
        want = {}
        for key, text in texts:
            for n, (t, _) in enumerate(templates):
                own = set(t.split())
                part = max(len(own & set(line.split())) / len(own) for line in text.split("\n"))
                if part >= threshold:
                    want[key, n] = part
        assert got == want
