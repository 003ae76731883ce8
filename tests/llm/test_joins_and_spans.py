"""N-gram join, substring dedup, personal data and decontamination."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierline.llm import decontaminate, ngram_join, pii, substring_dedup
from tierline.llm.components import components
from tests_brute import components_of, plain_spans

# ------------------------------------------------------------- n-gram join


def near_copies(seed, bases=6, copies=14):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    common = " ".join(rng.choice(words) for _ in range(12))
    rows = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randint(4, 60))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text.append(common)
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


EDGES = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one two three"), (906, "one two three four"),
         (907, "É è a b c"), (908, "é è a b c"), (None, "one"), (None, "alone here"), (903, "two words"), (910, "a\x0bb\x1cc"), (911, "a b\x1cc")]


@pytest.mark.parametrize("n,num,den,rows,hot", [(4, 85, 100, 1024, 256), (5, 80, 100, 4, 256), (3, 60, 100, 8, 3)])
def test_join_equals_brute_force(spark, monkeypatch, n, num, den, rows, hot):
    """Also with families cut into many tiles, and with hot n-grams."""
    monkeypatch.setattr(ngram_join, "TILE_ROWS", rows)
    monkeypatch.setattr(ngram_join, "HOT_LEAST", hot)
    docs = near_copies(n) + EDGES
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, n_shingles int, key string").repartition(hot % 7 + 1)
    got = sorted((tuple(r) for r in ngram_join.join(df, n=n, num=num, den=den).collect()), key=repr)
    assert got == components_of(docs, n, num, den)


def test_join_of_nothing_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(150_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.join(df).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame(chain + hub + [(7, 7), (5000, 4999)], "src long, dst long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(300)}, 5000: 4999, 4999: 4999}


# --------------------------------------------------------- substring dedup


def brute_dedup(rows, width):
    words = [[x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x] for _, t in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - width + 1):
            seen[tuple(w[i:i + width])] = seen.get(tuple(w[i:i + width]), 0) + 1
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [any(seen[tuple(w[i:i + width])] > 1 for i in range(max(0, p - width + 1), min(p, len(w) - width) + 1)) for p in range(len(w))]
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def shared_passages(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(rng.randint(5, 70))] for _ in range(6)]
    rows = []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += p[a:rng.randint(a, len(p))] if rng.random() < 0.4 else p
            text += [rng.choice(words) for _ in range(rng.randint(0, 9))]
        rows.append(" ".join(text))
    rows += [rows[3], rows[3], rows[5], "la " * 80, "x y " * 40, rows[8].replace(" ", " \n\t")]
    return list(enumerate(rows))


@pytest.mark.parametrize("width,parts", [(35, 1), (35, 4), (35, 40), (8, 4), (5, 9)])
def test_dedup_equals_brute_force(spark, width, parts):
    """Copies meet in one task, in several, or each in its own."""
    docs = shared_passages(width) + [(900, None), (901, ""), (902, " \n"), (None, "a b"), (903, "É é x" * 20), (904, "a\x1cb " * 40)]
    docs += [docs[4], docs[4]]                          # repeated rows
    df = spark.createDataFrame([(*d, "old", 3) for d in docs], "doc_id long, text string, kept string, n_words int").repartition(parts)
    out = substring_dedup.dedup(df, width=width)
    got = out.select("doc_id", "n_words", "n_removed", "kept", "removed").collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute_dedup(docs, width)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def test_dedup_of_nothing_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.dedup(empty).count() == 0
    rng = np.random.default_rng(4)
    tail = " ".join(f"t{i}" for i in range(40))
    long = " ".join(map(str, rng.integers(0, 10 ** 9, 300_000).tolist()))
    df = spark.createDataFrame([(1, f"{long} {tail} last"), (2, f"first {tail}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.dedup(df).collect()) == [(1, 300_041, 40), (2, 41, 40)]


def test_stretches_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_STRETCH", 10)
    for n in range(0, 60):
        starts = [at + i for at, w in substring_dedup.stretches(np.arange(n, dtype=np.uint64), 7) for i in range(len(w) - 6)]
        assert starts == list(range(max(0, n - 6)))


def test_packed_integers():
    v = np.array([0, 1, 2 ** 48 - 1, 77], np.uint64)
    assert (substring_dedup.unpack(substring_dedup.pack(v, 6), 6) == v).all() and len(substring_dedup.pack(v, 6)) == 24


# ------------------------------------------------------------ personal data


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    parts = list("12 5.@a-+()%٣é") + ["4111111111111111", "1.2.3.4", "a@b.c", "+1 (555) 123-4567", "256.1.1.1", "4111 1111 1111 1111"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert plain_spans(t) == pii.base_spans(t), t


def test_base_spans_of_long_runs_are_quick():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "- " * 150_000):
        pii.base_spans(t)


@pytest.fixture(scope="module")
def pii_field():
    rng = random.Random(8)
    words = "the a of in report line order page".split()
    texts = []
    for _ in range(160):
        w = [rng.choice(words) for _ in range(12)]
        w.insert(6, rng.choice([f"u{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", f"password={rng.getrandbits(160):040x}",
                                ".".join(str(rng.randrange(256)) for _ in range(4)), f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
                                f"chapter {rng.randrange(40)}", f"token = \"{rng.getrandbits(160):040x}\"", "4111111111111111", f"{rng.randrange(2000)}"]))
        texts.append(" ".join(w))
    return pii.train(texts)


def test_field_adds_secrets_and_leaves_numbers(pii_field):
    spans = lambda t: [(t[a:b], pii.KINDS[k], base) for a, b, k, base in pii.find(t, pii_field)]
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    assert spans(f"see the password={secret} in it") == [(secret, "secret", False)]
    assert spans("mail a.b@c.example.com or page 12 of 2024") == [("a.b@c.example.com", "email", True)]
    assert spans("version 3 of 2.0, page 17") == []
    # two cards in a row: the patterns see one number that fails
    assert [s[1] for s in spans("pay 4111111111111111 4111111111111111 now")] == ["card", "card"]


def test_decode_is_the_best_segmentation(pii_field):
    """Against all segmentations of small windows."""
    text = "of +1 (212) 555-1234 in"
    (tokens,) = pii.windows(text)
    w = pii.Window(text, tokens)
    span, out = pii_field.scores(w)

    def every(at, state):
        if at == len(tokens):
            yield 0.0, []
            return
        for s, rest in every(at + 1, 0):
            yield pii_field.step[state, 0] + out[at] + s, rest
        for r, (i, j) in enumerate(w.spans):
            if i == at:
                for k in range(len(pii.KINDS)):
                    for s, rest in every(j, k + 1):
                        yield pii_field.step[state, k + 1] + span[r, k] + s, [(i, j, k), *rest]

    ways = list(every(0, 0))
    assert pii_field.decode(w) == max(ways, key=lambda x: x[0])[1]
    # the gradient of one window sums to gold minus expectation: outside mass balances
    grad = {k: np.zeros_like(getattr(pii_field, k)) for k in ("span", "out", "step")}
    pii_field.learn(w, {}, grad)
    scores = np.array([s for s, _ in ways])
    p = np.exp(scores - np.logaddexp.reduce(scores))
    spans_expected = sum(x * len(rest) for x, (_, rest) in zip(p, ways, strict=True))
    assert abs(-grad["span"][0].sum() - spans_expected) < 1e-6      # feature 0 is the bias of each span


def test_pii_in_spark(spark, pii_field):
    rows = [(1, None), (2, ""), (3, "call +1 (212) 555-1234 or a@b.example"), (3, "call +1 (212) 555-1234 or a@b.example"), (None, "ip 10.0.0.1"),
            (4, "word " * 100_000 + "x@y.zz")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, pii string")
    out = pii.detect(df, pii_field)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii] for r in out.collect()}
    assert out.count() == len(rows) and got[1] == got[2] == []
    assert got[3] == [("phone", 5, 22), ("email", 26, 37)] and got[None] == [("ip", 3, 11)] and got[4] == [("email", 500_000, 500_006)]
    text = {r.doc_id: r.text for r in pii.redact(df, pii_field).collect()}
    assert text[1] is None and text[3] == "call <PHONE> or <EMAIL>" and text[4].endswith("word <EMAIL>")
    empty = df.where("doc_id < 0")
    assert pii.fit(empty) is None and pii.detect(empty, None).count() == 0


def test_pii_query_equals_the_patterns(spark):
    import hashlib

    from tierline.llm.queries import op8_pii

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op8_pii(spark, sf).collect():
        spans = plain_spans(texts[r.doc_id])
        joined = [f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in range(4)]
        assert set(joined) <= set(r.spans.split(","))


# ---------------------------------------------------------- decontamination


def brute_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i in range(1, len(pattern) + 1):
        now = [i]
        for j in range(1, len(text) + 1):
            now.append(min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (pattern[i - 1] != text[j - 1])))
        before = now
    return min(before), before.index(min(before))


def test_myers_equals_the_table():
    rng = random.Random(2)
    for _ in range(1500):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 15)))
        assert decontaminate.myers(p, t) == brute_distance(p, t)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_matches_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(12)
    items = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(20, 45)))) for i in range(6)] + [(50, "..."), (51, None), (None, "abab"), (0, None)]
    items.append(items[0])
    docs = []
    for d in range(60):
        text = list(rng.choice(items[:6])[1] * rng.randint(0, 2))
        for _ in range(rng.randint(0, 9)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(["", "a", "B", "--", "bb"])
        docs.append((d, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 30))) + "".join(text)))
    docs += [(70, None), (71, ""), (None, items[1][1]), (72, "z " * 200_000 + items[2][1].upper())]
    df = spark.createDataFrame([(*d, 5, "m") for d in docs], "doc_id long, text string, item_id int, matches string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    out = decontaminate.match(df, bench, rate=0.1)
    got = {(r.doc_id, m.item_id): (m.distance, m.end) for r in out.collect() for m in r.matches}
    want = {}
    for d, t in docs:
        c = decontaminate.compared((t or "")[-5000:])
        for i, item in items:
            p = decontaminate.compared(item or "")
            if i is not None and p and c:
                distance, end = brute_distance(p, c)
                if distance <= int(len(p) * 0.1):
                    want[d, i] = (distance, end)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and want
    assert all(got[k][1] == want[k][1] for k in want if k[0] != 72)
    assert decontaminate.match(df.where("doc_id < 0"), bench).count() == 0
    assert decontaminate.match(df, bench.where("item_id < 0")).where(F.size("matches") > 0).count() == 0


def test_items_without_an_id_are_found(spark, tmpdir_path):
    import corpus_pipeline
    from tierline.llm.queries import op10_decontaminate

    passages = ["the quick brown fox jumps over the lazy dog", "pack my box with five dozen liquor jugs", "sphinx of black quartz judge my vow"]
    docs = [(1, f"before {passages[0]} after"), (2, "nothing of it"), (3, f"{passages[1]} and {passages[2]}"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([(None, passages[0]), (None, passages[0]), (None, passages[1]), (7, passages[2]), (None, None), (None, "...")],
                          "item_id long, text string").write.parquet(f"{tmpdir_path}/benchmark.parquet")
    got = [tuple(r) for r in op10_decontaminate(spark, tmpdir_path).collect()]
    assert sorted(got, key=repr) == [(1, None, 0, 50), (3, 7, 0, len(docs[2][1])), (3, None, 0, 39)]
    left = corpus_pipeline.benchmark_leaks(spark, spark.read.parquet(f"{tmpdir_path}/documents.parquet"), tmpdir_path)
    assert sorted(r.doc_id for r in left.collect()) == [2, 4]


def test_decontamination_query_finds_planted_items(spark):
    from tierline.llm.queries import op10_decontaminate

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: decontaminate.compared(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: decontaminate.compared(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, p in items.items() if p in t}
    got = {(r.doc_id, r.item_id): r.distance for r in op10_decontaminate(spark, sf).collect()}
    assert exact and exact == {k for k, v in got.items() if v == 0}


def test_segmenting_in_a_band_equals_the_whole_window(pii_field):
    rng = random.Random(6)
    parts = ["1", "22", "+", "4111 1111 1111 1111", "a@b.co", "x", " ", " ", ".", "-", "(212) 555-1234", "10.0.0.1", "token=ab12cd34ef56gh78", "@", "_"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        for tokens in pii.windows(text):
            assert pii_field.segment(text, tokens) == pii_field.decode(pii.Window(text, tokens)), text


def test_long_numbers_and_zeros(spark, pii_field):
    import tracemalloc

    texts = ["0" * 5000 + ".1.1.1", "1.2.3." + "0" * 9000 + "7", "1.2.3." + "9" * 6000, "0000.0.0.255 and 1.1.1.0256"]
    want = [[(0, 5006)], [(0, 9007)], [], [(0, 12)]]
    assert [[(a, b) for a, b, k in pii.base_spans(t) if k == 1] for t in texts] == want
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    assert pii.detect(df, pii_field).count() == len(texts)
    numbers = " ".join(map(str, range(6000)))
    tracemalloc.start()
    pii.find(numbers, pii_field)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20          # the window's features would take eight times as much
    tracemalloc.stop()


def test_join_with_many_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 256)
    monkeypatch.setattr(ngram_join, "RANGE_BYTES", 64)
    docs = near_copies(9) + EDGES
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.join(df, n=4, num=85, den=100).collect()), key=repr)
    assert got == components_of(docs, 4, 85, 100)
