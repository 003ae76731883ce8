"""Language ID, quality and byte-pair encoding on small hand-made tables."""

import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tierline.llm import bpe, langid, quality
from tierline.llm.queries import PATTERN, RANKS

DOCS = "doc_id long, text string, lang string, score string"


def lang_rows():
    en = ["the cat and the dog went to the house", "this is what they want from that", "there was nothing with them"]
    de = ["der hund und die katze gehen nach haus", "das ist nicht schön für mich", "ich weiß nichts über dich"]
    rows = [(i, t, "en", "x") for i, t in enumerate(en * 3)]
    return rows + [(100 + i, t, "de", "x") for i, t in enumerate(de * 3)]


def test_language_and_edge_texts(spark):
    train = spark.createDataFrame(lang_rows(), DOCS)
    model = langid.fit(train)
    assert model.langs == ["de", "en"]
    long = "die katze und der hund " * 100_000
    odd = spark.createDataFrame([(1, None, None, "k"), (2, "", "en", "k"), (3, "12 + 34 ½ ²", "en", "k"), (None, "the dog and that", None, None),
                                 (5, "schöne katze", "en", "k"), (6, long, None, "k"), (6, long, None, "k")], DOCS)
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.predict(odd, model).collect()}
    assert set(got) == {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "de"), (6, "de")}
    assert got[1, "und"] == 0 and all(0 <= s <= 1 for s in got.values())
    assert langid.predict(odd, model).columns == ["doc_id", "text", "lang", "score", "lang_pred"]


def test_language_scores_equal_brute_force(spark):
    """Posteriors by plain counting of n-gram buckets."""
    rows = lang_rows()
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    counts = {x: np.full(langid.BUCKETS, langid.SMOOTHING) for x in ("de", "en")}
    for _, t, x, _ in rows:
        for g in langid.grams(t):
            for b in g.tolist():
                counts[x][b] += 1
    text = "der dog ist there"
    total = [np.log(0.5) + sum(np.log(counts[x] / counts[x].sum())[b] for g in langid.grams(text) for b in g.tolist()) for x in ("de", "en")]
    want = 1 / np.exp(np.array(total) - max(total)).sum()
    row = langid.predict(spark.createDataFrame([(1, text, None, None)], DOCS), model).first()
    assert row.lang_pred == ("de", "en")[int(np.argmax(total))] and abs(row.score - want) < 1e-4


def test_language_without_labels(spark):
    empty = spark.createDataFrame([], DOCS)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    some = spark.createDataFrame([(1, "text", None, None)], DOCS)
    assert langid.predict(some, langid.fit(some)).first().lang_pred == "und"


def test_pieces_of_long_texts_give_the_same_grams(monkeypatch):
    text = "aé漢z" * 50
    whole = np.sort(np.concatenate(list(langid.grams(text))))
    monkeypatch.setattr(langid.chargrams, "_PIECE", 7)
    assert (np.sort(np.concatenate(list(langid.grams(text)))) == whole).all()


def test_quality_learns_and_takes_edges(spark):
    good = [(i, f"a plain sentence number {i} with words", "en", "x") for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! ${i}$ *** " * 3, "en", "x") for i in range(60)]
    docs = spark.createDataFrame([*good, *bad, (500, None, None, None), (501, "", None, None), (None, "a plain line", None, None),
                                  (502, "BUY!! NOW!! " * 20_000, None, None)], DOCS)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 60, 2)] + [(3, None), (None, 1), (7, 9)],
                                   "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(got[i].predicted == 1 for i in range(60)) and all(got[100 + i].predicted == 0 for i in range(60))
    assert got[502].predicted == 0 and got[None].predicted == 1
    assert got[500].score == got[501].score and all(0 <= r.score <= 1 for r in got.values())
    one = quality.fit(docs, labels.where("quality = 1"))
    assert quality.score(docs, one).where("score < 0.5").count() == 0
    none = quality.fit(docs, labels.where("doc_id < 0"))
    assert {r.score for r in quality.score(docs, none).select("score").distinct().collect()} == {0.5}
    assert quality.score(docs.where("doc_id < 0"), model).count() == 0


def test_descent_separates_by_hand():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3, 1]), np.array([3, 2])]
    y = np.array([1, 1, -1, -1])
    ratio = np.zeros(quality.SIZE)
    ratio[:4] = [1.0, 0.1, 0.1, -1.0]
    w, b = quality.descent(rows, y, ratio)
    margins = [y[i] * (sum(w[j] * ratio[j] for j in rows[i]) / np.linalg.norm(ratio[rows[i]]) + b) for i in range(4)]
    assert min(margins) > 0.9


def test_quality_held_out_accuracy(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.01"
    got = E.queries()["op3_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.where("predicted = quality").count() > 0.97 * got.count() > 0


def test_language_held_out_accuracy(spark):
    import __spark_entry__ as E

    sf = "/root/testdata/sf0.01"
    got = E.queries()["op1_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert held.where("lang_pred = lang").count() > 0.97 * held.count() > 0


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.tokenizer(RANKS, PATTERN).ranks, special_tokens={})


TEXTS = ["", " ", "hello world's end", "  \n\n\t x  ", "é漢字🙂 ½ ² __ -- 123,456", "<|endoftext|> don't", "a" * 5000, "ab" * 3000,
         "x" * 20 + "\u0085\x1c​ y", "ÉÈ'S 'll", "\r\n\r\n end"]


def test_encode_equals_the_library(library):
    t = bpe.tokenizer(RANKS, PATTERN)
    rng = np.random.default_rng(11)
    alphabet = list("ab the'sé漢 \n\t1_½🙂.E")
    more = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(800)]
    for text in TEXTS + more:
        raw = t.encode(text)
        assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == library.encode_ordinary(text), repr(text)
        assert t.decode(raw) == text.encode()


def test_rank_queue_orders_by_rank_then_position():
    q = bpe.RankQueue(70_000)
    entries = [(300, 5), (2, 9), (69_999, 0), (300, 1), (2, 3), (255, 8), (256, 7)]
    for rank, at in entries:
        q.push(rank, at)
    assert [q.pop() for _ in entries] == sorted(entries) and not q.root


def test_bpe_in_spark(spark, library):
    rows = [(i, t, "en", "ids") for i, t in enumerate(TEXTS)] + [(50, None, None, None), (None, "null id", None, None), (1, " ", "en", "ids")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string")
    out = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN)
    assert out.columns == ["doc_id", "text", "lang", "ids", "decoded"] and out.count() == len(rows)
    for r in out.collect():
        ids = library.encode_ordinary(r.text or "")
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and bytes(r.decoded) == (r.text or "").encode()
    both = bpe.round_trip(df, RANKS, PATTERN)
    assert both.columns == out.columns and sorted(map(repr, both.collect())) == sorted(map(repr, out.collect()))
    assert bpe.round_trip(df.where("doc_id < 0"), RANKS, PATTERN).count() == 0


def test_bpe_query_digests(spark, library):
    from tierline.llm.queries import op4_byte_bpe

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op4_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_crc_split(spark):
    import zlib

    from tierline.llm.common import crc_mod

    df = spark.createDataFrame([(i,) for i in (0, 7, 123456789, -5)], "doc_id long")
    for r in df.select("doc_id", crc_mod("doc_id", 4).alias("m")).collect():
        assert r.m == zlib.crc32(str(r.doc_id).encode()) % 4
    assert spark.createDataFrame([(None,)], "doc_id long").select(crc_mod("doc_id", 4).alias("m")).where(F.col("m").isNull()).count() == 1


def test_frequent_matches_outlast_a_full_table(monkeypatch):
    from tierline.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 4)
    t = bpe.Tokenizer({bytes([i]): i for i in range(256)}, r"\w+")
    merged, plain = [], t.merge
    monkeypatch.setattr(t, "merge", lambda piece: merged.append(piece) or plain(piece))
    for i in range(20):
        assert t.encode(f"often rare{i}") == b"".join(bytes([c, 0, 0, 0]) for c in f"oftenrare{i}".encode())
    assert merged.count(b"often") == 1 and len(t.kept) <= 4 and len(t.older) <= 4
