"""The pipeline's stages on the smallest tables, each against its rule."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests_brute import components_of, plain_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10 ** 6, "12345 !!!", "en", "s", 9), (10 ** 6 + 1, None, "en", "s", 0), (10 ** 6 + 2, "", "en", "s", 0)], docs.schema)
    docs = docs.union(extra).union(docs.where("doc_id = 3"))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(spark.createDataFrame((got := stage(spark, out[-1], SF)).collect(), got.schema))
    return out


def test_all_but_the_last_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.schema.simpleString() == stages[0].schema.simpleString()


def test_language_stage_rejects_only_textless_rows(stages):
    gone = stages[0].select("doc_id").subtract(stages[1].select("doc_id"))
    assert {r.doc_id for r in gone.collect()} == {10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2}


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    first = {c for _, _, c in components_of(rows, 5, 80, 100)}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(first)


def test_leak_stage_drops_documents_with_items(stages, spark):
    from tierline.llm.decontaminate import compared

    items = [compared(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id: compared(r.text) for r in stages[3].collect()}
    assert not any(i in t for t in left.values() for i in items)
    gone = {r.doc_id: compared(r.text) for r in stages[2].collect() if r.doc_id not in left}
    assert gone and all(any(i in t for i in items) for t in gone.values())


def test_pii_stage_masks_every_base_span(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    for r in stages[4].collect():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        if not any(c in before[r.doc_id] for c in "0123456789@"):
            assert r.text == before[r.doc_id]


def test_last_stage_round_trips(stages, spark):
    assert stages[5].count() == stages[4].count() > 0
    assert stages[5].where(~F.col("round_trip")).count() == 0


def test_run_equals_the_stages(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[5].columns
    assert 0 < got.count() <= docs.count()


def test_language_stage_rejects_what_no_language_explains(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    foreign = ["今天天气很好我们一起去公园散步然后去吃饭", "今天2024年天气很好，我们一起去公园散步", "сегодня хорошая погода и мы пойдем гулять в парк вместе",
               "tänään on kaunis sää ja menemme yhdessä puistoon kävelemään ja syömään", "xkcd qzvw 9f8a jqxz wvkq pzzt mnbv qwrt " * 5]
    extra = [(10 ** 6 + n, t, label, "s", len(t)) for n, (t, label) in enumerate((t, x) for t in foreign for x in (None, "en"))]
    got = corpus_pipeline.language(spark, docs.union(spark.createDataFrame(extra, docs.schema)), SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.collect())


@pytest.mark.parametrize("written", [True, False])
def test_near_duplicate_stage_goes_by_row(spark, tmpdir_path, written):
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(60)) for c in "abcd")
    rows = [(7, one), (7, one + " end"), (7, one), (7, "other end " + one),        # one id, near copies
            (2, two), (5, two + " end"), (5, three),                               # the second 5 belongs to 2
            (None, three + " end"), (None, four), (None, four), (None, four + " end"), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", n) for n, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    if written:
        docs.repartition(3).write.parquet(f"{tmpdir_path}/docs")
        docs = spark.read.parquet(f"{tmpdir_path}/docs")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    got = [(r.doc_id, next((c for c in "abcd" if f"{c}0 " in r.text), "")) for r in out.collect()]
    assert sorted(got, key=repr) == [(2, "b"), (5, "c"), (7, "a"), (9, ""), (None, "d")]
