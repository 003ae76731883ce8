"""Registered queries of the subpackage: name -> (function, oracle SQL)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tierline.llm import align, bpe, decontaminate, langid, license_scan, ngram_join, oracles, pii, quality, secret_scan, separator_scan, substring_dedup, topk, trie
from tierline.llm.common import crc_mod, table
from tierline.session import scratch_dir

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
A_SIDE, B_SIDE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: An id beside the 50,256 ranks of the file.
END_OF_DOCUMENT = 50256


def _held_out(col: str, n: int, rest: int):
    return F.coalesce(crc_mod(col, n) == rest, F.lit(False))


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", _held_out("doc_id", 4, 2))
    model = langid.fit(docs.where(~F.col("held_out")))
    return (langid.predict(docs.select("doc_id", "held_out", "text"), model)
            .select("doc_id", "held_out", "lang_pred", "score"))


def _tiktoken():
    """The library's encoder for the rank file, built in a task."""
    import tiktoken

    ranks = bpe.tokenizer(RANKS, PATTERN).ranks
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def op2_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return separator_scan.token_counts(docs, scratch_dir(spark, "llm-tokens"), _tiktoken, END_OF_DOCUMENT)


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", _held_out("doc_id", 3, 1))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~_held_out("doc_id", 3, 1))
    model = quality.fit(docs.drop("held_out"), labels)
    return quality.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, RANKS, PATTERN).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.topk(vectors, F.col("vec_id") % 50 == 0, k=5)


def op6_ngram_jaccard(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op7_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs)).drop("text")
    base = F.filter("pii", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")],
                        F.sha2(pii.digest(base).cast("binary"), 256).alias("base_sha256"),
                        pii.digest(F.col("pii")).alias("spans"))


def op9_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.match(docs, table(spark, sf_dir, "benchmark"), null_ids=True)
    # the outer form: a filter inferred for the inner one would match twice
    return (found.select("doc_id", F.explode_outer("matches").alias("m")).where(F.col("m").isNotNull())
            .select("doc_id", "m.item_id", "m.distance", F.col("m.end").alias("match_end")))


def op11_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.detect(docs, secret_scan.fit(docs)).drop("text")
    base = F.filter("secrets", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in secret_scan.KINDS],
                        F.sha2(secret_scan.digest(base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.digest(F.col("secrets")).alias("spans"))


def op12_align(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align(docs, A_SIDE, B_SIDE).withColumn(
        "groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))).drop("groups")


def op13_prefix_trie(spark, sf_dir):
    turns = trie.placed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    turns, convs = trie.spliced(turns, lambda c: c - c % 5, lambda c: F.crc32(c.cast("string").cast("binary")) % 9, most_head=8)
    return trie.trie(turns, convs)


QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_token_counts": (op2_token_counts, None),
    "op3_quality": (op3_quality, None),
    "op4_byte_bpe": (op4_byte_bpe, None),
    "op5_topk": (op5_topk, oracles.TOP_K),
    "op6_ngram_jaccard": (op6_ngram_jaccard, oracles.JACCARD),
    "op7_license_scan": (op7_license_scan, oracles.license_sql()),
    "op8_pii": (op8_pii, None),
    "op9_substring_dedup": (op9_substring_dedup, oracles.REPEATS),
    "op10_decontaminate": (op10_decontaminate, None),
    "op11_secret_scan": (op11_secret_scan, None),
    "op12_align": (op12_align, None),
    "op13_prefix_trie": (op13_prefix_trie, oracles.PREFIX_TRIE),
}
