"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.common import table

SEQUENCE = 2048


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseflow.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), word_tokenizer(), SEQUENCE, end_id=0)


def op2_re_pair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseflow.llm.repair import read_documents, write_shards
    from caseflow.session import scratch_path

    path = scratch_path(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), word_tokenizer(), path, end_id=2)
    return read_documents(spark, path)


def op8_byte_convolution_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseflow.llm.langid import held_out, identify, label_rows, learn

    docs = table(spark, sf_dir, "documents")
    langs, net = learn(docs, label_rows())
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), langs, net).select(
        "doc_id", "held_out", "lang_pred", "score")


def op3_norm_bucketed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseflow.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op4_patience_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseflow.llm.licenses import scan

    shown = lambda h: F.concat_ws(
        ":", h["license"], h["start"].cast("string"), h["end"].cast("string"),
        F.concat_ws("/", h["matched"].cast("string"), h["words"].cast("string")))
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.size("licenses").cast("long").alias("n_hits"),
        F.array_max(F.transform("licenses", lambda h: h["matched"] / h["words"])).alias("coverage"),
        F.array_join(F.array_sort(F.array_distinct(F.col("licenses.license"))), ",").alias("found"),
        F.array_join(F.transform("licenses", shown), ",").alias("hits"))


def op5_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseflow.llm.jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op6_checksum_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseflow.llm.secret_scan import BASE_KINDS, scan

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scan(docs).select(
        "doc_id",
        *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_tokenizers_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseflow.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), piece_model(), threads=2)


# The rules of the URL query (action, host, path)
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op9_digest_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseflow.llm.urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseflow.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op11_ternary_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseflow.llm.prefix_trie import prefix_trie, rebuilt

    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


def op12_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseflow.llm.whitening import fit, whiten

    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors)).select(
        "vec_id", F.posexplode("components").alias("place", "c"), "n", "deviation", "identity_error").select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", F.expr("try_cast(deviation AS long)").alias("deviation"),
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


def op13_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseflow.llm.toxicity import held_out, learn, learn_rows, score

    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), learn_rows())
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "log_ratio", "worst_ratio")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sum_of_squares_packing": op1_sum_of_squares_packing,
    "op2_re_pair_shards": op2_re_pair_shards,
    "op3_norm_bucketed_top_k": op3_norm_bucketed_top_k,
    "op4_patience_license_scan": op4_patience_license_scan,
    "op5_jaccard_metric_join": op5_jaccard_metric_join,
    "op6_checksum_secret_scan": op6_checksum_secret_scan,
    "op7_tokenizers_sentencepiece": op7_tokenizers_sentencepiece,
    "op8_byte_convolution_language": op8_byte_convolution_language,
    "op9_digest_url_filter": op9_digest_url_filter,
    "op10_learned_partitions": op10_learned_partitions,
    "op11_ternary_prefix_trie": op11_ternary_prefix_trie,
    "op12_feast_whitening": op12_feast_whitening,
    "op13_kneser_ney_toxicity": op13_kneser_ney_toxicity,
}
