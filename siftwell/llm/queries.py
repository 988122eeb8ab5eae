"""The registered queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_quantization, euclidean_hashing, html_extraction, language_id, lexical_search, ngram_jaccard_join, norm_bucket_mining, oracles, packing, quality_classifier, quality_rules, training_order, url_filters
from .byte_bpe import ByteBpe, load_ranks
from .common import id_remainder, map_batches, table

#: Scores from here on count as good.
GOOD = 0.7
#: As the contract lists them.
HOST_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(table(spark, sf_dir, "pages"), id_col="page_id", url_col="url", html_col="html")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    labels = table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 4) != 2)
    return quality_classifier.fit(docs, labels, id_col="doc_id", text_col="text", label_col="quality")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality_classifier.score(docs, quality_model(spark, sf_dir, docs), id_col="doc_id", text_col="text")
    held = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op3_additive_quantization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quantization.search(table(spark, sf_dir, "embeddings"), id_col="vec_id", vector_col="embedding", is_query=lambda i: i % 20 == 0)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join.classes(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, id_col="doc_id", text_col="text", vocabulary=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)


def language_model(docs: DataFrame):
    return language_id.fit(docs.where(id_remainder(F.col("doc_id"), 3) != 1), id_col="doc_id", text_col="text", lang_col="lang")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_model(docs), id_col="doc_id", text_col="text")
    held = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def url_rules() -> list[url_filters.Rule]:
    return [url_filters.host_rule(*x) for x in HOST_RULES] + [url_filters.pattern_rule("block", f"^{x}^") for x in url_filters.BLOCKED_PARTS]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_rules(), id_col="page_id", url_col="url").drop("pattern")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    refs = quality_rules.references(docs, text_col="text", lang_col="lang")
    found = quality_rules.judge(docs, refs, id_col="doc_id", text_col="text")
    return found.withColumns({c: F.round(c, 4) for c in ("char_distance", "word_distance")})


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise_order(
        table(spark, sf_dir, "documents"),
        training_order.new_output(spark),
        id_col="doc_id",
        text_col="text",
        vocabulary=public_tokenizers.path("byte_bpe_50k.json"),
        pattern=public_tokenizers.PATTERN,
        key="epoch-0",
    )


_encoders: dict[str, ByteBpe] = {}


def multilingual_bpe() -> ByteBpe:
    """One encoder a worker, so that its cache of pre-tokens serves all the worker's tasks."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    if path not in _encoders:
        with open(path, "rb") as f:
            _encoders[path] = ByteBpe(load_ranks(f), public_tokenizers.PATTERN)
    return _encoders[path]


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        import hashlib

        bpe = multilingual_bpe()
        names = {i: str(i) for i in bpe.tokens}
        for b in batches:
            out: dict[str, list] = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in b["text"]:
                ids = bpe.encode(text)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield out

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return map_batches(docs, run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op11_norm_bucket_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return norm_bucket_mining.mine(moved, id_col="vec_id", vector_col="embedding", label_col="label", is_anchor=lambda i: i % 50 == 0)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")
    return lexical_search.search(table(spark, sf_dir, "benchmark"), index, item_col="item_id", text_col="text")


def op13_euclidean_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return euclidean_hashing.near_duplicates(table(spark, sf_dir, "embeddings"), id_col="vec_id", vector_col="embedding", label_col="label")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (
        op1_html_extraction,
        op2_quality_classifier,
        op3_additive_quantization,
        op4_ngram_jaccard_join,
        op5_best_fit_packing,
        op6_language_id,
        op7_url_filters,
        op8_quality_rules,
        op9_training_order,
        op10_byte_bpe,
        op11_norm_bucket_mining,
        op12_lexical_search,
        op13_euclidean_hashing,
        pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Whole results in SQL; the other queries are held against brute force in the tests."""
    return {
        "op3_additive_quantization": oracles.nearest_neighbours(),
        "op4_ngram_jaccard_join": oracles.jaccard_join(),
        "op7_url_filters": oracles.url_filters(HOST_RULES),
        "op8_quality_rules": oracles.quality_rules(),
        "op11_norm_bucket_mining": oracles.hard_negatives(),
        "op12_lexical_search": oracles.lexical_search(),
        "op13_euclidean_hashing": oracles.near_duplicate_vectors(),
    }
