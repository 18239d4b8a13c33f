"""The registered queries of the text operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import common


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm import quality_rules

    judged = quality_rules.judge(common.documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm import fingerprints as fp

    rows = fp.edited(fp.with_next(common.documents(spark, sf_dir)))
    texts = {"fingerprint": fp.as_text(F.col("sketch")), "edited_fingerprint": fp.as_text(F.col("edited_sketch"))}
    contained = {f"in_{other}": fp.containment(F.col("sketch"), F.col(f"{other}_sketch")) for other in ("edited", "next")}
    rows = rows.withColumns(texts | contained)
    return rows.select("doc_id", "n_chars", "edited_sha256", *texts, "near_edited", "near_next", *contained, fp.shingle_count(F.col("sketch")).alias("n_shingles"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm import langid

    docs = common.documents(spark, sf_dir)
    held_out = common.fold_bucket("doc_id", 4) == 2
    return langid.predict(docs, langid.learn(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm import bpe

    return bpe.round_trip(common.documents(spark, sf_dir), tokenizer_path())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm import quality_fm

    docs = common.documents(spark, sf_dir)
    machine = quality_fm.fit(docs, common.labels(spark, sf_dir))
    scored = quality_fm.score(docs, machine, keep=["doc_id"])
    return scored.select("doc_id", (common.fold_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm import neardup

    return neardup.near_duplicates(common.documents(spark, sf_dir), width=2, similarity=80)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm import packing

    return packing.pack(common.documents(spark, sf_dir), tokenizer_path(), with_ids=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm import toxicity

    docs = common.documents(spark, sf_dir)
    grammar = toxicity.fit(docs, common.labels(spark, sf_dir))
    scored = toxicity.score(docs, grammar, keep=["doc_id"])
    return scored.select("doc_id", (common.fold_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm import licenses

    found = licenses.scan(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), F.size("sentence_ids").cast("long").alias("n_sentences"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm import suffix_dedup

    return suffix_dedup.digests(common.documents(spark, sf_dir)).drop("spans")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm import vector_codes

    common.ship(spark)
    coded = vector_codes.fit(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label_col="label")
    rows = vector_codes.with_label_error(coded.rows)
    return rows.select(F.col("id").alias("vec_id"), vector_codes.code_text(F.col("codes")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(coded.books)).alias("codebooks_sha256"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm import positional_index as pi

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = pi.search(pi.build(common.documents(spark, sf_dir)), items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logspark.llm import prefix_trie

    common.ship(spark)
    return prefix_trie.build(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_fingerprints": op2_fingerprints,
        "op3_language_id": op3_language_id,
        "op4_bpe": op4_bpe,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_near_dedup": op6_near_dedup,
        "op7_packing": op7_packing,
        "op8_toxicity": op8_toxicity,
        "op9_license_scan": op9_license_scan,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_vector_codes": op11_vector_codes,
        "op12_decontamination": op12_decontamination,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    from logspark.llm import licenses, positional_index, prefix_trie, quality_rules, vector_codes

    return {
        "op1_quality_rules": quality_rules.ORACLE,
        "op9_license_scan": licenses.oracle(),
        "op11_vector_codes": vector_codes.ORACLE,
        "op12_decontamination": positional_index.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
