"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..storage import table_path
from . import decontaminate, jaccard_join, langid, license_scan, line_dedup, packing, phrases, pii, quality_rules, token_output, toxicity, whitening, winnowing
from .common import word_array


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def id_remainder(column: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.dedup(docs, counts=("n_lines", "n_dropped"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), keys=["doc_id"], window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@lru_cache(maxsize=1)
def piece_vocabulary() -> str:
    return langid.default_vocabulary()


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False)))
    model = langid.fit(docs, vocab_path=piece_vocabulary(), may_learn=id_remainder("doc_id", 3) != 1, sample_by=F.xxhash64("doc_id"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = table_path(spark, "token-file")
    token_output.write(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_output.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), keep=["doc_id"], length=F.size(word_array(F.coalesce("text", F.lit("")))))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_next(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir), keep=["doc_id"])
    at = F.transform("places", lambda p: p["at"])
    base = F.transform("places", lambda p: p["label"])
    met = F.concat(*[F.transform(c, lambda b: F.struct(b["label"].alias("label"), b["containment"].alias("containment"))) for c in ("blocks", "notices")])
    more = F.transform(met, lambda b: b["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(met, lambda b: b["containment"])), F.lit(0.0))).alias("score"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"), may_learn=id_remainder("doc_id", 5) != 0)
    scored = quality_rules.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir), keep=["doc_id"])
    return found.select(
        "doc_id",
        *[F.size(f"{k}_spans").cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.listed(pii.BASE).cast("binary"), 256).alias("base_sha256"),
        pii.listed(list(pii.KINDS)).alias("spans"),
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), may_learn=id_remainder("doc_id", 5) != 0)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = (op1_line_dedup, op2_decontaminate, op3_language, op4_token_output, op5_ngram_jaccard, op6_packing, op7_winnowing, op8_license_scan, op9_quality, op10_pii, op11_phrases, op12_whitening, op13_toxicity)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
