"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of their input.  Stages address rows by (doc_id, hash of the text), see the operators for their
treatment of nulls, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, lines, minhash, mixing, scratch, substring

#: Some stages (networks, alignment, near-duplicate links) have no SQL counterpart.
ORACLE_SQL = None


def _with_keys(docs: DataFrame, key: Column) -> tuple[DataFrame, str, str]:
    """Rows with their address, and the names of its two columns, which no input column has."""
    k, h = scratch.free(docs.columns, "stage_key", "stage_hash")
    return docs.withColumns({k: key, h: F.xxhash64("text")}), k, h


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is unknown: no letter, or a score that says nothing."""
    return langid.keep_identified(docs, langid.learn(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out; documents that had words and have none left are copies, and go."""
    rows, k, h = _with_keys(docs, substring.key_of("doc_id"))
    mark, parts = scratch.free(rows.columns, "stage_gone", "stage_parts")
    gone = lines.removed_lines(docs).select(F.col("k").alias(k), F.col("th").alias(h), F.col("gone").alias(mark))
    rows = lines.strip_lines(rows, gone, [k, h], "text", mark, parts)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(mark).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.where(F.col(mark).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each component of near duplicates.

    Of rows that repeat doc_id and text but differ elsewhere, the one whose other columns have the
    smallest hash as JSON stays.
    """
    found = minhash.near_duplicates(docs, size=5, percent=80)
    rows, k, h = _with_keys(docs, minhash.key_of("doc_id", "text"))
    keep = found.where("k = component").select(F.col("k").alias(k), F.col("th").alias(h)).distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    one = rows.join(keep, [k, h]).groupBy(k, h).agg(F.min_by(F.struct(*docs.columns), tie).alias("row"))
    return one.select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, an edited copy or a long excerpt of one."""
    found = decontam.passages_found(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(decontam.contaminating())
    rows, k, h = _with_keys(docs, substring.key_of("doc_id"))
    bad = scratch.table(found.select(F.col("k").alias(k), F.col("th").alias(h)).distinct(), "contaminated")
    return rows.join(bad, [k, h], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate documents to the target weights of their sources, in a global random order."""
    return mixing.poisson_mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written as Parquet and read again by the next."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch.scope(spark) as keep:  # what a stage wrote on its way goes when its result is there
            docs, path = scratch.written(stage(spark, docs, sf_dir), name)
            keep.append(path)
        if last:
            scratch.delete(spark, [last])
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
