"""The denormalised document index: one row per live record with its best text, metadata and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivan.sources.tables import load


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def records(spark: SparkSession, d: str) -> DataFrame:
    """Records as last delivered, without deleted ones."""
    return latest(load(spark, d, "document_records"), "id", F.desc("updated_at")).where(~F.col("is_deleted"))


def best_text(d: str, spark: SparkSession) -> DataFrame:
    """(document_id, body, confidence_score, ocr_engine): the latest run; corrected text before raw, blank counts as none."""
    r = load(spark, d, "ocr_results").where("is_latest")
    body = F.coalesce(F.expr("nullif(corrected_text, '')"), F.expr("nullif(raw_text, '')"))
    return r.select("id", "document_id", body.alias("body"), "confidence_score", "ocr_engine", "status").transform(lambda x: latest(x, "document_id", F.asc("id"))).drop("id")


def doc_index(spark: SparkSession, d: str) -> DataFrame:
    meta = latest(load(spark, d, "document_metadata"), "document_id", F.asc("id")).select("document_id", "student_id", "student_name", "document_number", "tags", "priority_score")
    cat = load(spark, d, "document_categories").select(F.col("id").alias("category_id"), F.col("code").alias("category_code"), F.col("name").alias("category_name"))
    r = records(spark, d).select("id", "title", "category_id", "uploaded_by", "ocr_status", "is_public", "created_at", "file_type")
    out = r.join(best_text(d, spark), r.id == F.col("document_id"), "left").drop("document_id")
    return out.join(meta, out.id == meta.document_id, "left").drop("document_id").join(F.broadcast(cat), "category_id", "left")


#: The same as SQL common table expressions.
SQL = """rec AS (SELECT * EXCLUDE (n_) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS n_ FROM document_records) WHERE n_ = 1 AND NOT is_deleted),
ocr AS (SELECT DISTINCT document_id, coalesce(nullif(corrected_text, ''), nullif(raw_text, '')) AS body, confidence_score, ocr_engine, status FROM ocr_results WHERE is_latest),
meta AS (SELECT DISTINCT document_id, student_id, student_name, document_number, tags, priority_score FROM document_metadata),
idx AS (SELECT rec.id, title, rec.category_id, uploaded_by, ocr_status, is_public, rec.created_at, file_type, body, confidence_score, ocr_engine, status, student_id, student_name, document_number, tags, priority_score, c.code AS category_code, c.name AS category_name
  FROM rec LEFT JOIN ocr ON rec.id = ocr.document_id LEFT JOIN meta ON rec.id = meta.document_id LEFT JOIN document_categories c ON c.id = rec.category_id)"""


def sql_fold(x: str) -> str:
    return f"trim(lower(strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D'))))"


def sql_tokens(x: str) -> str:
    return rf"regexp_extract_all({sql_fold(x)}, '[\p{{L}}\p{{N}}_]+')"
