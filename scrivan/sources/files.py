"""File sources and sinks: binary scans with checks, annotation files, exports, backups, latest-wins upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivan.operators.index import SQL as IDX
from scrivan.operators.index import doc_index, records
from scrivan.runtime import shared_dir
from scrivan.sources.tables import load

MOST_BYTES = 50 * 1024 * 1024


def magic_kind(content: Column) -> Column:
    """pdf, png, jpeg or tiff by a file's first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")


def scan_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, ext, kind, accepted): every file below a folder, checked by size, extension and first bytes."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = magic_kind(F.col("content"))
    same = F.when(ext.isin("jpg", "jpeg"), "jpeg").when(ext.isin("tif", "tiff"), "tiff").otherwise(ext)
    return f.dropDuplicates(["path"]).select("path", "length", ext.alias("ext"), kind.alias("kind"), ((F.col("length") <= MOST_BYTES) & F.coalesce(kind == same, F.lit(False))).alias("accepted"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image, label, skipped) of a tab-separated file; blank lines, comments and lines without a label are marked."""
    line = spark.read.text(path)
    parts = F.split("value", "\t", 2)
    label = F.trim(F.coalesce(F.get(parts, 1), F.lit("")))
    bad = (F.trim("value") == "") | F.col("value").startswith("#") | (label == "")
    return line.select(F.trim(F.get(parts, 0)).alias("image"), label.alias("label"), bad.alias("skipped"))


def export_csv(df: DataFrame, path: str) -> None:
    """All fields quoted, a byte-order mark before the first column's name, so that spreadsheets read it as UTF-8."""
    first, *rest = df.columns
    df.select(F.col(f"`{first}`").alias("﻿" + first), *[F.col(f"`{c}`") for c in rest]).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def export_table(spark: SparkSession, d: str) -> DataFrame:
    """The listing that is exported: joined tags, confidence in per cent, dates as day/month/year."""
    i = doc_index(spark, d)
    return i.select("id", "title", F.coalesce("category_name", F.lit("")).alias("category"), F.array_join("tags", ", ").alias("tags"), F.when(F.col("confidence_score").isNull(), "").otherwise(F.format_string("%.1f%%", F.round(100 * F.col("confidence_score"), 1))).alias("conf"), F.date_format("created_at", "dd/MM/yyyy HH:mm:ss").alias("created"))


EXPORT_SQL = f"WITH {IDX} SELECT id, title, coalesce(category_name, '') AS category, array_to_string(tags, ', ') AS tags, CASE WHEN confidence_score IS NULL THEN '' ELSE printf('%.1f%%', round(100 * confidence_score, 1)) END AS conf, strftime(created_at, '%d/%m/%Y %H:%M:%S') AS created FROM idx"


def exported(spark: SparkSession, d: str) -> DataFrame:
    """The listing written as CSV and read again."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    t = export_table(spark, d)
    export_csv(t, path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(path, schema=", ".join(f"`{c}` string" for c in t.columns), enforceSchema=True)
    return back.select("id", "title", F.coalesce("category", F.lit("")).alias("category"), "tags", F.coalesce("conf", F.lit("")).alias("conf"), "created")


def backup(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", False).json(path)


def restore(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(path)


def backup_round_trip(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark, d).select("id", "title", "page_count", "is_public", "created_at")
    path = f"{shared_dir(spark)}/backup-{uuid.uuid4().hex}"
    backup(r, path)
    return restore(spark, path, r).select("id", "title", F.coalesce("page_count", F.lit(-1)).alias("page_count"), "is_public", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


BACKUP_SQL = f"WITH {IDX} SELECT id, title, coalesce(page_count, -1) AS page_count, is_public, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM rec"


def merged(base: DataFrame, changes: DataFrame, key: str, order: str, gone: str | None = None) -> DataFrame:
    """Latest-wins upsert: of each key the row with the greatest order stays, the change where both are equal; rows marked as gone leave."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    out = both.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return (out.where(~F.coalesce(F.col(gone), F.lit(False))) if gone else out).drop("_k", "_new")


def upsert(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "document_records").select("id", "ocr_status", "updated_at", "is_deleted")
    base, changes = r.where("updated_at < '2024-12-01'"), r.where("updated_at >= '2024-12-01'")
    return merged(base, changes, "id", "updated_at", "is_deleted").groupBy("ocr_status").agg(F.count(F.lit(1)).alias("n"))


UPSERT_SQL = f"WITH {IDX} SELECT ocr_status, count(*) AS n FROM rec GROUP BY 1"


def assembled_pages(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, n_pages, text): the runs of a record as pages, in order, with a marker before each; blank ones are left out."""
    r = load(spark, d, "ocr_results").dropDuplicates(["id"]).where("length(trim(raw_text)) > 0").select("document_id", "created_at", "id", "raw_text")
    g = r.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "raw_text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("--- Trang "), (i + 1).cast("string"), F.lit(" ---\n"), x["raw_text"])), "\n\n")
    return g.select("document_id", F.size("p").alias("n_pages"), F.md5(text).alias("text_md5")).where("n_pages > 1")


PAGES_SQL = "SELECT document_id, count(*)::INT AS n_pages, md5(string_agg('--- Trang ' || k::VARCHAR || ' ---' || chr(10) || raw_text, chr(10) || chr(10) ORDER BY k)) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at, id) AS k FROM (SELECT DISTINCT id, document_id, created_at, raw_text FROM ocr_results WHERE length(trim(raw_text)) > 0)) GROUP BY 1 HAVING count(*) > 1"

CATALOG = {"export_csv": (exported, EXPORT_SQL), "backup_restore": (backup_round_trip, BACKUP_SQL), "upsert_latest_wins": (upsert, UPSERT_SQL), "page_assembly": (assembled_pages, PAGES_SQL)}
