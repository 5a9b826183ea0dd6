"""Filters, joins, windows, sets and aggregates over the record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivan.functions.text import fold
from scrivan.operators.index import SQL as IDX
from scrivan.operators.index import doc_index, latest, records, sql_fold
from scrivan.sources.tables import load

AS_OF = "2025-12-01 00:00:00"


def visible(role: str | None, user: str | None) -> Column:
    """Row-level security: staff see all, a user public rows and own ones, others public rows."""
    if role in ("ADMIN", "STAFF"):
        return F.lit(True)
    return F.col("is_public") | (F.col("uploaded_by") == user) if user else F.col("is_public")


USER = "3efa5363-835f-4c72-aad0-de55b5081a86"


def rls_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = records(spark, d)
    legs = [docs.where(visible(r, u)).select(F.lit(n).alias("viewer"), "id") for n, r, u in (("staff", "STAFF", None), ("user", "STUDENT", USER), ("anonymous", None, None))]
    return legs[0].unionByName(legs[1]).unionByName(legs[2]).groupBy("viewer").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


RLS_SQL = f"WITH {IDX} SELECT viewer, count(*) AS n, min(id) AS first_id FROM (SELECT 'staff' AS viewer, id FROM rec UNION ALL SELECT 'user', id FROM rec WHERE is_public OR uploaded_by = '{USER}' UNION ALL SELECT 'anonymous', id FROM rec WHERE is_public) GROUP BY viewer"


def multi_filter(spark: SparkSession, d: str) -> DataFrame:
    """Category, status, day range (its last day whole), tag without regard to case or sign, and confidence together."""
    docs = doc_index(spark, d).where(F.col("ocr_status").isin("DONE", "APPROVED") & (F.col("created_at") >= "2024-03-01") & (F.col("created_at") < F.expr("date'2025-06-30' + interval 1 day")))
    docs = docs.where(F.col("confidence_score").between(0.6, 0.95) & F.exists("tags", lambda t: F.regexp_replace(F.lower(t), "#", "") == "hocky1"))
    return docs.select("id", "category_code", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


MULTI_SQL = f"WITH {IDX} SELECT id, category_code, strftime(created_at, '%Y-%m-%d') AS day FROM idx WHERE ocr_status IN ('DONE', 'APPROVED') AND created_at >= TIMESTAMPTZ '2024-03-01 00:00:00+00' AND created_at < TIMESTAMPTZ '2025-07-01 00:00:00+00' AND confidence_score BETWEEN 0.6 AND 0.95 AND len(list_filter(tags, lambda t: replace(lower(t), '#', '') = 'hocky1')) > 0"


def approval_macro(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("ocr_status").isin("APPROVED", "REJECTED"), F.col("ocr_status")).otherwise("PENDING")
    return records(spark, d).groupBy(state.alias("approval")).agg(F.count(F.lit(1)).alias("n"))


APPROVAL_SQL = f"WITH {IDX} SELECT CASE WHEN ocr_status IN ('APPROVED', 'REJECTED') THEN ocr_status ELSE 'PENDING' END AS approval, count(*) AS n FROM rec GROUP BY 1"


def effective_status(spark: SparkSession, d: str) -> DataFrame:
    """A pending record with a finished run counts as done."""
    done = load(spark, d, "ocr_results").where("status = 'DONE'").select(F.col("document_id").alias("id")).distinct().withColumn("has", F.lit(True))
    r = records(spark, d).join(done, "id", "left")
    return r.groupBy(F.when((F.col("ocr_status") == "PENDING") & F.col("has"), "DONE").otherwise(F.col("ocr_status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


EFFECTIVE_SQL = f"WITH {IDX} SELECT CASE WHEN ocr_status = 'PENDING' AND id IN (SELECT document_id FROM ocr_results WHERE status = 'DONE') THEN 'DONE' ELSE ocr_status END AS status, count(*) AS n FROM rec GROUP BY 1"


def zero_categories(spark: SparkSession, d: str) -> DataFrame:
    cat = load(spark, d, "document_categories")
    r = load(spark, d, "document_records").where("not is_deleted and ocr_status = 'REJECTED'").select(F.col("id").alias("rid"), "category_id").distinct()
    return cat.join(r, cat.id == r.category_id, "left").groupBy("code").agg(F.count("rid").alias("n"))


ZERO_SQL = "SELECT code, count(r.id) AS n FROM document_categories c LEFT JOIN (SELECT DISTINCT id, category_id FROM document_records WHERE NOT is_deleted AND ocr_status = 'REJECTED') r ON c.id = r.category_id GROUP BY code"


def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    r, m = records(spark, d), load(spark, d, "document_metadata")
    kinds = [("with", "left_semi"), ("without", "left_anti")]
    legs = [r.join(m, r.id == m.document_id, how).select(F.lit(n).alias("kind"), "id") for n, how in kinds]
    return legs[0].unionByName(legs[1]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))


SEMI_SQL = f"WITH {IDX} SELECT kind, count(*) AS n, max(id) AS last_id FROM (SELECT 'with' AS kind, id FROM rec WHERE EXISTS (SELECT 1 FROM document_metadata m WHERE m.document_id = rec.id) UNION ALL SELECT 'without', id FROM rec WHERE NOT EXISTS (SELECT 1 FROM document_metadata m WHERE m.document_id = rec.id)) GROUP BY kind"


def like_or(spark: SparkSession, d: str) -> DataFrame:
    """Substring search over several columns of outer-joined tables, each record once."""
    i, u = doc_index(spark, d), load(spark, d, "users").select(F.col("id").alias("uploaded_by"), "full_name")
    hit = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("minh")
    return i.join(F.broadcast(u), "uploaded_by", "left").where(hit(F.col("title")) | hit(F.col("student_name")) | hit(F.col("full_name"))).select("id").distinct()


LIKE_SQL = f"WITH {IDX} SELECT DISTINCT idx.id FROM idx LEFT JOIN users u ON u.id = uploaded_by WHERE lower(title) LIKE '%minh%' OR lower(student_name) LIKE '%minh%' OR lower(full_name) LIKE '%minh%'"


def collisions(spark: SparkSession, d: str) -> DataFrame:
    """(serial, n_docs, first_id, last_id): citizen-number-like serials that stand in the texts of two records or more."""
    s = doc_index(spark, d).select("id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b(\d{12})\b"), F.lit(1)))).alias("serial"))
    return s.groupBy("serial").agg(F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n_docs > 1")


COLLISION_SQL = rf"WITH {IDX} SELECT serial, count(*) AS n_docs, min(id) AS first_id, max(id) AS last_id FROM (SELECT DISTINCT id, unnest(regexp_extract_all(body, '\b(\d{{12}})\b', 1)) AS serial FROM idx) GROUP BY serial HAVING count(*) > 1"


def replacement(spark: SparkSession, d: str) -> DataFrame:
    """(id, newer): for every rejected record the newest other record of its category."""
    r = records(spark, d)
    w = Window.partitionBy("category_id").orderBy(F.desc("created_at"), "id")
    newest = r.where("category_id is not null").withColumn("k", F.row_number().over(w)).where("k <= 2").select("category_id", F.col("id").alias("newer"), "k")
    met = r.where("ocr_status = 'REJECTED'").select("id", "category_id").join(newest, "category_id").where("id <> newer")
    return latest(met, "id", F.asc("k")).select("id", "newer")


REPLACEMENT_SQL = f"WITH {IDX} SELECT id, newer FROM (SELECT a.id, b.id AS newer, row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC, b.id) AS k FROM rec a JOIN rec b ON a.category_id = b.category_id AND a.id <> b.id WHERE a.ocr_status = 'REJECTED') WHERE k = 1"


def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """The preferred run of each record: corrected, then one engine, then the surest."""
    r = load(spark, d, "ocr_results").where("status = 'DONE'").dropDuplicates(["id"])
    rank = F.when(F.col("is_corrected"), 0).when(F.col("ocr_engine") == "vietocr", 1).otherwise(2)
    return latest(r, "document_id", rank, F.desc("confidence_score"), F.asc("id")).groupBy("ocr_engine", "is_corrected").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence_score"), 6).alias("conf"))


LATEST_SQL = "SELECT ocr_engine, is_corrected, count(*) AS n, round(avg(confidence_score), 6) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN is_corrected THEN 0 WHEN ocr_engine = 'vietocr' THEN 1 ELSE 2 END, confidence_score DESC, id) AS k FROM (SELECT DISTINCT id, document_id, is_corrected, ocr_engine, confidence_score FROM ocr_results WHERE status = 'DONE')) WHERE k = 1 GROUP BY 1, 2"


def topn_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return load(spark, d, "customer").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("c_nationkey", "c_custkey", "rank")


TOPN_SQL = "SELECT c_nationkey, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3"


def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("s"))
    return g.select("l_returnflag", F.round(100 * F.col("s") / F.sum("s").over(Window.partitionBy()), 6).alias("pct"))  # a handful of groups


SHARE_SQL = "SELECT l_returnflag, round(100 * sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (), 6) AS pct FROM lineitem GROUP BY l_returnflag"


def join_order_status(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a region by segment with the sum of their orders: two dimension joins broadcast, one on keys."""
    n = load(spark, d, "nation").join(F.broadcast(load(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = load(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"), F.count(F.lit(1)).alias("k"))
    return c.join(o, c.c_custkey == o.o_custkey).groupBy("r_name", "c_mktsegment").agg(F.round(F.sum("t"), 2).alias("total"), F.sum("k").alias("n_orders"))


JOIN_SQL = "SELECT r_name, c_mktsegment, round(sum(o_totalprice), 2) AS total, count(*)::BIGINT AS n_orders FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2"


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    """Offset pagination of the newest records: page 3 of 20, with the number of all pages."""
    r = records(spark, d)
    total = r.agg(F.ceil(F.count(F.lit(1)) / 20).alias("total_pages"))
    return r.orderBy(F.desc("created_at"), "id").offset(40).limit(20).select("id").crossJoin(F.broadcast(total))


PAGES_SQL = f"WITH {IDX} SELECT id, (SELECT ceil(count(*) / 20)::BIGINT FROM rec) AS total_pages FROM rec ORDER BY created_at DESC, id LIMIT 20 OFFSET 40"


def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    """(original_filename, place): the first 50 file names with digit runs compared as numbers."""
    key = F.array_join(F.transform(F.regexp_extract_all(F.lower("original_filename"), F.lit(r"\d+|\D+"), F.lit(0)), lambda p: F.when(F.regexp_like(p, F.lit(r"^\d")), F.concat(F.lpad(F.length(F.regexp_replace(p, "^0+", "")).cast("string"), 4, "0"), F.regexp_replace(p, "^0+", ""))).otherwise(p)), "")
    names = records(spark, d).select("original_filename").distinct().withColumn("key", key).orderBy("key", "original_filename").limit(50)
    return names.withColumn("place", F.row_number().over(Window.orderBy("key", "original_filename"))).select("original_filename", "place")  # 50 rows


NATURAL_SQL = rf"WITH {IDX} SELECT original_filename, row_number() OVER (ORDER BY k, original_filename) AS place FROM (SELECT DISTINCT original_filename, array_to_string(list_transform(regexp_extract_all(lower(original_filename), '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(length(regexp_replace(p, '^0+', ''))::VARCHAR, 4, '0') || regexp_replace(p, '^0+', '') ELSE p END), '') AS k FROM rec ORDER BY 2, 1 LIMIT 50)"


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    b = load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    legs = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "except_all": a.exceptAll(b)}
    parts = [df.agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s")).select(F.lit(k).alias("op"), "n", "s") for k, df in legs.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


SETS_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS op, count(*) AS n, sum(o_custkey)::BIGINT AS s FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' {op} SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"
    for k, op in (("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL"))
)


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Two stores compared by key and checksum: the record table against the runs' view of it."""
    sums = lambda df, c: df.groupBy("id").agg(F.md5(F.concat_ws("|", F.max("id"), F.max(c).cast("string"))).alias("sum"))
    a = sums(records(spark, d).select("id", F.col("ocr_status").alias("s")), "s").toDF("id", "sa")
    b = sums(load(spark, d, "ocr_results").where("is_latest").select(F.col("document_id").alias("id"), F.col("status").alias("s")), "s").toDF("id", "sb")
    status = F.when(F.col("sb").isNull(), "MISSING").when(F.col("sa").isNull(), "ORPHAN").when(F.col("sa") != F.col("sb"), "STALE").otherwise("OK")
    return a.join(b, "id", "full_outer").groupBy(status.alias("state")).agg(F.count(F.lit(1)).alias("n"))


RECONCILE_SQL = f"WITH {IDX}, a AS (SELECT id, md5(max(id) || '|' || max(ocr_status)) AS sa FROM rec GROUP BY id), b AS (SELECT document_id AS id, md5(max(document_id) || '|' || max(status)) AS sb FROM ocr_results WHERE is_latest GROUP BY 1) SELECT CASE WHEN sb IS NULL THEN 'MISSING' WHEN sa IS NULL THEN 'ORPHAN' WHEN sa <> sb THEN 'STALE' ELSE 'OK' END AS state, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY 1"


def student_profile(spark: SparkSession, d: str) -> DataFrame:
    """(student_id, total, approved, pending, codes): the records of each student number that has four or more."""
    i = doc_index(spark, d).where("student_id is not null").withColumn("student_id", F.regexp_replace("student_id", r"\D", ""))
    g = i.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("ocr_status") == "APPROVED").alias("approved"),
        F.count_if(F.col("ocr_status").isin("PENDING", "PROCESSING")).alias("pending"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("category_code", F.lit("KHAC")))), ",").alias("codes"),
    )
    return g.where("total >= 4")


PROFILE_SQL = rf"WITH {IDX} SELECT regexp_replace(student_id, '\D', '', 'g') AS student_id, count(*) AS total, count(*) FILTER (ocr_status = 'APPROVED') AS approved, count(*) FILTER (ocr_status IN ('PENDING', 'PROCESSING')) AS pending, string_agg(DISTINCT coalesce(category_code, 'KHAC'), ',' ORDER BY coalesce(category_code, 'KHAC')) AS codes FROM idx WHERE student_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 4"


def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """(tag_a, tag_b, n): tags that records carry together."""
    t = doc_index(spark, d).select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    return t.toDF("id", "tag_a").join(t.toDF("id", "tag_b"), "id").where("tag_a < tag_b").groupBy("tag_a", "tag_b").agg(F.count(F.lit(1)).alias("n"))


CO_SQL = f"WITH {IDX}, t AS (SELECT DISTINCT id, unnest(tags) AS tag FROM idx) SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM t a JOIN t b ON a.id = b.id AND a.tag < b.tag GROUP BY 1, 2"


def percolate(spark: SparkSession, d: str) -> DataFrame:
    """(alert, id): stored queries met by each title; every word of an alert must stand in the folded title."""
    alerts = spark.createDataFrame([("bus", "xe buyt"), ("loan", "khoan vay"), ("library", "thu vien"), ("budget", "budget"), ("notice", "thong bao")], "alert string, words string")
    docs = doc_index(spark, d).select("id", fold("title").alias("t"))
    return docs.join(F.broadcast(alerts), F.forall(F.split("words", " "), lambda w: F.col("t").contains(w))).select("alert", "id")


PERCOLATE_SQL = f"WITH {IDX}, d AS (SELECT id, {sql_fold('title')} AS t FROM idx), a AS (SELECT * FROM (VALUES ('bus', 'xe buyt'), ('loan', 'khoan vay'), ('library', 'thu vien'), ('budget', 'budget'), ('notice', 'thong bao')) v(alert, words)) SELECT alert, id FROM d JOIN a ON len(list_filter(string_split(words, ' '), lambda w: NOT contains(t, w))) = 0"


def integrity(spark: SparkSession, d: str) -> DataFrame:
    """(id, code): a short hash of each record's identifying fields."""
    text = F.concat_ws(":", "id", "title", F.col("file_size_bytes").cast("string"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    return records(spark, d).select("id", F.upper(F.substring(F.sha2(text, 256), 1, 16)).alias("code"))


INTEGRITY_SQL = f"WITH {IDX} SELECT id, upper(substring(sha256(concat_ws(':', id, title, file_size_bytes::VARCHAR, strftime(created_at, '%Y-%m-%d %H:%M:%S'))), 1, 16)) AS code FROM rec"


def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, last_error): the latest error (-1 for none) before each purchase of the same user, by one union and a running last value."""
    e = load(spark, d, "events").where("event_type in ('error', 'purchase')").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("last_error", last).where("event_type = 'purchase'").select("event_id", F.coalesce("last_error", F.lit(-1)).alias("last_error"))


AS_OF_SQL = "SELECT event_id, coalesce(last_error, -1) AS last_error FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_error FROM events WHERE event_type IN ('error', 'purchase')) WHERE event_type = 'purchase'"

CATALOG = {
    "rls_filter": (rls_filter, RLS_SQL),
    "multi_filter_search": (multi_filter, MULTI_SQL),
    "approval_macro": (approval_macro, APPROVAL_SQL),
    "effective_status": (effective_status, EFFECTIVE_SQL),
    "outer_join_zero_categories": (zero_categories, ZERO_SQL),
    "semi_anti_join": (semi_anti, SEMI_SQL),
    "like_or_search": (like_or, LIKE_SQL),
    "serial_collisions": (collisions, COLLISION_SQL),
    "newest_replacement": (replacement, REPLACEMENT_SQL),
    "preferred_run": (latest_run, LATEST_SQL),
    "topn_per_group": (topn_per_group, TOPN_SQL),
    "share_of_total": (share_of_total, SHARE_SQL),
    "multiway_join": (join_order_status, JOIN_SQL),
    "pagination": (pages_of, PAGES_SQL),
    "natural_sort": (natural_sort, NATURAL_SQL),
    "set_operations": (set_operations, SETS_SQL),
    "reconcile_stores": (reconcile, RECONCILE_SQL),
    "student_profile": (student_profile, PROFILE_SQL),
    "tag_cooccurrence": (co_occurrence, CO_SQL),
    "percolate_match": (percolate, PERCOLATE_SQL),
    "integrity_codes": (integrity, INTEGRITY_SQL),
    "as_of_join": (as_of_join, AS_OF_SQL),
}
