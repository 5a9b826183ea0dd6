"""Dashboards: facets, histograms, buckets, rankings over time, retrieval and recognition metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivan.functions.text import fold, tokens
from scrivan.operators.index import SQL as IDX
from scrivan.operators.index import doc_index, records, sql_fold, sql_tokens
from scrivan.operators.relational import AS_OF
from scrivan.operators.search import _BM25_SQL, bm25, query_terms, search_docs, top
from scrivan.operators.textops import edits_sql
from scrivan.sources.tables import load

N = F.count


def facets(spark: SparkSession, d: str) -> DataFrame:
    """(facet, value, n): category, status, year and file type in one pass of grouping sets."""
    i = doc_index(spark, d).select("category_code", "ocr_status", F.year("created_at").cast("string").alias("y"), "file_type")
    names = {"category": "category_code", "status": "ocr_status", "year": "y", "type": "file_type"}
    g = i.groupingSets([[c] for c in names.values()], *names.values()).agg(N(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in names.values()])
    facet = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.lit(n)) for n, c in names.items()])
    return g.select(facet.alias("facet"), F.coalesce(*names.values()).alias("value"), "n")


FACETS_SQL = f"WITH {IDX} SELECT CASE WHEN grouping(category_code) = 0 THEN 'category' WHEN grouping(ocr_status) = 0 THEN 'status' WHEN grouping(y) = 0 THEN 'year' ELSE 'type' END AS facet, coalesce(category_code, ocr_status, y::VARCHAR, file_type) AS value, count(*) AS n FROM (SELECT category_code, ocr_status, year(created_at) AS y, file_type FROM idx) GROUP BY GROUPING SETS ((category_code), (ocr_status), (y), (file_type))"


def month_histogram(spark: SparkSession, d: str) -> DataFrame:
    """(month, n): records of a rare kind per month, months without one included."""
    g = records(spark, d).where("ocr_status = 'REJECTED'").groupBy(F.trunc("created_at", "month").alias("month")).agg(N(F.lit(1)).alias("n"))
    span = g.agg(F.explode(F.expr("sequence(min(month), max(month), interval 1 month)")).alias("month"))
    return span.join(g, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


MONTH_SQL = f"WITH {IDX}, g AS (SELECT date_trunc('month', created_at::TIMESTAMP) AS m, count(*) AS n FROM rec WHERE ocr_status = 'REJECTED' GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(m) FROM g), (SELECT max(m) FROM g), INTERVAL 1 MONTH)) AS m) SELECT strftime(s.m, '%Y-%m') AS month, coalesce(n, 0)::BIGINT AS n FROM s LEFT JOIN g ON s.m = g.m"


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "ocr_results").dropDuplicates(["id"])
    conf = F.round(100 * F.avg("confidence_score"), 1)
    return r.groupBy("ocr_engine").agg(
        N(F.lit(1)).alias("n"), conf.alias("conf"), F.floor(F.avg("processing_time_ms")).cast("bigint").alias("ms"), F.count_if("is_corrected").alias("corrected"),
        F.greatest(F.lit(0.8), F.round((100 - conf) * 0.6, 2)).alias("error_estimate"), F.count_if(F.col("status") == "FAILED").alias("failed"),
    )


DASH_SQL = "SELECT ocr_engine, count(*) AS n, round(100 * avg(confidence_score), 1) AS conf, floor(avg(processing_time_ms))::BIGINT AS ms, count(*) FILTER (is_corrected) AS corrected, greatest(0.8, round((100 - round(100 * avg(confidence_score), 1)) * 0.6, 2)) AS error_estimate, count(*) FILTER (status = 'FAILED') AS failed FROM (SELECT DISTINCT id, ocr_engine, confidence_score, processing_time_ms, is_corrected, status FROM ocr_results) GROUP BY 1"


def quality_buckets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence_score")
    b = F.when(c >= 0.9, "a").when(c >= 0.75, "b").when(c >= 0.6, "c").otherwise("d")
    g = load(spark, d, "ocr_results").where(c.isNotNull()).dropDuplicates(["id"]).groupBy(b.alias("bucket")).agg(N(F.lit(1)).alias("n"))
    return g.select("bucket", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1).alias("pct"))  # four rows


QUALITY_SQL = "SELECT CASE WHEN c >= 0.9 THEN 'a' WHEN c >= 0.75 THEN 'b' WHEN c >= 0.6 THEN 'c' ELSE 'd' END AS bucket, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM (SELECT DISTINCT id, confidence_score AS c FROM ocr_results WHERE confidence_score IS NOT NULL) GROUP BY 1"


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """(id, urgency): unsure results, the least sure first, for a look by hand."""
    c = F.col("confidence_score")
    return doc_index(spark, d).where(c <= 0.75).select("id", F.when(c < 0.6, "URGENT").when(c < 0.7, "HIGH").otherwise("NORMAL").alias("urgency"))


REVIEW_SQL = f"WITH {IDX} SELECT id, CASE WHEN confidence_score < 0.6 THEN 'URGENT' WHEN confidence_score < 0.7 THEN 'HIGH' ELSE 'NORMAL' END AS urgency FROM idx WHERE confidence_score <= 0.75"


def waiting_buckets(spark: SparkSession, d: str) -> DataFrame:
    """(bucket, n, oldest): open records by days waited until a fixed day."""
    days = F.round((F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("created_at")) / 86400, 2)
    r = records(spark, d).where(F.col("ocr_status").isin("PENDING", "PROCESSING", "DONE")).withColumn("days", days)
    b = F.when(F.col("days") <= 90, "on_track").when(F.col("days") <= 180, "expiring").otherwise("overdue")
    return r.groupBy(b.alias("bucket")).agg(N(F.lit(1)).alias("n"), F.max("days").alias("oldest"))


WAITING_SQL = f"WITH {IDX} SELECT CASE WHEN days <= 90 THEN 'on_track' WHEN days <= 180 THEN 'expiring' ELSE 'overdue' END AS bucket, count(*) AS n, max(days) AS oldest FROM (SELECT round((epoch(TIMESTAMP '{AS_OF}')::BIGINT - floor(epoch(created_at::TIMESTAMP))::BIGINT) / 86400, 2) AS days FROM rec WHERE ocr_status IN ('PENDING', 'PROCESSING', 'DONE')) GROUP BY 1"


def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return doc_index(spark, d).select("id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(N(F.lit(1)).alias("n"), F.when(F.first("tag").startswith("#HocKy"), "term").otherwise("type").alias("kind"))


TAGS_SQL = f"WITH {IDX} SELECT tag, count(*) AS n, CASE WHEN starts_with(tag, '#HocKy') THEN 'term' ELSE 'type' END AS kind FROM (SELECT DISTINCT id, unnest(tags) AS tag FROM idx) GROUP BY tag"


def user_access(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").agg(N(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("which"))


ACCESS_SQL = "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS which FROM events GROUP BY user_id"


def staff_turnaround(spark: SparkSession, d: str) -> DataFrame:
    """(uploaded_by, n, hours): finished records per uploader and their mean hours from creation to last change."""
    r = records(spark, d).where(F.col("ocr_status").isin("APPROVED", "REJECTED"))
    hours = (F.unix_micros("updated_at") - F.unix_micros("created_at")) / 3.6e9
    return r.groupBy("uploaded_by").agg(N(F.lit(1)).alias("n"), F.round(F.avg(hours), 4).alias("hours"))


STAFF_SQL = f"WITH {IDX} SELECT uploaded_by, count(*) AS n, round(avg((epoch_us(updated_at) - epoch_us(created_at)) / 3.6e9), 4) AS hours FROM rec WHERE ocr_status IN ('APPROVED', 'REJECTED') GROUP BY 1"


def cube_breakdown(spark: SparkSession, d: str) -> DataFrame:
    i = doc_index(spark, d).select(F.coalesce("category_code", F.lit("-")).alias("category"), "ocr_status", "file_type")
    return i.cube("category", "ocr_status", "file_type").agg(N(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))


CUBE_SQL = f"WITH {IDX} SELECT category, ocr_status, file_type, count(*) AS n, grouping(category, ocr_status, file_type)::BIGINT AS level FROM (SELECT coalesce(category_code, '-') AS category, ocr_status, file_type FROM idx) GROUP BY CUBE (category, ocr_status, file_type)"


def rollup_revenue(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").withColumn("rev", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return li.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("rev"), 2).alias("revenue"), F.avg("l_quantity").alias("qty"), N(F.lit(1)).alias("n"))


ROLLUP_SQL = "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, avg(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"


def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


PIVOT_SQL = "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1"


def trending_terms(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    """(term, cur, prev, growth): title words of 2025 against 2024 by relative growth, for words met ten times."""
    t = doc_index(spark, d).select(F.year("created_at").alias("y"), F.explode(F.array_distinct(tokens("title"))).alias("term")).where(F.length("term") > 2)
    g = t.groupBy("term").agg(F.count_if(F.col("y") == 2025).alias("cur"), F.count_if(F.col("y") == 2024).alias("prev")).where("cur + prev >= 10 and prev > 0")
    return g.withColumn("growth", F.round(100 * (F.col("cur") / F.col("prev") - 1), 2)).orderBy(F.desc("growth"), "term").limit(k)


TREND_SQL = f"WITH {IDX}, t AS (SELECT DISTINCT id, year(created_at) AS y, unnest({sql_tokens('title')}) AS term FROM idx), g AS (SELECT term, count(*) FILTER (y = 2025) AS cur, count(*) FILTER (y = 2024) AS prev FROM t WHERE length(term) > 2 GROUP BY term HAVING count(*) FILTER (y IN (2024, 2025)) >= 10) SELECT term, cur, prev, round(100 * (cur / prev - 1), 2) AS growth FROM g WHERE prev > 0 ORDER BY growth DESC, term LIMIT 20"


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return load(spark, d, "events").groupBy("event_type").agg(*[F.round(F.percentile(v, F.lit(p)), 6).alias(f"p{int(100 * p)}") for p in (0.5, 0.9, 0.95, 0.99)], F.round(F.stddev_samp(v), 6).alias("sd"))


PERCENTILE_SQL = "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{int(100 * p)}" for p in (0.5, 0.9, 0.95, 0.99)) + ", round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1"


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """(qid, p5, p10, recall10, rr, ap): a ranking judged by whether a title holds the query's last word."""
    ranked = bm25(search_docs(spark, d), query_terms(spark)).withColumn("score", F.round("score", 6))
    ranked = top(ranked, "qid", 10, F.desc("score"), F.asc("id"))
    last = spark.createDataFrame([(1, "bong"), (2, "luat"), (3, "budget"), (4, "tam"), (5, "he")], "qid int, word string")
    relevant = doc_index(spark, d).select("id", fold("title").alias("t")).join(F.broadcast(last), F.col("t").contains(F.col("word"))).select("qid", "id")
    total = relevant.groupBy("qid").agg(N(F.lit(1)).alias("total"))
    judged = ranked.join(relevant.withColumn("rel", F.lit(1)), ["qid", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("hits", F.sum("rel").over(w)).join(F.broadcast(total), "qid", "left")
    cut = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))
    return judged.groupBy("qid").agg(
        F.round(cut(5) / 5, 6).alias("p5"), F.round(cut(10) / 10, 6).alias("p10"), F.round(F.least(F.lit(1.0), cut(10) / F.first("total")), 6).alias("recall10"),
        F.round(F.coalesce(1 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("rr"), F.round(F.sum(F.col("rel") * F.col("hits") / F.col("rank")) / F.least(F.first("total"), F.lit(10)), 6).alias("ap"),
    )


METRICS_SQL = f"""WITH {_BM25_SQL}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, id) AS rank FROM scored),
l AS (SELECT * FROM (VALUES (1, 'bong'), (2, 'luat'), (3, 'budget'), (4, 'tam'), (5, 'he')) v(qid, word)), rel AS (SELECT qid, id FROM idx JOIN l ON contains({sql_fold('title')}, word)), tot AS (SELECT qid, count(*) AS total FROM rel GROUP BY qid),
j AS (SELECT r.qid, rank, (rel.id IS NOT NULL)::INT AS rel FROM r LEFT JOIN rel ON r.qid = rel.qid AND r.id = rel.id WHERE rank <= 10), h AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM j)
SELECT qid, round(sum(rel) FILTER (rank <= 5) / 5, 6) AS p5, round(sum(rel) / 10, 6) AS p10, round(least(1.0, sum(rel) / any_value(total)), 6)::DOUBLE AS recall10, round(coalesce(1 / min(rank) FILTER (rel = 1), 0), 6) AS rr, round(sum(rel * hits / rank) / least(any_value(total), 10), 6) AS ap FROM h LEFT JOIN tot USING (qid) GROUP BY qid"""


def confusion(spark: SparkSession, d: str) -> DataFrame:
    """(truth, guess, n): the documents' type codes against a keyword rule."""
    docs = load(spark, d, "documents").where("doc_type_code is not null")
    x = fold("text")
    guess = F.when(x.startswith("thong bao"), "THONG_BAO").when(x.startswith("quyet dinh"), "QUYET_DINH").when(x.startswith("don "), "DON_TU").when(x.startswith("bien ban"), "BIEN_BAN").otherwise("KHAC")
    return docs.groupBy(F.col("doc_type_code").alias("truth"), guess.alias("guess")).agg(N(F.lit(1)).alias("n"))


_X = sql_fold("text")
CONFUSION_SQL = f"SELECT doc_type_code AS truth, CASE WHEN starts_with(x, 'thong bao') THEN 'THONG_BAO' WHEN starts_with(x, 'quyet dinh') THEN 'QUYET_DINH' WHEN starts_with(x, 'don ') THEN 'DON_TU' WHEN starts_with(x, 'bien ban') THEN 'BIEN_BAN' ELSE 'KHAC' END AS guess, count(*) AS n FROM (SELECT doc_type_code, {_X} AS x FROM documents WHERE doc_type_code IS NOT NULL) GROUP BY 1, 2"


def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = confusion(spark, d)
    hit = F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0))
    support = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    guessed = c.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    p, r = F.coalesce(F.col("tp") / F.col("guessed"), F.lit(0.0)), F.col("tp") / F.col("support")
    return support.join(guessed, "label", "left").select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


CLASS_SQL = f"WITH c AS ({CONFUSION_SQL}), s AS (SELECT truth AS label, sum(n) AS support, sum(CASE WHEN truth = guess THEN n ELSE 0 END) AS tp FROM c GROUP BY 1), g AS (SELECT guess AS label, sum(n) AS guessed FROM c GROUP BY 1), m AS (SELECT label, support, coalesce(tp / guessed, 0) AS p, tp / support AS r FROM s LEFT JOIN g USING (label)) SELECT label, support::BIGINT AS support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1 FROM m"


def recognition_errors(spark: SparkSession, d: str) -> DataFrame:
    """Micro and macro character error of two engines on the lines as they are, with shares of exact, better and worse lines."""
    c = load(spark, d, "ocr_comparison").dropDuplicates(["image"]).withColumn("n", F.length("ground_truth"))
    c = c.withColumns({f"e{x}": F.levenshtein("ground_truth", f"pred_{x}") for x in "ab"}).where("n > 0")
    return c.agg(
        *[F.round(100 * F.sum(f"e{x}") / F.sum("n"), 4).alias(f"micro_{x}") for x in "ab"], *[F.round(100 * F.avg(F.col(f"e{x}") / F.col("n")), 4).alias(f"macro_{x}") for x in "ab"],
        F.round(100 * F.avg(F.when(F.col("ea") == 0, 1.0).otherwise(0.0)), 4).alias("exact_a"), F.count_if(F.col("eb") < F.col("ea")).alias("improved"), F.count_if(F.col("eb") > F.col("ea")).alias("regressed"),
    )


_CHARS = lambda c: f"list_filter(string_split({c}, ''), lambda w: w <> '')"
ERRORS_SQL = f"""WITH c AS (SELECT DISTINCT image, {_CHARS('ground_truth')} AS g, {_CHARS('pred_a')} AS a, {_CHARS('pred_b')} AS b FROM ocr_comparison), e AS (SELECT len(g) AS n, {edits_sql('g', 'a')} AS ea, {edits_sql('g', 'b')} AS eb FROM c WHERE len(g) > 0)
SELECT round(100 * sum(ea) / sum(n), 4) AS micro_a, round(100 * sum(eb) / sum(n), 4) AS micro_b, round(100 * avg(ea / n), 4) AS macro_a, round(100 * avg(eb / n), 4) AS macro_b, round(100 * avg(CASE WHEN ea = 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS exact_a, count(*) FILTER (eb < ea) AS improved, count(*) FILTER (eb > ea) AS regressed FROM e"""


def dataset_statistics(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("file_size_bytes")
    return records(spark, d).groupBy(F.lower("file_type").alias("ext")).agg(N(F.lit(1)).alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.round(F.avg(size), 3).alias("mean"), F.sum(F.coalesce("page_count", F.lit(0))).alias("pages"))


STATS_SQL = f"WITH {IDX} SELECT lower(file_type) AS ext, count(*) AS n, min(file_size_bytes) AS least, max(file_size_bytes) AS most, round(avg(file_size_bytes), 3) AS mean, sum(coalesce(page_count, 0))::BIGINT AS pages FROM rec GROUP BY 1"


def offhours(spark: SparkSession, d: str) -> DataFrame:
    h = F.hour("ts")
    return load(spark, d, "events").where((h >= 22) | (h < 5)).groupBy("user_id", h.alias("hour")).agg(N(F.lit(1)).alias("n"))


OFF_SQL = "SELECT user_id, hour(ts)::INT AS hour, count(*) AS n FROM events WHERE hour(ts) >= 22 OR hour(ts) < 5 GROUP BY 1, 2"


def bulk_access(spark: SparkSession, d: str) -> DataFrame:
    g = load(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(N(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")).where("n >= 15")
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "users")


BULK_SQL = "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY time_bucket(INTERVAL 6 HOURS, ts), event_type HAVING count(*) >= 15"


def sliding_rate(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, n): events of users with more than six in the 24 hours up to and with them."""
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return load(spark, d, "events").select("event_id", "user_id", F.unix_micros("ts").alias("us")).withColumn("n", N(F.lit(1)).over(w)).where("n > 6").select("event_id", "n")


RATE_SQL = "SELECT event_id, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 6"


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, session, n): runs of a user's events with gaps below twelve hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, d, "events").withColumn("us", F.unix_micros("ts")).withColumn("new", F.when(F.col("us") - F.lag("us").over(w) < 43_200_000_000, 0).otherwise(1))
    e = e.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(N(F.lit(1)).alias("n"))


SESSIONS_SQL = "WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 43200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM e) SELECT user_id, session, count(*) AS n FROM s GROUP BY 1, 2"


def age_tiers(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.lit(AS_OF).cast("date"), F.col("created_at").cast("date"))
    return records(spark, d).groupBy(F.when(days < 365, "hot").when(days < 1095, "warm").when(days < 3650, "cold").otherwise("delete").alias("tier")).agg(N(F.lit(1)).alias("n"))


TIERS_SQL = f"WITH {IDX} SELECT CASE WHEN days < 365 THEN 'hot' WHEN days < 1095 THEN 'warm' WHEN days < 3650 THEN 'cold' ELSE 'delete' END AS tier, count(*) AS n FROM (SELECT date_diff('day', created_at::TIMESTAMP::DATE, DATE '2025-12-01') AS days FROM rec) GROUP BY 1"

CATALOG = {
    "facets_grouping_sets": (facets, FACETS_SQL), "month_histogram_gapfill": (month_histogram, MONTH_SQL), "dashboard_by_engine": (dashboard, DASH_SQL), "quality_buckets": (quality_buckets, QUALITY_SQL),
    "review_queue": (review_queue, REVIEW_SQL), "waiting_buckets": (waiting_buckets, WAITING_SQL), "tag_counts": (tag_counts, TAGS_SQL), "user_access": (user_access, ACCESS_SQL), "staff_turnaround": (staff_turnaround, STAFF_SQL),
    "cube_breakdown": (cube_breakdown, CUBE_SQL), "rollup_revenue": (rollup_revenue, ROLLUP_SQL), "pivot_status": (pivot_status, PIVOT_SQL), "trending_terms": (trending_terms, TREND_SQL), "percentiles": (percentiles, PERCENTILE_SQL),
    "retrieval_metrics": (retrieval_metrics, METRICS_SQL), "confusion_matrix": (confusion, CONFUSION_SQL), "class_metrics": (class_metrics, CLASS_SQL), "recognition_errors": (recognition_errors, ERRORS_SQL),
    "dataset_statistics": (dataset_statistics, STATS_SQL), "offhours_access": (offhours, OFF_SQL), "bulk_access": (bulk_access, BULK_SQL), "sliding_rate": (sliding_rate, RATE_SQL), "session_runs": (sessions, SESSIONS_SQL), "age_tiers": (age_tiers, TIERS_SQL),
}
