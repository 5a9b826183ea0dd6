"""Building and judging datasets: validation, inventory, splits, samples, change sets, metrics by tier, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivan.functions.text import fold, tokens
from scrivan.operators.analytics import AS_OF
from scrivan.operators.index import SQL as IDX
from scrivan.operators.index import doc_index, records, sql_fold, sql_tokens
from scrivan.operators.scoring import _CUT, RULES_SQL, SEARCHES, _rule_sql, rules
from scrivan.runtime import shared_dir
from scrivan.sources.tables import load

N = F.count


def manifest(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "synth_manifest").dropDuplicates(["row_id"])


_M = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY created_at) AS k_ FROM synth_manifest) WHERE k_ = 1)"


def validated(spark: SparkSession, d: str) -> DataFrame:
    """(check, level, n): records against the rules of the collection: type, size, name, kind against name, repeated content."""
    r = records(spark, d).select("id", "file_type", "file_size_bytes", "original_filename", "title")
    ext = F.lower(F.regexp_extract("original_filename", r"\.([A-Za-z0-9]+)$", 1))
    twice = F.count(F.lit(1)).over(Window.partitionBy("file_size_bytes", "title")) > 1
    tests = [("extension", "error", ~ext.isin("pdf", "png", "jpg", "jpeg", "tif", "tiff")), ("size", "error", (F.col("file_size_bytes") <= 0) | (F.col("file_size_bytes") > 50 * 1024 * 1024)), ("name", "warning", ~F.regexp_like("original_filename", F.lit(r"^[\p{L}\p{N} ._()\-]+$"))), ("kind", "error", ext != F.lower("file_type")), ("repeated", "warning", F.col("twice"))]
    counts = r.withColumn("twice", twice).agg(*[F.count_if(F.coalesce(t, F.lit(True))).alias(n) for n, _, t in tests])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.lit(k).alias("level"), F.col(n).alias("n")) for n, k, _ in tests])))


_EXT = r"lower(regexp_extract(original_filename, '\.([A-Za-z0-9]+)$', 1))"
VALID_SQL = rf"""WITH {IDX}, r AS (SELECT {_EXT} AS ext, lower(file_type) AS ft, file_size_bytes AS s, original_filename AS f, count(*) OVER (PARTITION BY file_size_bytes, title) > 1 AS twice FROM rec)
SELECT * FROM (SELECT 'extension' AS "check", 'error' AS level, count(*) FILTER (ext NOT IN ('pdf', 'png', 'jpg', 'jpeg', 'tif', 'tiff')) AS n FROM r UNION ALL SELECT 'size', 'error', count(*) FILTER (s <= 0 OR s > 52428800) FROM r UNION ALL SELECT 'name', 'warning', count(*) FILTER (NOT regexp_matches(f, '^[\p{{L}}\p{{N}} ._()\-]+$')) FROM r UNION ALL SELECT 'kind', 'error', count(*) FILTER (ext <> ft) FROM r UNION ALL SELECT 'repeated', 'warning', count(*) FILTER (twice) FROM r)"""


def inventory(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, source_file, file_type, file_size, pages, language, status): one record of the inventory each; nulls as empty text."""
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    vi = F.regexp_like("title", F.lit(r"[ăâđêôơưáàảãạéèẻẽẹíìỉĩịóòỏõọúùủũụýỳỷỹỵấầẩẫậắằẳẵặếềểễệốồổỗộớờởỡợứừửữự]"))
    return records(spark, d).select(F.col("id").alias("document_id"), e("original_filename").alias("source_file"), e("file_type").alias("file_type"), e("file_size_bytes").alias("file_size"), e("page_count").alias("pages"), F.when(vi, "vi").otherwise("en").alias("language"), e("ocr_status").alias("status"))


INVENTORY_SQL = f"WITH {IDX} SELECT id AS document_id, original_filename AS source_file, file_type, file_size_bytes::VARCHAR AS file_size, coalesce(page_count::VARCHAR, '') AS pages, CASE WHEN regexp_matches(title, '[ăâđêôơưáàảãạéèẻẽẹíìỉĩịóòỏõọúùủũụýỳỷỹỵấầẩẫậắằẳẵặếềểễệốồổỗộớờởỡợứừửữự]') THEN 'vi' ELSE 'en' END AS language, ocr_status AS status FROM rec"


def _export(spark: SparkSession, df: DataFrame, kind: str) -> str:
    import uuid

    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    w = df.write.option("header", True).option("quoteAll", True).option("escape", '"')
    (w.csv if kind == "csv" else df.write.json)(path)
    return path


def inventory_files(spark: SparkSession, d: str) -> DataFrame:
    """(kind, n, size): the inventory written as CSV and as JSON and read again by the readers of either."""
    t = inventory(spark, d)
    csv = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(_export(spark, t, "csv"))
    js = spark.read.schema(t.schema).json(_export(spark, t, "json"))
    return csv.agg(N(F.lit(1)).alias("n"), F.sum(F.col("file_size").cast("bigint")).alias("size")).select(F.lit("csv").alias("kind"), "n", "size").unionByName(js.agg(N(F.lit(1)).alias("n"), F.sum(F.col("file_size").cast("bigint")).alias("size")).select(F.lit("json").alias("kind"), "n", "size"))


INV_FILES_SQL = f"WITH {IDX}, s AS (SELECT count(*) AS n, sum(file_size_bytes)::BIGINT AS size FROM rec) SELECT 'csv' AS kind, n, size FROM s UNION ALL SELECT 'json', n, size FROM s"


def search_export(spark: SparkSession, d: str) -> DataFrame:
    """The export of a search: fifteen columns, marks taken out, tags joined, confidence with two places."""
    i = doc_index(spark, d)
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    snippet = F.regexp_replace(F.substring(F.coalesce("body", F.lit("")), 1, 100), "</?em>|\\s+", " ")
    t = F.date_format("created_at", "dd/MM/yyyy HH:mm:ss")
    return i.select(
        "id", s("title").alias("title"), F.trim(snippet).alias("snippet"), s("category_code").alias("category_code"), s("category_name").alias("category_name"), s("student_id").alias("student_id"), s("student_name").alias("student_name"), s("document_number").alias("document_number"),
        F.coalesce(F.array_join("tags", ", "), F.lit("")).alias("tags"), s("priority_score").alias("priority"), s("ocr_status").alias("status"), F.when(F.col("confidence_score").isNull(), "").otherwise(F.format_string("%.2f", F.round("confidence_score", 2))).alias("conf"), s("ocr_engine").alias("engine"), F.when(F.col("is_public"), "yes").otherwise("no").alias("public"), t.alias("created"),
    )


SEARCH_EXPORT_SQL = rf"WITH {IDX} SELECT id, coalesce(title, '') AS title, trim(regexp_replace(coalesce(body, '')[1:100], '</?em>|\s+', ' ', 'g')) AS snippet, coalesce(category_code, '') AS category_code, coalesce(category_name, '') AS category_name, coalesce(student_id, '') AS student_id, coalesce(student_name, '') AS student_name, coalesce(document_number, '') AS document_number, coalesce(array_to_string(tags, ', '), '') AS tags, coalesce(priority_score::VARCHAR, '') AS priority, ocr_status AS status, CASE WHEN confidence_score IS NULL THEN '' ELSE printf('%.2f', round(confidence_score, 2)) END AS conf, coalesce(ocr_engine, '') AS engine, CASE WHEN is_public THEN 'yes' ELSE 'no' END AS public, strftime(created_at, '%d/%m/%Y %H:%M:%S') AS created FROM idx"


def list_export(spark: SparkSession, d: str) -> DataFrame:
    """The export of the list: nine columns, confidence in per cent."""
    u = load(spark, d, "users").select(F.col("id").alias("uploaded_by"), "full_name")
    i = doc_index(spark, d).join(F.broadcast(u), "uploaded_by", "left")
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    return i.select("id", "title", s("category_name").alias("category"), s("student_name").alias("student"), s("document_number").alias("number"), s("full_name").alias("uploader"), "ocr_status", F.when(F.col("confidence_score").isNull(), "").otherwise(F.format_string("%.1f%%", F.round(100 * F.col("confidence_score"), 1))).alias("conf"), F.date_format("created_at", "dd/MM/yyyy HH:mm:ss").alias("created"))


LIST_SQL = f"WITH {IDX} SELECT idx.id, title, coalesce(category_name, '') AS category, coalesce(student_name, '') AS student, coalesce(document_number, '') AS number, coalesce(full_name, '') AS uploader, ocr_status, CASE WHEN confidence_score IS NULL THEN '' ELSE printf('%.1f%%', round(100 * confidence_score, 1)) END AS conf, strftime(idx.created_at, '%d/%m/%Y %H:%M:%S') AS created FROM idx LEFT JOIN users u ON u.id = uploaded_by"


def reindexed(spark: SparkSession, d: str) -> DataFrame:
    """(ocr_status, n, indexed, failed): the whole index written anew in one job and read again; records without a body fail."""
    path = f"{shared_dir(spark)}/index-{__import__('uuid').uuid4().hex}"
    doc_index(spark, d).write.partitionBy("ocr_status").parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy("ocr_status").agg(N(F.lit(1)).alias("n"), F.count("body").alias("indexed"), F.count_if(F.col("body").isNull()).alias("failed"))


REINDEX_SQL = f"WITH {IDX} SELECT ocr_status, count(*) AS n, count(body) AS indexed, count(*) FILTER (body IS NULL) AS failed FROM idx GROUP BY 1"


def appended_logs(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, action, detail): events as they are appended to the audit log, empty parts of the detail left out."""
    e = load(spark, d, "events")
    detail = F.to_json(F.struct(F.when(F.col("value") > 20, F.round("value", 1)).alias("value"), F.col("event_type").alias("kind")))
    return e.where("event_type in ('purchase', 'error')").select("event_id", "user_id", F.upper("event_type").alias("action"), detail.alias("detail"))


LOGS_SQL = """SELECT event_id, user_id, upper(event_type) AS action, CASE WHEN value > 20 THEN '{"value":' || round(value, 1)::VARCHAR || ',' ELSE '{' END || '"kind":"' || event_type || '"}' AS detail FROM events WHERE event_type IN ('purchase', 'error')"""


def grouped_split(spark: SparkSession, d: str) -> DataFrame:
    """(split, groups, n): groups by source file in the order of a hash: 70, 15 and 15 of a hundred, one at least each."""
    g = manifest(spark, d).withColumn("g", F.coalesce("doc_id", F.lit("-"))).groupBy("g").agg(N(F.lit(1)).alias("n")).withColumn("h", F.md5(F.concat(F.lit("42:"), "g")))
    ranked = g.withColumn("q", F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 4294967296)
    return ranked.groupBy(F.when(F.col("q") < 0.7, "train").when(F.col("q") < 0.85, "validation").otherwise("test").alias("split")).agg(N(F.lit(1)).alias("groups"), F.sum("n").alias("n"))


SPLIT_SQL = f"WITH g AS (SELECT coalesce(doc_id, '-') AS g, count(*) AS n FROM {_M} GROUP BY 1), q AS (SELECT g, n, ('0x' || md5('42:' || g)[1:8])::BIGINT / 4294967296 AS q FROM g) SELECT CASE WHEN q < 0.7 THEN 'train' WHEN q < 0.85 THEN 'validation' ELSE 'test' END AS split, count(*) AS groups, sum(n)::BIGINT AS n FROM q GROUP BY 1"


def split_disjointness(spark: SparkSession, d: str) -> DataFrame:
    """(kind, a, b, shared): how many documents, sources and lines two splits have in common; a good split shares no document."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("doc_id", "source", "text")])
    m = manifest(spark, d).where("split is not null").select("split", F.inline(keys)).where("key <> ''").distinct()
    return m.toDF("a", "kind", "key").join(m.toDF("b", "kind", "key"), ["kind", "key"]).where("a < b").groupBy("kind", "a", "b").agg(N(F.lit(1)).alias("shared"))


DISJOINT_SQL = "WITH m AS (" + " UNION ".join(f"SELECT '{k}' AS kind, split, {k} AS key FROM synth_manifest WHERE {k} <> '' AND split IS NOT NULL" for k in ("doc_id", "source", "text")) + ") SELECT kind, x.split AS a, y.split AS b, count(*) AS shared FROM m x JOIN m y USING (kind, key) WHERE x.split < y.split GROUP BY 1, 2, 3"


def review_sample(spark: SparkSession, d: str) -> DataFrame:
    """The same 150 documents each time, in the order of a hash; the sample is the operator."""
    h = F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))
    return load(spark, d, "documents").select("doc_id", h.alias("h")).orderBy("h", "doc_id").limit(150).select("doc_id")


SAMPLE_SQL = "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 150"


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """(row_id): one in twenty handwritten training rows, by a hash; the sample is the operator."""
    q = F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("row_id").cast("string"))), 1, 6), 16, 10).cast("bigint")
    return manifest(spark, d).where("split = 'train' and domain = 'handwritten'").where(q % 20 == 0).select("row_id")


HARD_SQL = f"SELECT row_id FROM {_M} WHERE split = 'train' AND domain = 'handwritten' AND ('0x' || md5('7:' || row_id::VARCHAR)[1:6])::BIGINT % 20 = 0"


def archive_split(spark: SparkSession, d: str) -> DataFrame:
    """(part, n, first_row): the archive's rows in the order of a hash, nine tenths and one tenth."""
    q = F.conv(F.substring(F.md5(F.concat(F.lit("42-"), F.col("row_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296
    return manifest(spark, d).where("text <> ''").groupBy(F.when(q < 0.9, "train").otherwise("val").alias("part")).agg(N(F.lit(1)).alias("n"), F.min("row_id").alias("first_row"))


ARCHIVE_SQL = f"SELECT CASE WHEN ('0x' || md5('42-' || row_id::VARCHAR)[1:8])::BIGINT / 4294967296 < 0.9 THEN 'train' ELSE 'val' END AS part, count(*) AS n, min(row_id) AS first_row FROM {_M} WHERE text <> '' GROUP BY 1"


def type_backfill(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, old, new): the change set of types that a rule would set: none where one was given; with it the change can be applied or undone."""
    x = fold("text")
    new = F.when(x.startswith("thong bao"), "THONG_BAO").when(x.startswith("quyet dinh"), "QUYET_DINH").when(x.startswith("bien ban"), "BIEN_BAN").when(x.startswith("don "), "DON_TU")
    return load(spark, d, "documents").where("doc_type_code is null").select("doc_id", F.lit("").alias("old"), new.alias("new")).where("new is not null")


BACKFILL_SQL = f"SELECT doc_id, '' AS old, new FROM (SELECT doc_id, CASE WHEN starts_with(x, 'thong bao') THEN 'THONG_BAO' WHEN starts_with(x, 'quyet dinh') THEN 'QUYET_DINH' WHEN starts_with(x, 'bien ban') THEN 'BIEN_BAN' WHEN starts_with(x, 'don ') THEN 'DON_TU' END AS new FROM (SELECT doc_id, {sql_fold('text')} AS x FROM documents WHERE doc_type_code IS NULL)) WHERE new IS NOT NULL"


def chunked(text: Column, size: int = 25) -> Column:
    """A text in chunks of at most ``size`` characters, cut between words; a longer word is a chunk by itself."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    join = lambda a, w: F.when(a["last"] == "", F.struct(a["done"].alias("done"), w.alias("last"))).when(F.length(a["last"]) + 1 + F.length(w) <= size, F.struct(a["done"].alias("done"), F.concat(a["last"], F.lit(" "), w).alias("last"))).otherwise(F.struct(F.concat(a["done"], F.array(a["last"])).alias("done"), w.alias("last")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("last"))
    return F.aggregate(words, start, join, lambda a: F.when(a["last"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["last"]))))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "ocr_comparison").dropDuplicates(["image"]).select("image", chunked(F.col("ground_truth")).alias("c"))
    return c.select("image", F.array_join("c", "|").alias("chunks"))


CHUNK_SQL = r"""WITH RECURSIVE w AS (SELECT image, list_filter(regexp_split_to_array(ground_truth, '\s+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT image, ground_truth FROM ocr_comparison)), r AS (SELECT image, w, 0 AS k, '' AS out, '' AS last FROM w UNION ALL SELECT image, w, k + 1, CASE WHEN last = '' OR length(last) + 1 + length(w[k + 1]) <= 25 THEN out ELSE out || last || '|' END, CASE WHEN last = '' THEN w[k + 1] WHEN length(last) + 1 + length(w[k + 1]) <= 25 THEN last || ' ' || w[k + 1] ELSE w[k + 1] END FROM r WHERE k < len(w)) SELECT image, out || last AS chunks FROM r WHERE k = len(w)"""


def engine_report(spark: SparkSession, d: str) -> DataFrame:
    """(ocr_engine, chars, words, ms, conf, done): what each engine gave."""
    r = load(spark, d, "ocr_results").dropDuplicates(["id"])
    return r.groupBy("ocr_engine").agg(F.sum(F.length("raw_text")).alias("chars"), F.sum(F.when(F.col("raw_text").isNotNull(), F.size(F.filter(F.split("raw_text", r"\s+"), lambda w: w != "")))).alias("words"), F.round(F.avg("processing_time_ms"), 3).alias("ms"), F.round(F.avg("confidence_score"), 6).alias("conf"), F.count_if(F.col("status") == "DONE").alias("done"))


REPORT_SQL = r"SELECT ocr_engine, sum(length(raw_text))::BIGINT AS chars, sum(len(list_filter(regexp_split_to_array(raw_text, '\s+'), lambda w: w <> '')))::BIGINT AS words, round(avg(processing_time_ms), 3) AS ms, round(avg(confidence_score), 6) AS conf, count(*) FILTER (status = 'DONE') AS done FROM (SELECT DISTINCT id, ocr_engine, raw_text, processing_time_ms, confidence_score, status FROM ocr_results) GROUP BY 1"

def tier_metrics(spark: SparkSession, d: str) -> DataFrame:
    """(tier, n, p5, p10, recall10, f1, mrr): the rule scorer judged by tier and over all (null) in one rollup; relevant is a title with a query word of three letters or more."""
    words = spark.createDataFrame([(q, w) for q, text in SEARCHES.items() for w in _plain(text) if len(w) > 2], "qid int, word string")
    t = doc_index(spark, d).select("id", F.explode(F.array_distinct(tokens("title"))).alias("word"))
    relevant = t.join(F.broadcast(words), "word").select("qid", "id").distinct()
    total = relevant.groupBy("qid").agg(N(F.lit(1)).alias("total"))
    j = rules(spark, d).where("rank <= 10").join(relevant.withColumn("rel", F.lit(1)), ["qid", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    cut = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))
    each = j.groupBy("qid").agg(cut(5).alias("h5"), cut(10).alias("h10"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    every = spark.createDataFrame([(q,) for q in SEARCHES], "qid int").join(each, "qid", "left").join(F.broadcast(total), "qid", "left")
    p10, r10 = F.coalesce(F.col("h10") / 10, F.lit(0.0)), F.coalesce(F.col("h10") / F.col("total"), F.lit(0.0))
    m = every.select(F.when(F.col("qid") <= 4, "EASY").when(F.col("qid") <= 8, "HARD").otherwise("NEGATIVE").alias("tier"), F.coalesce(F.col("h5") / 5, F.lit(0.0)).alias("p5"), p10.alias("p10"), r10.alias("r10"), F.when(p10 + r10 > 0, 2 * p10 * r10 / (p10 + r10)).otherwise(0.0).alias("f1"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))
    return m.rollup("tier").agg(N(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("p5", "p5"), ("p10", "p10"), ("r10", "recall10"), ("f1", "f1"), ("rr", "mrr"))])


def _plain(text: str) -> list[str]:
    from scrivan.operators.lexicon import folded

    return folded(text).split()


_WORDS = ", ".join(f"({q}, '{w}')" for q, text in SEARCHES.items() for w in _plain(text) if len(w) > 2)
TIER_SQL = f"""WITH {_rule_sql()}, {_CUT}, ranked AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, created_at DESC, id) AS rank FROM kept), words_ AS (SELECT * FROM (VALUES {_WORDS}) v(qid, word)),
rel AS (SELECT DISTINCT qid, id FROM (SELECT DISTINCT id, unnest({sql_tokens('title')}) AS word FROM idx) JOIN words_ USING (word)), tot AS (SELECT qid, count(*) AS total FROM rel GROUP BY 1),
e AS (SELECT r.qid, count(rel.id) FILTER (rank <= 5) AS h5, count(rel.id) AS h10, min(rank) FILTER (rel.id IS NOT NULL) AS first_ FROM ranked r LEFT JOIN rel ON rel.qid = r.qid AND rel.id = r.id WHERE rank <= 10 GROUP BY 1),
m AS (SELECT CASE WHEN s.qid <= 4 THEN 'EASY' WHEN s.qid <= 8 THEN 'HARD' ELSE 'NEGATIVE' END AS tier, coalesce(h5 / 5, 0) AS p5, coalesce(h10 / 10, 0) AS p10, coalesce(h10 / total, 0) AS r10, coalesce(1 / first_, 0) AS rr FROM (SELECT DISTINCT qid FROM spec) s LEFT JOIN e ON e.qid = s.qid LEFT JOIN tot ON tot.qid = s.qid)
SELECT tier, count(*) AS n, round(avg(p5), 6) AS p5, round(avg(p10), 6) AS p10, round(avg(r10), 6) AS recall10, round(avg(CASE WHEN p10 + r10 > 0 THEN 2 * p10 * r10 / (p10 + r10) ELSE 0 END), 6) AS f1, round(avg(rr), 6) AS mrr FROM m GROUP BY ROLLUP (tier)"""


def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    """(spec, n, first_id): what belongs to a search: its category, or a word in title or text, or a piece of a student number."""
    s = spark.createDataFrame([("announcements", "THONG_BAO", ["thong bao"]), ("budget", "", ["kinh phi", "budget"]), ("number", "", ["2000"])], "spec string, code string, must array<string>")
    i = doc_index(spark, d).select("id", "category_code", fold(F.concat_ws(" ", "title", "body")).alias("x"), F.coalesce("student_id", F.lit("")).alias("sid"))
    hit = (F.col("code") == F.coalesce("category_code", F.lit("-"))) | F.exists("must", lambda m: F.col("x").contains(m)) | F.col("sid").contains(F.element_at("must", 1))
    return i.join(F.broadcast(s), hit).groupBy("spec").agg(N(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


TRUTH_SQL = f"WITH {IDX}, i AS (SELECT id, category_code, {sql_fold('concat_ws(chr(32), title, body)')} AS x, coalesce(student_id, '') AS sid FROM idx), s AS (SELECT * FROM (VALUES ('announcements', 'THONG_BAO', ['thong bao']), ('budget', '', ['kinh phi', 'budget']), ('number', '', ['2000'])) v(spec, code, must)) SELECT spec, count(*) AS n, min(id) AS first_id FROM i JOIN s ON code = coalesce(category_code, '-') OR len(list_filter(must, lambda m: contains(x, m))) > 0 OR contains(sid, must[1]) GROUP BY 1"


def classifier_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """(label, truth, guessed, hits, accuracy): every class that occurs on either side, with the accuracy over all."""
    x = fold("text")
    g = F.when(x.startswith("thong bao"), "THONG_BAO").when(x.startswith("quyet dinh"), "QUYET_DINH").when(x.startswith("bien ban"), "BIEN_BAN").otherwise("KHAC")
    j = load(spark, d, "documents").where("doc_type_code is not null").groupBy(F.col("doc_type_code").alias("t"), g.alias("g")).agg(N(F.lit(1)).alias("n"))
    long = j.select(F.col("t").alias("label"), F.col("n").alias("truth"), F.lit(0).alias("guessed"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hits")).unionByName(j.select(F.col("g").alias("label"), F.lit(0).cast("bigint").alias("truth"), F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hits")).withColumn("guessed", F.col("guessed").cast("bigint")), allowMissingColumns=True)
    s = long.groupBy("label").agg(F.sum("truth").alias("truth"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits"))
    return s.withColumn("accuracy", F.round(F.sum("hits").over(Window.partitionBy()) / F.sum("truth").over(Window.partitionBy()), 6))  # a row a class


ACCURACY_SQL = f"WITH j AS (SELECT doc_type_code AS t, CASE WHEN starts_with(x, 'thong bao') THEN 'THONG_BAO' WHEN starts_with(x, 'quyet dinh') THEN 'QUYET_DINH' WHEN starts_with(x, 'bien ban') THEN 'BIEN_BAN' ELSE 'KHAC' END AS g FROM (SELECT doc_type_code, {sql_fold('text')} AS x FROM documents WHERE doc_type_code IS NOT NULL)), l AS (SELECT t AS label FROM j UNION SELECT g FROM j) SELECT label, (SELECT count(*) FROM j WHERE t = label) AS truth, (SELECT count(*) FROM j WHERE g = label) AS guessed, (SELECT count(*) FROM j WHERE t = label AND g = label) AS hits, (SELECT round(count(*) FILTER (t = g) / count(*), 6) FROM j) AS accuracy FROM l"


def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two engines over all lines: mean errors, exact lines in per cent, lines better and worse, and the worst lines' error."""
    c = load(spark, d, "ocr_comparison").dropDuplicates(["image"])
    pct = lambda x: F.round(100 * F.avg(F.when(F.col(f"exact_{x}") == "Yes", 1.0).otherwise(0.0)), 4).alias(f"exact_{x}")
    return c.agg(*[F.round(F.avg(f"{m}_{x}_pct"), 4).alias(f"{m}_{x}") for m in ("cer", "wer") for x in "ab"], pct("a"), pct("b"), F.count_if(F.col("cer_improvement_pct") > 0).alias("improved"), F.count_if(F.col("cer_improvement_pct") < 0).alias("regressed"), F.max("cer_b_pct").alias("worst"))


COMPARE_SQL = "SELECT " + ", ".join(f"round(avg({m}_{x}_pct), 4) AS {m}_{x}" for m in ("cer", "wer") for x in "ab") + ", " + ", ".join(f"round(100 * avg(CASE WHEN exact_{x} = 'Yes' THEN 1.0::DOUBLE ELSE 0 END), 4) AS exact_{x}" for x in "ab") + ", count(*) FILTER (cer_improvement_pct > 0) AS improved, count(*) FILTER (cer_improvement_pct < 0) AS regressed, max(cer_b_pct) AS worst FROM (SELECT DISTINCT * FROM ocr_comparison)"


def worst_lines(spark: SparkSession, d: str) -> DataFrame:
    """(image, cer, grade): the twenty lines with the greatest error; the limit is the report's."""
    c = load(spark, d, "ocr_comparison").dropDuplicates(["image"]).select("image", F.col("cer_a_pct").alias("cer"))
    return c.orderBy(F.desc("cer"), "image").limit(20).withColumn("grade", F.when(F.col("cer") < 2, "A").when(F.col("cer") < 5, "B").when(F.col("cer") < 15, "C").otherwise("D"))


WORST_SQL = "SELECT image, cer, CASE WHEN cer < 2 THEN 'A' WHEN cer < 5 THEN 'B' WHEN cer < 15 THEN 'C' ELSE 'D' END AS grade FROM (SELECT DISTINCT image, cer_a_pct AS cer FROM ocr_comparison ORDER BY cer DESC, image LIMIT 20)"


def page_confidence(spark: SparkSession, d: str) -> DataFrame:
    """(id, running, mean): the mean confidence of a record's runs as each is added, and over all."""
    w = Window.partitionBy("document_id").orderBy("created_at", "id")
    r = load(spark, d, "ocr_results").dropDuplicates(["id"]).where("confidence_score is not null")
    return r.select("id", F.round(F.avg("confidence_score").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running"), F.round(F.avg("confidence_score").over(Window.partitionBy("document_id")), 6).alias("mean"))


PAGE_SQL = "SELECT id, round(avg(c) OVER (PARTITION BY document_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running, round(avg(c) OVER (PARTITION BY document_id), 6) AS mean FROM (SELECT DISTINCT id, document_id, created_at, confidence_score AS c FROM ocr_results WHERE confidence_score IS NOT NULL)"


def scenario_groups(spark: SparkSession, d: str) -> DataFrame:
    """(event_type, total, passed, pct, mean, p50, p95): passed rows of each group, and values at a place of the sorted list."""
    g = load(spark, d, "events").groupBy("event_type").agg(N(F.lit(1)).alias("total"), F.count_if(F.col("value") < 40).alias("passed"), F.round(F.avg("value"), 4).alias("mean"), F.array_sort(F.collect_list("value")).alias("v"))
    at = lambda p: F.element_at("v", F.floor(F.col("total") * p).cast("int") + 1)
    return g.select("event_type", "total", "passed", F.round(100 * F.col("passed") / F.col("total"), 2).alias("pct"), "mean", at(0.5).alias("p50"), at(0.95).alias("p95"))


SCENARIO_SQL = "WITH g AS (SELECT event_type, count(*) AS total, count(*) FILTER (value < 40) AS passed, round(avg(value), 4) AS mean, list(value ORDER BY value) AS v FROM events GROUP BY 1) SELECT event_type, total, passed, round(100 * passed / total, 2) AS pct, mean, v[floor(total * 0.5)::INT + 1] AS p50, v[floor(total * 0.95)::INT + 1] AS p95 FROM g"


def text_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters over the manifest's lines: empty, unexpected characters, distinct characters and documents."""
    m = manifest(spark, d)
    chars = m.select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").agg(F.countDistinct("c").alias("characters"), N(F.lit(1)).alias("length"))
    odd = F.regexp_like("text", F.lit(r"[^\p{L}\p{M}\p{N}\s.,;:!?()/\-\"'%&+]"))
    return m.agg(N(F.lit(1)).alias("n"), F.count_if(F.col("text") == "").alias("empty"), F.count_if(odd).alias("odd"), F.countDistinct("doc_id").alias("documents")).crossJoin(chars)


COUNTER_SQL = rf"WITH m AS (SELECT * FROM {_M}), c AS (SELECT count(DISTINCT c) AS characters, count(*) AS length FROM (SELECT unnest(string_split(text, '')) AS c FROM m) WHERE c <> '') SELECT (SELECT count(*) FROM m) AS n, (SELECT count(*) FROM m WHERE text = '') AS empty, (SELECT count(*) FROM m WHERE regexp_matches(text, '[^\p{{L}}\p{{M}}\p{{N}}\s.,;:!?()/\-\"''%&+]')) AS odd, (SELECT count(DISTINCT doc_id) FROM m) AS documents, characters, length FROM c"


def waiting_compliance(spark: SparkSession, d: str) -> DataFrame:
    """(id, bucket, days, compliance): open records, overdue first and longest waiting first, with the share that is in time."""
    days = F.round((F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("created_at")) / 86400, 2)
    r = records(spark, d).where(F.col("ocr_status").isin("PENDING", "PROCESSING", "DONE")).select("id", days.alias("days")).withColumn("bucket", F.when(F.col("days") <= 90, "on_track").when(F.col("days") <= 180, "expiring").otherwise("overdue"))
    share = r.agg(F.round(100 * F.avg(F.when(F.col("bucket") != "overdue", 1.0).otherwise(0.0)), 1).alias("compliance"))
    order = F.when(F.col("bucket") == "overdue", 0).when(F.col("bucket") == "expiring", 1).otherwise(2)
    return r.crossJoin(F.broadcast(share)).orderBy(order, F.desc("days"), "id")


COMPLY_SQL = f"WITH {IDX}, r AS (SELECT id, round((epoch(TIMESTAMP '{AS_OF}')::BIGINT - floor(epoch(created_at::TIMESTAMP))::BIGINT) / 86400, 2) AS days FROM rec WHERE ocr_status IN ('PENDING', 'PROCESSING', 'DONE')), b AS (SELECT *, CASE WHEN days <= 90 THEN 'on_track' WHEN days <= 180 THEN 'expiring' ELSE 'overdue' END AS bucket FROM r) SELECT *, (SELECT round(100 * avg(CASE WHEN bucket <> 'overdue' THEN 1.0::DOUBLE ELSE 0 END), 1) FROM b) AS compliance FROM b"


def access_summary(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, n, kinds, things): accesses with their distinct actions and distinct things."""
    return load(spark, d, "events").groupBy("user_id").agg(N(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"), F.countDistinct(F.get_json_object("props", "$.k")).alias("things"))


SUMMARY_SQL = "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(DISTINCT props->>'$.k') AS things FROM events GROUP BY 1"


def trending_searches(spark: SparkSession, d: str) -> DataFrame:
    """(keyword, n, rank): the most asked words of two letters or more in the evaluation questions; the limit is the report's."""
    q = load(spark, d, "eval_items").select(F.explode(tokens("text")).alias("keyword")).where(F.length("keyword") >= 2).groupBy("keyword").agg(N(F.lit(1)).alias("n"))
    return q.orderBy(F.desc("n"), "keyword").limit(10).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "keyword")))  # ten rows


TRENDING_SQL = f"SELECT keyword, n, row_number() OVER (ORDER BY n DESC, keyword) AS rank FROM (SELECT keyword, count(*) AS n FROM (SELECT unnest({sql_tokens('text')}) AS keyword FROM eval_items) WHERE length(keyword) >= 2 GROUP BY 1 ORDER BY n DESC, keyword LIMIT 10)"


def merged_maps(spark: SparkSession, d: str) -> DataFrame:
    """(id, merged): two bags merged, the later one winning, nulls dropped, keys in order."""
    old = F.from_json("extra", "map<string,string>")
    new = F.map_from_arrays(F.array(F.lit("khoa_hoc"), F.lit("nguon"), F.lit("trong")), F.array(F.lit("2099"), F.lit("ocr"), F.lit(None).cast("string")))
    m = load(spark, d, "document_metadata").dropDuplicates(["id"]).where("extra is not null")
    # keys that come again leave the older bag first: no session setting decides which wins
    older = F.map_filter(F.coalesce(old, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~F.array_contains(F.map_keys(new), k))
    kept = F.map_filter(F.map_concat(older, new), lambda k, v: v.isNotNull())
    return m.select("id", F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("merged"))


MERGED_SQL = "WITH m AS (SELECT DISTINCT id, extra FROM document_metadata WHERE extra IS NOT NULL), e AS (SELECT id, k, extra->>('$.' || k) AS v FROM (SELECT id, extra, unnest(json_keys(extra)) AS k FROM m) WHERE k NOT IN ('khoa_hoc', 'nguon', 'trong') UNION ALL SELECT id, 'khoa_hoc', '2099' FROM m UNION ALL SELECT id, 'nguon', 'ocr' FROM m) SELECT id, string_agg(k || '=' || v, ';' ORDER BY k) AS merged FROM e WHERE v IS NOT NULL GROUP BY id"


def index_statistics(spark: SparkSession, d: str) -> DataFrame:
    """(field, filled, distinct_values, chars): every field of the index in one pass."""
    cols = ["title", "body", "student_id", "student_name", "document_number", "category_code", "ocr_engine", "file_type"]
    i = doc_index(spark, d)
    s = i.agg(*[x for c in cols for x in (F.count(c).alias(f"{c}_n"), F.countDistinct(c).alias(f"{c}_d"), F.sum(F.length(c)).alias(f"{c}_c"))])
    return s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_n").alias("filled"), F.col(f"{c}_d").alias("distinct_values"), F.col(f"{c}_c").alias("chars")) for c in cols])))


STATISTICS_SQL = f"WITH {IDX} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS filled, count(DISTINCT {c}) AS distinct_values, sum(length({c}))::BIGINT AS chars FROM idx" for c in ["title", "body", "student_id", "student_name", "document_number", "category_code", "ocr_engine", "file_type"])


def oldest_first(spark: SparkSession, d: str) -> DataFrame:
    """(id, place): records of unknown page number first, then by pages, oldest first: nulls have a defined place; thirty rows are the page."""
    r = records(spark, d).orderBy(F.asc_nulls_first("page_count"), F.asc("created_at"), "id").limit(30)
    return r.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_first("page_count"), F.asc("created_at"), "id"))).select("id", "place")  # thirty rows


OLDEST_SQL = f"WITH {IDX} SELECT id, row_number() OVER (ORDER BY page_count ASC NULLS FIRST, created_at, id) AS place FROM rec ORDER BY page_count ASC NULLS FIRST, created_at, id LIMIT 30"


def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """(id, tags): two tag lists one after the other, each tag where it first stands."""
    extra = F.array(F.concat(F.lit("#"), F.col("category_code")), F.lit("#HocKy1"), F.lit("#New"))
    i = doc_index(spark, d).where("category_code is not null").select("id", F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), extra)).alias("t"))
    return i.select("id", F.array_join("t", ",").alias("tags"))


UNION_SQL = f"WITH {IDX}, t AS (SELECT id, list_concat(coalesce(tags, []::VARCHAR[]), ['#' || category_code, '#HocKy1', '#New']) AS t FROM idx WHERE category_code IS NOT NULL) SELECT id, array_to_string(list_filter(t, lambda v, i: list_position(t, v) = i), ',') AS tags FROM t"


def rewritten_rows(spark: SparkSession, d: str) -> DataFrame:
    """(o_orderstatus, n, total): one set of rows changed and another deleted, by an anti-join and a union."""
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    gone = o.where("o_totalprice < 2000").select("o_orderkey")
    changed = o.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("X"))
    kept = o.join(changed.select("o_orderkey"), "o_orderkey", "left_anti").unionByName(changed).join(gone, "o_orderkey", "left_anti")
    return kept.groupBy("o_orderstatus").agg(N(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


REWRITE_SQL = "SELECT CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE NOT o_totalprice < 2000 GROUP BY 1"


def late_changes(spark: SparkSession, d: str) -> DataFrame:
    """(id, ocr_status): an upsert where changes come late: an older change never replaces a newer row."""
    from scrivan.sources.files import merged

    r = load(spark, d, "document_records").select("id", "ocr_status", "updated_at")
    odd = F.pmod(F.conv(F.substring("id", 1, 4), 16, 10).cast("int"), F.lit(2))
    late = r.where(odd == 1).withColumn("updated_at", F.col("updated_at") - F.expr("interval 400 days")).withColumn("ocr_status", F.lit("LATE"))
    return merged(r, late, "id", "updated_at").select("id", "ocr_status")


LATE_SQL = "SELECT id, ocr_status FROM (SELECT id, ocr_status, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS k FROM (SELECT id, ocr_status, updated_at FROM document_records UNION ALL SELECT id, 'LATE', updated_at - INTERVAL 400 DAYS FROM document_records WHERE ('0x' || id[1:4])::INT % 2 = 1)) WHERE k = 1"

CATALOG = {
    "validate_records": (validated, VALID_SQL), "inventory": (inventory, INVENTORY_SQL), "inventory_files": (inventory_files, INV_FILES_SQL), "search_export": (search_export, SEARCH_EXPORT_SQL), "list_export": (list_export, LIST_SQL), "reindex_all": (reindexed, REINDEX_SQL),
    "audit_append": (appended_logs, LOGS_SQL), "group_split": (grouped_split, SPLIT_SQL), "split_disjointness": (split_disjointness, DISJOINT_SQL), "review_sample": (review_sample, SAMPLE_SQL), "hard_negatives": (hard_negatives, HARD_SQL), "archive_split": (archive_split, ARCHIVE_SQL),
    "type_backfill": (type_backfill, BACKFILL_SQL), "text_chunks": (chunks, CHUNK_SQL), "engine_report": (engine_report, REPORT_SQL), "tier_metrics": (tier_metrics, TIER_SQL), "ground_truth_builder": (ground_truth, TRUTH_SQL), "classifier_accuracy": (classifier_accuracy, ACCURACY_SQL),
    "model_comparison": (model_comparison, COMPARE_SQL), "worst_lines": (worst_lines, WORST_SQL), "page_confidence": (page_confidence, PAGE_SQL), "scenario_groups": (scenario_groups, SCENARIO_SQL), "text_counters": (text_counters, COUNTER_SQL), "waiting_compliance": (waiting_compliance, COMPLY_SQL),
    "access_summary": (access_summary, SUMMARY_SQL), "trending_searches": (trending_searches, TRENDING_SQL), "merged_maps": (merged_maps, MERGED_SQL), "index_statistics": (index_statistics, STATISTICS_SQL), "oldest_first": (oldest_first, OLDEST_SQL), "ordered_union": (ordered_union, UNION_SQL),
    "rewritten_rows": (rewritten_rows, REWRITE_SQL), "late_changes": (late_changes, LATE_SQL),
}
