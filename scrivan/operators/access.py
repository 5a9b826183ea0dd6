"""Who may see and change what: filters, masks by role, logs, tickets, limits, and the state of records over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivan.functions.text import fold, mask_pii
from scrivan.operators.index import SQL as IDX
from scrivan.operators.index import doc_index, latest, records, sql_fold
from scrivan.operators.relational import AS_OF, USER
from scrivan.sources.tables import load

N = F.count
SEARCH_ROLES, FIELD_ROLES = ("ADMIN", "STAFF"), ("ADMIN", "CTSV", "CTSV_STAFF", "MANAGER")


def similar_visible(spark: SparkSession, d: str) -> DataFrame:
    """(viewer, n): records beside which similar ones are shown: a student sees own and approved ones."""
    r = records(spark, d)
    legs = [r.where(F.lit(True) if who != "student" else (F.col("uploaded_by") == USER) | (F.col("ocr_status") == "APPROVED")).select(F.lit(who).alias("viewer")) for who in ("staff", "student")]
    return legs[0].unionByName(legs[1]).groupBy("viewer").agg(N(F.lit(1)).alias("n"))


SIMILAR_SQL = f"WITH {IDX} SELECT viewer, count(*) AS n FROM (SELECT 'staff' AS viewer FROM rec UNION ALL SELECT 'student' FROM rec WHERE uploaded_by = '{USER}' OR ocr_status = 'APPROVED') GROUP BY 1"


def time_range(name: str | None, as_of: str = AS_OF) -> tuple[str, str] | None:
    """First and last day of a named range; a half-year begins in August or February."""
    import datetime as dt

    now = dt.datetime.fromisoformat(as_of)
    days = {"today": 0, "1d": 1, "7d": 7, "week": 7, "30d": 30, "month": 30}
    if name in days:
        start = now - dt.timedelta(days=days[name])
    elif name in ("semester", "this_semester"):
        start = now.replace(month=8 if now.month >= 8 else 2, day=1)
    elif name in ("year", "this_year"):
        start = now.replace(month=1, day=1)
    else:
        return None
    return start.date().isoformat(), now.date().isoformat()


_RANGES = ["today", "7d", "30d", "this_semester", "this_year"]


def by_time_range(spark: SparkSession, d: str) -> DataFrame:
    """(span, n): records of each named range until a fixed day; the last day counts whole. One pass over the records."""
    day = F.col("created_at").cast("date").cast("string")
    legs = [F.when((day >= a) & (day <= b), F.lit(name)) for name in _RANGES for a, b in [time_range(name)]]
    return records(spark, d).select(F.explode(F.filter(F.array(*legs), lambda v: v.isNotNull())).alias("span")).groupBy("span").agg(N(F.lit(1)).alias("n"))


RANGE_SQL = f"WITH {IDX} " + " UNION ALL ".join(f"SELECT '{n}' AS span, count(*) AS n FROM rec WHERE created_at::TIMESTAMP::DATE BETWEEN DATE '{a}' AND DATE '{b}' HAVING count(*) > 0" for n in _RANGES for a, b in [time_range(n)])


def any_run_between(spark: SparkSession, d: str) -> DataFrame:
    """Records with one run of 0.9 or more and one (perhaps another) of 0.8 or less: a semi-join for each bound."""
    runs = load(spark, d, "ocr_results").select(F.col("document_id").alias("id"), "confidence_score")
    r = records(spark, d).join(runs.where("confidence_score >= 0.9"), "id", "left_semi").join(runs.where("confidence_score <= 0.8"), "id", "left_semi")
    return r.select("id", "ocr_status")


RUN_SQL = f"WITH {IDX} SELECT id, ocr_status FROM rec WHERE EXISTS (SELECT 1 FROM ocr_results o WHERE o.document_id = rec.id AND confidence_score >= 0.9) AND EXISTS (SELECT 1 FROM ocr_results o WHERE o.document_id = rec.id AND confidence_score <= 0.8)"


def metric_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose number in a JSON bag lies between bounds."""
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, d, "events").withColumn("k", k).where("k between 20 and 40").select("event_id", "k")


METRIC_SQL = "SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::INT BETWEEN 20 AND 40"

_LIKE = ["title", "original_filename", "student_id", "student_name", "document_number", "category_name", "full_name", "email", "username"]


def nine_columns(spark: SparkSession, d: str) -> DataFrame:
    """Records with a word in any of nine columns of four tables, each once."""
    u = load(spark, d, "users").select(F.col("id").alias("uploaded_by"), "full_name", "email", "username")
    names = records(spark, d).select("id", "original_filename")
    i = doc_index(spark, d).join(names, "id").join(F.broadcast(u), "uploaded_by", "left")
    return i.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains("thu") for c in _LIKE])).select("id").distinct()


NINE_SQL = f"WITH {IDX} SELECT DISTINCT idx.id FROM idx JOIN rec r ON r.id = idx.id LEFT JOIN users u ON u.id = idx.uploaded_by WHERE " + " OR ".join(f"lower({'idx.title' if c == 'title' else c}) LIKE '%thu%'" for c in _LIKE)

GROUPS = {"APPLICATIONS": ["DON_TU", "GIAY_XAC_NHAN"], "LISTS": ["DANH_SACH"], "LETTERS": ["CONG_VAN"], "ADMINISTRATION": ["THONG_BAO", "QUYET_DINH", "KE_HOACH", "TO_TRINH", "BIEN_BAN", "BAO_CAO"]}


def doc_groups(spark: SparkSession, d: str) -> DataFrame:
    """(doc_group, n): documents by group: a broadcast table of groups and codes."""
    g = spark.createDataFrame([(k, c) for k, v in GROUPS.items() for c in v], "doc_group string, doc_type_code string")
    return load(spark, d, "documents").join(F.broadcast(g), "doc_type_code").groupBy("doc_group").agg(N(F.lit(1)).alias("n"))


_PAIRS = ", ".join(f"('{k}', '{c}')" for k, v in GROUPS.items() for c in v)
GROUP_SQL = f"SELECT doc_group, count(*) AS n FROM documents JOIN (VALUES {_PAIRS}) g(doc_group, code) ON code = doc_type_code GROUP BY 1"


def tag_substring(spark: SparkSession, d: str) -> DataFrame:
    """Records with a tag that holds a piece of text, the whole tag compared before any page is cut."""
    i = doc_index(spark, d).where(F.lower(F.to_json("tags")).contains("hocky") & F.exists("tags", lambda t: F.lower(t).startswith("#hocky")))
    return i.select("id", F.size("tags").alias("n_tags"))


TAGS_SQL = f"WITH {IDX} SELECT id, len(tags)::INT AS n_tags FROM idx WHERE len(list_filter(tags, lambda t: starts_with(lower(t), '#hocky'))) > 0"


def identity_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Users found by any of their names: what was typed, in lower case, with and without the mail domain."""
    typed = [" Dat.Ly00@suonglam.example ", "lieuduong01", "nobody"]
    keys = sorted({k for t in typed for x in [t.strip().lower()] for k in (x, x.split("@")[0]) if len(k) >= 2})
    u = load(spark, d, "users")
    return u.where(F.lower("username").isin(keys) | F.lower("email").isin(keys) | F.lower(F.split("email", "@")[0]).isin(keys)).select("id", "username")


IDENTITY_SQL = "SELECT id, username FROM users WHERE lower(username) IN ('dat.ly00@suonglam.example', 'dat.ly00', 'lieuduong01', 'nobody') OR lower(email) IN ('dat.ly00@suonglam.example', 'dat.ly00', 'lieuduong01', 'nobody') OR lower(split_part(email, '@', 1)) IN ('dat.ly00@suonglam.example', 'dat.ly00', 'lieuduong01', 'nobody')"


def mask_number(col: Column, head: int, tail: int) -> Column:
    """The first and last places of a number, stars between; short ones are hidden whole."""
    return F.when(F.length(col) <= head + tail, "****").otherwise(F.concat(F.substring(col, 1, head), F.repeat(F.lit("*"), F.length(col) - head - tail), F.right(col, F.lit(tail))))


def _mask_sql(x: str, head: int, tail: int) -> str:
    return f"CASE WHEN length({x}) <= {head + tail} THEN '****' ELSE left({x}, {head}) || repeat('*', (length({x}) - {head + tail})::INT) || right({x}, {tail}) END"


def role_masks(spark: SparkSession, d: str) -> DataFrame:
    """(role, o_orderkey, citizen, phone, bank, text): columns and free text as each role sees them; a student sees own rows only."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.format_string("%012d", "o_orderkey").alias("citizen"), F.format_string("09%08d", "o_custkey").alias("phone"), F.format_string("9704%012d", "o_orderkey").alias("bank"))
    text = F.concat(F.lit("CCCD "), "citizen", F.lit(" DT "), "phone", F.lit(" STK "), "bank")
    o = o.withColumn("text", text)
    hidden = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\b(\d{8})\d{4}\b", "$1****"), r"\b(0\d{2})\d{4,5}(\d{3})\b", "$1****$2"), r"\b(\d{4})\d{4,8}(\d{2})\b", "$1****$2")
    plain = o.select(F.lit("ADMIN").alias("role"), "o_orderkey", "citizen", "phone", "bank", "text")
    other = lambda role, rows: rows.select(F.lit(role).alias("role"), "o_orderkey", mask_number(F.col("citizen"), 0, 4).alias("citizen"), mask_number(F.col("phone"), 3, 3).alias("phone"), mask_number(F.col("bank"), 4, 2).alias("bank"), hidden.alias("text"))
    return plain.unionByName(other("STAFF", o)).unionByName(other("STUDENT", o.where("o_custkey % 50 = 7")))


_O = "o AS (SELECT o_orderkey, o_custkey, citizen, phone, bank, 'CCCD ' || citizen || ' DT ' || phone || ' STK ' || bank AS text FROM (SELECT o_orderkey, o_custkey, printf('%012d', o_orderkey) AS citizen, printf('09%08d', o_custkey) AS phone, printf('9704%012d', o_orderkey) AS bank FROM orders))"
_HID = r"regexp_replace(regexp_replace(regexp_replace(text, '\b(\d{8})\d{4}\b', '\1****', 'g'), '\b(0\d{2})\d{4,5}(\d{3})\b', '\1****\2', 'g'), '\b(\d{4})\d{4,8}(\d{2})\b', '\1****\2', 'g')"
ROLE_SQL = f"WITH {_O} SELECT 'ADMIN' AS role, o_orderkey, citizen, phone, bank, text FROM o UNION ALL " + " UNION ALL ".join(f"SELECT '{r}', o_orderkey, {_mask_sql('citizen', 0, 4)}, {_mask_sql('phone', 3, 3)}, {_mask_sql('bank', 4, 2)}, {_HID} FROM o{w}" for r, w in (("STAFF", ""), ("STUDENT", " WHERE o_custkey % 50 = 7")))


def masked_texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, changed, text_md5): recognised texts as a viewer without rights gets them in a search."""
    r = load(spark, d, "ocr_results").dropDuplicates(["id"]).where("raw_text is not null").withColumn("m", mask_pii(F.col("raw_text")))
    return r.select("id", (F.col("m") != F.col("raw_text")).alias("changed"), F.md5("m").alias("text_md5"))


MASKED_SQL = r"SELECT id, m <> raw_text AS changed, md5(m) AS text_md5 FROM (SELECT id, raw_text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_text, '\b(\d{3})\d{6}(\d{3})\b', '\1******\2', 'g'), '\b(\d{3})\d{3}(\d{3})\b', '\1***\2', 'g'), '\b(0[35789]\d)\d{4}(\d{3})\b', '\1****\2', 'g'), '\b([A-Za-z0-9])[A-Za-z0-9._%+\-]*@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})', '\1***@\2', 'g'), '(STK|stk|tài khoản)(\W{0,3})(\d{4})\d{2,10}(\d{2})\b', '\1\2\3****\4', 'g') AS m FROM (SELECT DISTINCT id, raw_text FROM ocr_results WHERE raw_text IS NOT NULL))"


def token_masks(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, line): access-log lines with the tokens in their addresses hidden."""
    e = load(spark, d, "events")
    line = F.format_string("GET /files/%d?token=%s&page=%d ticket=%s", "event_id", F.md5(F.col("event_id").cast("string")), "user_id", F.sha1(F.col("user_id").cast("string")))
    return e.select("event_id", F.regexp_replace(line, r"(token|ticket|access_token|key)=[^&\s]+", "$1=***").alias("line"))


TOKEN_SQL = r"SELECT event_id, regexp_replace(printf('GET /files/%d?token=%s&page=%d ticket=%s', event_id, md5(event_id::VARCHAR), user_id, sha1(user_id::VARCHAR)), '(token|ticket|access_token|key)=[^&\s]+', '\1=***', 'g') AS line FROM events"


def outer_as_inner(spark: SparkSession, d: str) -> DataFrame:
    """An outer join that a condition on its right side turns into an inner one; the optimiser sees it."""
    r, c = records(spark, d), load(spark, d, "document_categories").select(F.col("id").alias("category_id"), "code", "is_active")
    return r.join(F.broadcast(c), "category_id", "left").where("is_active").groupBy("code").agg(N(F.lit(1)).alias("n"))


OUTER_SQL = f"WITH {IDX} SELECT code, count(*) AS n FROM rec LEFT JOIN document_categories c ON c.id = rec.category_id WHERE c.is_active GROUP BY 1"


def either_exists(spark: SparkSession, d: str) -> DataFrame:
    """Records that have a failed run, or metadata with a number, or an uploader who is a student: the OR of three existence flags."""
    one = lambda df, key, name: df.select(F.col(key).alias("id")).distinct().withColumn(name, F.lit(True))
    failed = one(load(spark, d, "ocr_results").where("status = 'FAILED'"), "document_id", "a")
    numbered = one(load(spark, d, "document_metadata").where("document_number like '%QĐ%'"), "document_id", "b")
    students = load(spark, d, "users").where("role_name = 'STUDENT'").select(F.col("id").alias("uploaded_by"), F.lit(True).alias("c"))
    r = records(spark, d).join(failed, "id", "left").join(numbered, "id", "left").join(F.broadcast(students), "uploaded_by", "left")
    return r.where("a or b or c").select("id")


EITHER_SQL = f"WITH {IDX} SELECT id FROM rec WHERE EXISTS (SELECT 1 FROM ocr_results o WHERE o.document_id = rec.id AND o.status = 'FAILED') OR EXISTS (SELECT 1 FROM document_metadata m WHERE m.document_id = rec.id AND m.document_number LIKE '%QĐ%') OR EXISTS (SELECT 1 FROM users u WHERE u.id = rec.uploaded_by AND u.role_name = 'STUDENT')"


def batched_children(spark: SparkSession, d: str) -> DataFrame:
    """(id, runs): every record with its runs in order, fetched by one join."""
    runs = load(spark, d, "ocr_results").dropDuplicates(["id"]).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "ocr_engine"))).alias("r"))
    return records(spark, d).join(runs, F.col("id") == F.col("document_id"), "left").select("id", F.coalesce(F.array_join(F.transform("r", lambda x: x["ocr_engine"]), ","), F.lit("")).alias("runs"))


BATCH_SQL = f"WITH {IDX}, g AS (SELECT document_id, string_agg(ocr_engine, ',' ORDER BY created_at, id) AS runs FROM (SELECT DISTINCT id, document_id, ocr_engine, created_at FROM ocr_results) GROUP BY 1) SELECT id, coalesce(runs, '') AS runs FROM rec LEFT JOIN g ON id = document_id"


def staff_records(spark: SparkSession, d: str) -> DataFrame:
    """(username, role_name, n, failed_latest): staff with their records; a run joins only where it is the latest, by the join's own condition."""
    u = load(spark, d, "users").where(F.col("role_name").isin("ADMIN", "STAFF")).select(F.col("id").alias("uploaded_by"), "username", "role_name")
    o = load(spark, d, "ocr_results").where("is_latest").dropDuplicates(["document_id"]).select(F.col("document_id").alias("id"), "status")
    return records(spark, d).join(F.broadcast(u), "uploaded_by").join(o, "id", "left").groupBy("username", "role_name").agg(N(F.lit(1)).alias("n"), F.count_if(F.col("status") == "FAILED").alias("failed_latest"))


STAFF_SQL = f"WITH {IDX} SELECT username, role_name, count(*) AS n, count(*) FILTER (o.status = 'FAILED') AS failed_latest FROM rec JOIN users u ON u.id = rec.uploaded_by AND u.role_name IN ('ADMIN', 'STAFF') LEFT JOIN (SELECT DISTINCT document_id, status, is_latest FROM ocr_results) o ON o.document_id = rec.id AND o.is_latest = true GROUP BY 1, 2"


def number_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, other): document numbers of one record that stand inside the text of another: the numbers of a text are exploded, so it is an equi-join."""
    pattern = r"\d{1,5}/[\p{L}]{1,4}-[\p{L}]{2,5}"
    own = doc_index(spark, d).select("id", F.regexp_extract("title", f"({pattern})", 1).alias("number")).where("number <> ''").distinct()
    held = doc_index(spark, d).select(F.col("id").alias("other"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(f"({pattern})"), F.lit(1)))).alias("number"))
    return own.join(held, "number").where("id <> other").select("id", "other").distinct()


_P = r"(\d{1,5}/[\p{L}]{1,4}-[\p{L}]{2,5})"
INSIDE_SQL = f"WITH {IDX}, o AS (SELECT DISTINCT id, regexp_extract(title, '{_P}', 1) AS number FROM idx), h AS (SELECT DISTINCT id AS other, unnest(regexp_extract_all(body, '{_P}', 1)) AS number FROM idx) SELECT DISTINCT id, other FROM o JOIN h USING (number) WHERE number <> '' AND id <> other"


def student_graph(spark: SparkSession, d: str) -> DataFrame:
    """(kind, source, target, weight): edges from students to their records, to class codes, and from classes to categories."""
    m = load(spark, d, "document_metadata").dropDuplicates(["id"]).select("document_id", F.regexp_replace("student_id", r"\D", "").alias("s"), F.upper(F.regexp_replace(F.get_json_object("extra", "$.lop"), r"[^\p{L}\p{N}]", "")).alias("c"))
    r = doc_index(spark, d).select(F.col("id").alias("document_id"), "category_code")
    j = m.join(r, "document_id")
    edge = lambda kind, a, b: j.where(F.col(a).isNotNull() & (F.col(a) != "") & F.col(b).isNotNull() & (F.col(b) != "")).groupBy(F.col(a).alias("source"), F.col(b).alias("target")).agg(N(F.lit(1)).alias("weight")).select(F.lit(kind).alias("kind"), "source", "target", "weight")
    return edge("owns", "s", "document_id").unionByName(edge("in_class", "s", "c")).unionByName(edge("files", "c", "category_code"))


_J = r"j AS (SELECT document_id, regexp_replace(student_id, '\D', '', 'g') AS s, upper(regexp_replace(lop, '[^\p{L}\p{N}]', '', 'g')) AS c, category_code FROM (SELECT DISTINCT id AS mid, document_id, student_id, extra->>'$.lop' AS lop FROM document_metadata) m JOIN (SELECT id, category_code FROM idx) i ON i.id = m.document_id)"
GRAPH_SQL = f"WITH {IDX}, {_J} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, {a} AS source, {b} AS target, count(*) AS weight FROM j WHERE {a} <> '' AND {b} <> '' GROUP BY 2, 3" for k, a, b in (("owns", "s", "document_id"), ("in_class", "s", "c"), ("files", "c", "category_code")))


def remaining_work(spark: SparkSession, d: str) -> DataFrame:
    """Work that is left: records whose key is not among those already done."""
    done = load(spark, d, "ocr_results").where("status = 'DONE'").select(F.col("document_id").alias("id"))
    return records(spark, d).join(done, "id", "left_anti").select("id", "ocr_status")


REMAIN_SQL = f"WITH {IDX} SELECT id, ocr_status FROM rec WHERE NOT EXISTS (SELECT 1 FROM ocr_results o WHERE o.document_id = rec.id AND o.status = 'DONE')"


def latest_per_engine(spark: SparkSession, d: str) -> DataFrame:
    """(id, is_latest): the flag recomputed: the newest run of each record and engine; an older one that comes late changes nothing."""
    r = load(spark, d, "ocr_results").dropDuplicates(["id"])
    w = Window.partitionBy("document_id", "ocr_engine").orderBy(F.desc("created_at"), F.desc("id"))
    return r.select("id", (F.row_number().over(w) == 1).alias("is_latest"))


ENGINE_SQL = "SELECT id, row_number() OVER (PARTITION BY document_id, ocr_engine ORDER BY created_at DESC, id DESC) = 1 AS is_latest FROM (SELECT DISTINCT id, document_id, ocr_engine, created_at FROM ocr_results)"


def store_drift(spark: SparkSession, d: str) -> DataFrame:
    """(status, missing, orphan, stale): how far two stores are apart; what can't be applied goes to a list of failures."""
    a = records(spark, d).select("id", F.col("ocr_status").alias("sa"))
    b = latest(load(spark, d, "ocr_results"), "document_id", F.desc("created_at"), F.desc("id")).select(F.col("document_id").alias("id"), F.col("status").alias("sb"))
    j = a.join(b, "id", "full_outer")
    g = j.agg(F.count_if(F.col("sb").isNull()).alias("missing"), F.count_if(F.col("sa").isNull()).alias("orphan"), F.count_if(F.col("sa") != F.col("sb")).alias("stale"))
    return g.select(F.when(F.col("missing") + F.col("orphan") + F.col("stale") == 0, "HEALTHY").otherwise("DRIFT_DETECTED").alias("status"), "missing", "orphan", "stale")


DRIFT_SQL = f"WITH {IDX}, b AS (SELECT document_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS k FROM (SELECT DISTINCT id, document_id, status, created_at FROM ocr_results)) WHERE k = 1), j AS (SELECT ocr_status AS sa, status AS sb FROM rec FULL JOIN b ON id = document_id), g AS (SELECT count(*) FILTER (sb IS NULL) AS missing, count(*) FILTER (sa IS NULL) AS orphan, count(*) FILTER (sa <> sb) AS stale FROM j) SELECT CASE WHEN missing + orphan + stale = 0 THEN 'HEALTHY' ELSE 'DRIFT_DETECTED' END AS status, missing, orphan, stale FROM g"


def applied_changes(spark: SparkSession, d: str) -> DataFrame:
    """(outcome, n): missing records are indexed, orphans deleted, stale ones rewritten; records without a title go to the failure list with a reason."""
    a = records(spark, d).select("id", "title", F.col("category_id").alias("ca"), F.col("updated_at").alias("ua"))
    b = load(spark, d, "document_metadata").dropDuplicates(["document_id"]).select(F.col("document_id").alias("id"), F.col("created_at").alias("ub"))
    kind = F.when(F.col("ua").isNull(), "DELETED").when(F.col("ca").isNull(), "FAILED: no category").when(F.col("ub").isNull(), "INDEXED").when(F.col("ua") > F.col("ub"), "REWRITTEN").otherwise("SAME")
    return a.join(b, "id", "full_outer").groupBy(kind.alias("outcome")).agg(N(F.lit(1)).alias("n"))


APPLIED_SQL = f"WITH {IDX}, b AS (SELECT document_id, any_value(created_at) AS ub FROM document_metadata GROUP BY 1) SELECT CASE WHEN rec.id IS NULL THEN 'DELETED' WHEN category_id IS NULL THEN 'FAILED: no category' WHEN ub IS NULL THEN 'INDEXED' WHEN updated_at > ub THEN 'REWRITTEN' ELSE 'SAME' END AS outcome, count(*) AS n FROM rec FULL JOIN b ON rec.id = document_id GROUP BY 1"


def progress(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, state, steps, regressions): the state that each user's events lead to; states only rise, so a lower one later counts as a regression."""
    order = F.create_map(*[F.lit(x) for kv in {"view": 10, "click": 35, "signup": 45, "purchase": 90, "error": 0}.items() for x in kv])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, d, "events").withColumn("p", order[F.col("event_type")]).where("p > 0").withColumn("best", F.max("p").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return e.groupBy("user_id").agg(F.max("p").alias("state"), N(F.lit(1)).alias("steps"), F.count_if(F.col("p") < F.col("best")).alias("regressions"))


PROGRESS_SQL = "WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 35 WHEN 'signup' THEN 45 WHEN 'purchase' THEN 90 ELSE 0 END AS p FROM events), b AS (SELECT user_id, p, max(p) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e WHERE p > 0) SELECT user_id, max(p) AS state, count(*) AS steps, count(*) FILTER (p < best) AS regressions FROM b GROUP BY 1"


def tickets(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, ok): a click gives its user a ticket for an hour; a purchase uses the newest one, once."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, d, "events").where("event_type in ('click', 'purchase')").withColumn("us", F.unix_micros("ts"))
    e = e.withColumn("ticket", F.last(F.when(F.col("event_type") == "click", F.col("us")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).where("event_type = 'purchase'")
    first = F.row_number().over(Window.partitionBy("user_id", "ticket").orderBy("us", "event_id")) == 1
    return e.select("event_id", F.coalesce((F.col("us") - F.col("ticket") <= 3_600_000_000) & first, F.lit(False)).alias("ok"))


TICKET_SQL = "WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, last_value(CASE WHEN event_type = 'click' THEN epoch_us(ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ticket FROM events WHERE event_type IN ('click', 'purchase')), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, ticket ORDER BY us, event_id) AS k FROM e WHERE event_type = 'purchase') SELECT event_id, coalesce(us - ticket <= 3600000000 AND k = 1, false) AS ok FROM p"


def limits(spark: SparkSession, d: str) -> DataFrame:
    """(hour, event_type, n, refused): requests over each kind's hourly limit are refused."""
    most = F.when(F.col("event_type") == "purchase", 2).otherwise(4)
    w = Window.partitionBy("hour", "event_type").orderBy("ts", "event_id")
    e = load(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts")).withColumn("k", F.row_number().over(w))
    return e.groupBy(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(N(F.lit(1)).alias("n"), F.count_if(F.col("k") > most).alias("refused"))


LIMIT_SQL = "WITH e AS (SELECT date_trunc('hour', ts) AS h, event_type, row_number() OVER (PARTITION BY date_trunc('hour', ts), event_type ORDER BY ts, event_id) AS k FROM events) SELECT strftime(h, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, count(*) FILTER (k > CASE WHEN event_type = 'purchase' THEN 2 ELSE 4 END) AS refused FROM e GROUP BY h, event_type"


def verification(spark: SparkSession, d: str) -> DataFrame:
    """(asked, how, id): a record found by its whole id, by its code in any letter case, or by the beginning of its id, in this order."""
    r = records(spark, d).select("id", "verification_code")
    asked = r.where("verification_code is not null").select(F.lower("verification_code").alias("asked")).unionByName(r.select(F.substring("id", 1, 8).alias("asked")))
    by_code = asked.join(r.select("id", F.upper("verification_code").alias("u")), F.upper("asked") == F.col("u")).select("asked", F.lit("code").alias("how"), "id")
    by_start = asked.join(r.select("id", F.substring("id", 1, 8).alias("s")), F.col("asked") == F.col("s")).select("asked", F.lit("start").alias("how"), "id")
    return latest(by_code.unionByName(by_start), "asked", F.asc("how"), F.asc("id"))


VERIFY_SQL = f"WITH {IDX}, a AS (SELECT lower(verification_code) AS asked FROM rec WHERE verification_code IS NOT NULL UNION ALL SELECT id[1:8] FROM rec), m AS (SELECT asked, 'code' AS how, id FROM a JOIN rec ON upper(asked) = upper(verification_code) UNION ALL SELECT asked, 'start', id FROM a JOIN rec ON asked = id[1:8]) SELECT asked, how, id FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY how, id) AS k FROM m) WHERE k = 1"


def superseded(spark: SparkSession, d: str) -> DataFrame:
    """(id, newer): titles that say old form, no longer valid, or a past year, with the newest other record of the category."""
    r = records(spark, d).where("category_id is not null")
    w = Window.partitionBy("category_id").orderBy(F.desc("created_at"), "id")
    newest = r.withColumn("k", F.row_number().over(w)).where("k <= 2").select("category_id", F.col("id").alias("newer"), "k")
    old = r.where(F.regexp_like(fold("title"), F.lit(r"mau cu|het hieu luc|\b202[0-2]\b"))).select("id", "category_id")
    return latest(old.join(newest, "category_id").where("id <> newer"), "id", F.asc("k")).select("id", "newer")


OLD_SQL = f"WITH {IDX}, o AS (SELECT id, category_id FROM rec WHERE regexp_matches({sql_fold('title')}, 'mau cu|het hieu luc|\\b202[0-2]\\b')) SELECT id, newer FROM (SELECT o.id, b.id AS newer, row_number() OVER (PARTITION BY o.id ORDER BY b.created_at DESC, b.id) AS k FROM o JOIN rec b ON b.category_id = o.category_id AND b.id <> o.id) WHERE k = 1"


def watchers(spark: SparkSession, d: str) -> DataFrame:
    """(watcher, id): stored queries with OR between words and quoted phrases, met by titles; each alternative is a row of a small table."""
    stored = {"money": 'kinh phi OR "hoc phi" OR budget', "rooms": '"phong doc" OR "ky tuc"', "rules": "quy che OR quy dinh"}
    rows = [(k, alt.strip().strip('"')) for k, q in stored.items() for alt in q.split(" OR ")]
    w = spark.createDataFrame(rows, "watcher string, phrase string")
    t = doc_index(spark, d).select("id", fold("title").alias("t"))
    return t.join(F.broadcast(w), F.col("t").contains(F.col("phrase"))).select("watcher", "id").distinct()


WATCH_SQL = f"WITH {IDX}, w AS (SELECT * FROM (VALUES ('money', 'kinh phi'), ('money', 'hoc phi'), ('money', 'budget'), ('rooms', 'phong doc'), ('rooms', 'ky tuc'), ('rules', 'quy che'), ('rules', 'quy dinh')) v(watcher, phrase)) SELECT DISTINCT watcher, id FROM (SELECT id, {sql_fold('title')} AS t FROM idx) JOIN w ON contains(t, phrase)"

CATALOG = {
    "similar_visible": (similar_visible, SIMILAR_SQL), "time_ranges": (by_time_range, RANGE_SQL), "any_run_between": (any_run_between, RUN_SQL), "metric_range": (metric_range, METRIC_SQL), "nine_column_search": (nine_columns, NINE_SQL), "doc_groups": (doc_groups, GROUP_SQL),
    "tag_substring": (tag_substring, TAGS_SQL), "identity_lookup": (identity_lookup, IDENTITY_SQL), "role_masks": (role_masks, ROLE_SQL), "masked_texts": (masked_texts, MASKED_SQL), "token_masks": (token_masks, TOKEN_SQL), "outer_as_inner": (outer_as_inner, OUTER_SQL),
    "either_exists": (either_exists, EITHER_SQL), "batched_children": (batched_children, BATCH_SQL), "staff_records": (staff_records, STAFF_SQL), "number_in_texts": (number_in_texts, INSIDE_SQL), "student_graph": (student_graph, GRAPH_SQL), "remaining_work": (remaining_work, REMAIN_SQL),
    "latest_per_engine": (latest_per_engine, ENGINE_SQL), "store_drift": (store_drift, DRIFT_SQL), "applied_changes": (applied_changes, APPLIED_SQL), "progress_states": (progress, PROGRESS_SQL), "single_use_tickets": (tickets, TICKET_SQL), "hourly_limits": (limits, LIMIT_SQL),
    "verification_lookup": (verification, VERIFY_SQL), "superseded_titles": (superseded, OLD_SQL), "watcher_matches": (watchers, WATCH_SQL),
}
