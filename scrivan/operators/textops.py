"""Text operators as columns: folding, statistics, masks, extraction, classification, tags, routing, hashing."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivan.functions.text import fold, mask_name, mask_pii, quality, shingles, tokens
from scrivan.operators.index import SQL as IDX
from scrivan.operators.index import doc_index, records, sql_fold, sql_tokens
from scrivan.sources.tables import load

N = F.count


def folded_titles(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).select("id", fold("title").alias("folded"))


FOLD_SQL = f"WITH {IDX} SELECT id, {sql_fold('title')} AS folded FROM rec"


def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    w = tokens("text")
    return load(spark, d, "documents").select("doc_id", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("n_distinct"), F.round(F.aggregate(w, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)) / F.greatest(F.size(w), F.lit(1)), 6).alias("mean_len"))


TOKEN_SQL = f"SELECT doc_id, len(w)::INT AS n, len(list_distinct(w))::INT AS n_distinct, round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1), 6) AS mean_len FROM (SELECT doc_id, {sql_tokens('text')} AS w FROM documents)"


def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    """(shingle, n): word triples that stand in five titles or more."""
    s = records(spark, d).select(F.explode(F.array_distinct(shingles(tokens("title"), 3))).alias("shingle"))
    return s.groupBy("shingle").agg(N(F.lit(1)).alias("n")).where("n >= 5")


SHINGLE_SQL = f"WITH {IDX}, w AS (SELECT id, {sql_tokens('title')} AS w FROM rec), s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS shingle FROM w) SELECT shingle, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 5"


def character_frequency(spark: SparkSession, d: str) -> DataFrame:
    """(ch, n, n_docs): every character of the recognition lines."""
    c = load(spark, d, "ocr_comparison").dropDuplicates(["image"]).select("image", F.explode(F.split("pred_b", "")).alias("ch")).where("ch <> ''")
    return c.groupBy("ch").agg(N(F.lit(1)).alias("n"), F.countDistinct("image").alias("n_docs"))


CHAR_SQL = "SELECT ch, count(*) AS n, count(DISTINCT image) AS n_docs FROM (SELECT image, unnest(string_split(pred_b, '')) AS ch FROM (SELECT DISTINCT image, pred_b FROM ocr_comparison)) WHERE ch <> '' GROUP BY ch"


def masked_numbers(spark: SparkSession, d: str) -> DataFrame:
    made = F.format_string("id %012d old %09d tel 09%08d mail user%d@host.vn", "o_orderkey", "o_custkey", "o_custkey", "o_custkey")
    return load(spark, d, "orders").select("o_orderkey", mask_pii(made).alias("masked"))


MASK_SQL = r"SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(printf('id %012d old %09d tel 09%08d mail user%d@host.vn', o_orderkey, o_custkey, o_custkey, o_custkey), '\b(\d{3})\d{6}(\d{3})\b', '\1******\2', 'g'), '\b(\d{3})\d{3}(\d{3})\b', '\1***\2', 'g'), '\b(0[35789]\d)\d{4}(\d{3})\b', '\1****\2', 'g'), '\b([A-Za-z0-9])[A-Za-z0-9._%+\-]*@([A-Za-z0-9.\-]+\.[A-Za-z]{2,})', '\1***@\2', 'g') AS masked FROM orders"


def field_masks(spark: SparkSession, d: str) -> DataFrame:
    """Names and numbers as a viewer without rights sees them."""
    m = load(spark, d, "document_metadata").dropDuplicates(["id"])
    return m.select("id", mask_name(F.col("student_name")).alias("name"), F.concat(F.lit("***"), F.substring("student_id", -3, 3)).alias("number"))


FIELD_SQL = r"SELECT DISTINCT id, array_to_string(list_transform(regexp_split_to_array(trim(student_name), '\s+'), lambda w: substring(w, 1, 1) || '***'), ' ') AS name, '***' || right(student_id, 3) AS number FROM document_metadata"


def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = doc_index(spark, d).where("body is not null")
    return docs.select("id", F.round(quality(F.col("body"), 0.92), 4).alias("q"))


QUAL_SQL = rf"WITH {IDX}, b AS (SELECT id, body AS b FROM idx WHERE body IS NOT NULL) SELECT id, round(CASE WHEN length(b) < 10 THEN 0.6 ELSE least(1.0, greatest(0.0, 0.92 - least(0.15, 5.0 * len(regexp_extract_all(b, '[^\p{{L}}\p{{N}}\s.,;:!?()\-/]')) / length(b)) - least(0.05, 0.01 * len(regexp_extract_all(b, '\d{{5,}}'))))) END, 4)::DOUBLE AS q FROM b"


def noise_lines(spark: SparkSession, d: str) -> DataFrame:
    """(n_lines, n_short, n_symbols, n_repeats): lines by simple noise signs."""
    lines = doc_index(spark, d).select(F.explode(F.split("body", "\n")).alias("l")).select(F.trim("l").alias("l")).where("l <> ''")
    w = F.split("l", " ")
    odd = F.regexp_count("l", F.lit(r"[^\p{L}\p{N}\s]")) / F.length("l")
    return lines.agg(N(F.lit(1)).alias("n_lines"), F.count_if(F.length("l") < 4).alias("n_short"), F.count_if(odd > 0.3).alias("n_symbols"), F.count_if((F.size(w) > 4) & (F.size(F.array_distinct(w)) / F.size(w) < 0.6)).alias("n_repeats"))


NOISE_SQL = rf"WITH {IDX}, l AS (SELECT trim(unnest(string_split(body, chr(10)))) AS l FROM idx), m AS (SELECT l, string_split(l, ' ') AS w, len(regexp_extract_all(l, '[^\p{{L}}\p{{N}}\s]')) / length(l) AS odd FROM l WHERE l <> '') SELECT count(*) AS n_lines, count(*) FILTER (length(l) < 4) AS n_short, count(*) FILTER (odd > 0.3) AS n_symbols, count(*) FILTER (len(w) > 4 AND len(list_distinct(w)) / len(w) < 0.6) AS n_repeats FROM m"


def extracted_fields(spark: SparkSession, d: str) -> DataFrame:
    """(id, number, kind, day, student): fields read from title and text by pattern; dates that don't exist are null."""
    i = doc_index(spark, d)
    num = F.regexp_extract("title", r"(\d{1,5}/[^\s]{1,4}-ĐHSL)", 1)
    raw = F.regexp_extract("title", r"(\d{2}/\d{2}/\d{4})", 1)
    student = F.regexp_extract("body", r"mã\s+số\s+sinh\s+viên\s+(\d{8})", 1)
    blank = lambda c: F.when(c != "", c)
    return i.select("id", blank(num).alias("number"), blank(F.regexp_extract(num, r"/(.+)-", 1)).alias("kind"), F.date_format(F.try_to_timestamp(raw, F.lit("dd/MM/yyyy")), "yyyy-MM-dd").alias("day"), blank(student).alias("student"))


EXTRACT_SQL = rf"WITH {IDX}, f AS (SELECT id, body, regexp_extract(title, '(\d{{1,5}}/[^\s]{{1,4}}-ĐHSL)', 1) AS num, regexp_extract(title, '(\d{{2}}/\d{{2}}/\d{{4}})', 1) AS raw FROM idx) SELECT id, nullif(num, '') AS number, nullif(regexp_extract(num, '/(.+)-', 1), '') AS kind, strftime(try_strptime(nullif(raw, ''), '%d/%m/%Y'), '%Y-%m-%d') AS day, nullif(regexp_extract(body, 'mã\s+số\s+sinh\s+viên\s+(\d{{8}})', 1), '') AS student FROM f"

KINDS = {"TB": "THONG_BAO", "QĐ": "QUYET_DINH", "KH": "KE_HOACH", "ĐN": "DON_TU", "TTr": "TO_TRINH", "BB": "BIEN_BAN", "BM": "BIEU_MAU", "CV": "CONG_VAN", "DS": "DANH_SACH", "GXN": "GIAY_XAC_NHAN", "HB": "HOC_BONG", "MG": "MIEN_GIAM"}


def classified(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, conf): document type by the number's suffix (0.6), the title's first words (0.8) and body hints (0.15 each); the best with 0.55 or more."""
    i = doc_index(spark, d).select("id", "title", fold("title").alias("t"), fold(F.coalesce("body", F.lit(""))).alias("x"))
    words = {"THONG_BAO": "thong bao", "QUYET_DINH": "quyet dinh", "KE_HOACH": "ke hoach", "DON_TU": "don", "TO_TRINH": "to trinh", "BIEN_BAN": "bien ban"}
    hints = {"THONG_BAO": "thong bao den", "QUYET_DINH": "can cu", "KE_HOACH": "muc dich", "DON_TU": "em ten la", "TO_TRINH": "kinh trinh", "BIEN_BAN": "nguoi ky"}
    suffix = F.regexp_extract("title", r"/([^\s]{1,4})-ĐHSL", 1)
    by_suffix = reduce(lambda a, b: a.when(suffix == b[0], b[1]), list(KINDS.items())[1:], F.when(suffix == "TB", KINDS["TB"]))
    i = i.withColumn("s", by_suffix)
    score = lambda k: F.when(F.col("s") == k, 0.6).otherwise(0.0) + F.when(F.col("t").startswith(words[k]), 0.8).otherwise(0.0) + F.when(F.col("x").contains(hints[k]), 0.15).otherwise(0.0)
    best = F.array_max(F.array(*[F.struct(F.round(score(k), 2).alias("score"), F.lit(k).alias("label")) for k in sorted(words)]))
    return i.withColumn("b", best).select("id", F.when(F.col("b.score") >= 0.55, F.col("b.label")).otherwise("KHAC").alias("label"), F.round(F.least(F.lit(0.95), F.col("b.score")), 2).alias("conf"))


def _class_sql() -> str:
    words = {"THONG_BAO": "thong bao", "QUYET_DINH": "quyet dinh", "KE_HOACH": "ke hoach", "DON_TU": "don", "TO_TRINH": "to trinh", "BIEN_BAN": "bien ban"}
    hints = {"THONG_BAO": "thong bao den", "QUYET_DINH": "can cu", "KE_HOACH": "muc dich", "DON_TU": "em ten la", "TO_TRINH": "kinh trinh", "BIEN_BAN": "nguoi ky"}
    suffix = {v: k for k, v in KINDS.items()}
    legs = " UNION ALL ".join(
        f"SELECT id, '{k}' AS label, round(CASE WHEN s = '{suffix[k]}' THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN starts_with(t, '{words[k]}') THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN contains(x, '{hints[k]}') THEN 0.15::DOUBLE ELSE 0 END, 2) AS score FROM i" for k in words
    )
    return f"WITH {IDX}, i AS (SELECT id, regexp_extract(title, '/([^\\s]{{1,4}})-ĐHSL', 1) AS s, {sql_fold('title')} AS t, {sql_fold("coalesce(body, '')")} AS x FROM idx), l AS ({legs}) SELECT id, CASE WHEN score >= 0.55 THEN label ELSE 'KHAC' END AS label, round(least(0.95, score), 2)::DOUBLE AS conf FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label DESC) AS k FROM l) WHERE k = 1"


RULES = [("#KYLUAT", "ky luat", 90), ("#HOCBONG", "hoc bong|scholarship", 80), ("#TAICHINH", "hoc phi|kinh phi|budget|tuition", 70), ("#KYTUC", "ky tuc|dormitory", 60), ("#THUVIEN", "thu vien|library", 50), ("#YTE", "y te|health", 40)]


def _flags(x: Column) -> Column:
    return F.filter(F.array(*[F.when(F.regexp_like(x, F.lit(p)), F.struct(F.lit(-w).alias("w"), F.lit(t).alias("t"))) for t, p, w in RULES]), lambda v: v.isNotNull())


def auto_tags(spark: SparkSession, d: str) -> DataFrame:
    """(id, tags): topic tags by rule, by priority, four at most of each record."""
    i = doc_index(spark, d).select("id", fold(F.concat_ws(" ", "title", "body")).alias("x"))
    return i.select("id", F.array_join(F.transform(F.slice(F.array_sort(_flags(F.col("x"))), 1, 4), lambda v: v["t"]), ",").alias("tags"))


AUTO_SQL = f"WITH {IDX}, x AS (SELECT id, {sql_fold('concat_ws(chr(32), title, body)')} AS x FROM idx) SELECT id, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(x, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{t}{chr(39)} END' for t, p, _ in RULES)}], lambda v: v IS NOT NULL)[1:4], ',') AS tags FROM x"


def routing(spark: SparkSession, d: str) -> DataFrame:
    """(primary, urgency, n): each record to its first matching rule; the number of matches tells the urgency."""
    i = doc_index(spark, d).select(_flags(fold(F.concat_ws(" ", "title", "body"))).alias("m"))
    first = F.coalesce(F.get(F.transform("m", lambda v: v["t"]), 0), F.lit("DEFAULT"))
    return i.groupBy(first.alias("primary"), F.when(F.size("m") >= 4, "URGENT").when(F.size("m") >= 2, "HIGH").otherwise("NORMAL").alias("urgency")).agg(N(F.lit(1)).alias("n"))


ROUTING_SQL = f"WITH {IDX}, x AS (SELECT {sql_fold('concat_ws(chr(32), title, body)')} AS x FROM idx), m AS (SELECT list_filter([{', '.join(f'CASE WHEN regexp_matches(x, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{t}{chr(39)} END' for t, p, _ in RULES)}], lambda v: v IS NOT NULL) AS m FROM x) SELECT coalesce(m[1], 'DEFAULT') AS primary, CASE WHEN len(m) >= 4 THEN 'URGENT' WHEN len(m) >= 2 THEN 'HIGH' ELSE 'NORMAL' END AS urgency, count(*) AS n FROM m GROUP BY 1, 2"


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """(hash, n, first_id): documents whose text occurs more than once."""
    t = load(spark, d, "documents").where("text <> ''").select("doc_id", F.sha2("text", 256).alias("hash"))
    return t.groupBy("hash").agg(N(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


EXACT_SQL = "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1"


def feature_hash(spark: SparkSession, d: str) -> DataFrame:
    """(id, idx, v): signed hashed words and word pairs of each title in 768 places, to unit length. The place is md5 mod 768 by its last byte and digit sum, the sign one bit of md5."""
    w = records(spark, d).select("id", tokens("title").alias("w"))
    t = w.select("id", F.explode(F.concat(F.array_distinct("w"), shingles(F.col("w"), 2))).alias("t")).withColumn("h", F.md5("t"))
    m256 = F.conv(F.substring("h", 31, 2), 16, 10).cast("int")
    m3 = F.aggregate(F.split("h", ""), F.lit(0), lambda s, c: s + F.when(c == "", 0).otherwise(F.instr(F.lit("123456789abcdef"), c))) % 3
    place = m256 + 256 * F.pmod(m3 - m256, F.lit(3))
    sign = F.when(F.conv(F.substring("h", 28, 1), 16, 10).cast("int") % 2 == 1, -1.0).otherwise(1.0)
    v = t.select("id", place.alias("idx"), sign.alias("s")).groupBy("id", "idx").agg(F.sum("s").alias("v")).where("v <> 0")
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))
    return v.select("id", "idx", F.round(F.col("v") / length, 6).alias("v"))


HASH_SQL = f"""WITH {IDX}, w AS (SELECT id, {sql_tokens('title')} AS w FROM rec), t AS (SELECT id, md5(t) AS h FROM (SELECT id, unnest(list_concat(list_distinct(w), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS t FROM w)),
n AS (SELECT id, ('0x' || h[31:32])::INT AS a, list_sum(list_transform(string_split(h, ''), lambda c: instr('123456789abcdef', c)))::INT % 3 AS b, ('0x' || h[28:28])::INT AS c FROM t),
v AS (SELECT id, a + 256 * (((b - a) % 3 + 3) % 3) AS idx, sum(CASE WHEN c % 2 = 1 THEN -1 ELSE 1 END)::DOUBLE AS v FROM n GROUP BY 1, 2) SELECT id, idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS v FROM v WHERE v <> 0"""


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """(split, n): 15/15/70 of each document type in the order of a hash, one at least of each."""
    w = Window.partitionBy("k").orderBy("h", "doc_id")
    t = load(spark, d, "documents").select("doc_id", F.coalesce("doc_type_code", F.lit("-")).alias("k"), F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))).alias("h"))
    size = t.groupBy("k").agg(N(F.lit(1)).alias("m"))
    t = t.withColumn("i", F.row_number().over(w)).join(F.broadcast(size), "k").withColumn("cut", F.greatest(F.lit(1), F.floor(F.col("m") * 0.15)))
    return t.groupBy("k", F.when(F.col("i") <= F.col("cut"), "test").when(F.col("i") <= 2 * F.col("cut"), "validation").otherwise("train").alias("split")).agg(N(F.lit(1)).alias("n"), F.sum("doc_id").alias("s"))


SPLIT_SQL = "WITH t AS (SELECT doc_id, coalesce(doc_type_code, '-') AS k, row_number() OVER (PARTITION BY coalesce(doc_type_code, '-') ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS i, count(*) OVER (PARTITION BY coalesce(doc_type_code, '-')) AS m FROM documents), c AS (SELECT *, greatest(1, floor(m * 0.15)) AS cut FROM t) SELECT k, CASE WHEN i <= cut THEN 'test' WHEN i <= 2 * cut THEN 'validation' ELSE 'train' END AS split, count(*) AS n, sum(doc_id)::BIGINT AS s FROM c GROUP BY 1, 2"


def label_audit(spark: SparkSession, d: str, most: float = 5.0) -> DataFrame:
    """(image, reason): lines whose label is doubtful: an error of more than ``most`` per cent by either engine, or both agreeing against it."""
    c = load(spark, d, "ocr_comparison").dropDuplicates(["image"])
    agree = (F.lower("pred_a") == F.lower("pred_b")) & (F.lower("pred_a") != F.lower("ground_truth"))
    return c.where((F.greatest("cer_a_pct", "cer_b_pct") > most) | agree).select("image", F.when(agree, "agree").otherwise("error").alias("reason"))


AUDIT_SQL = "SELECT DISTINCT image, CASE WHEN lower(pred_a) = lower(pred_b) AND lower(pred_a) <> lower(ground_truth) THEN 'agree' ELSE 'error' END AS reason FROM ocr_comparison WHERE greatest(cer_a_pct, cer_b_pct) > 5 OR (lower(pred_a) = lower(pred_b) AND lower(pred_a) <> lower(ground_truth))"


def capped_labels(spark: SparkSession, d: str) -> DataFrame:
    """(label, n): lines kept when one label may stand twenty times (without regard to case); the cap is the operator."""
    m = load(spark, d, "synth_manifest").dropDuplicates(["row_id"]).where("text <> ''")
    w = Window.partitionBy(F.lower("text")).orderBy("row_id")
    return m.withColumn("k", F.row_number().over(w)).where("k <= 20").groupBy("split").agg(N(F.lit(1)).alias("n"), F.max("row_id").alias("last"))


CAP_SQL = "SELECT split, count(*) AS n, max(row_id) AS last FROM (SELECT row_id, split, row_number() OVER (PARTITION BY lower(text) ORDER BY row_id) AS k FROM (SELECT DISTINCT row_id, text, split FROM synth_manifest WHERE text <> '')) WHERE k <= 20 GROUP BY split"


def spatial_boxes(spark: SparkSession, d: str, word: str = "học bổng") -> DataFrame:
    """(id, page, x, y, w): a box for the first hit on each line, 40 lines a page, placed among the page's hits."""
    lines = doc_index(spark, d).select("id", F.posexplode(F.split("body", "\n")).alias("i", "l"))
    hit = lines.withColumn("at", F.instr(F.lower("l"), word)).where("at > 0").withColumn("page", F.floor(F.col("i") / 40).cast("int") + 1)
    k = F.row_number().over(Window.partitionBy("id", "page").orderBy("i")) - 1
    return hit.select("id", "page", (60 + 7.5 * (F.col("at") - 1)).alias("x"), (60 + 22 * k).alias("y"), F.lit(max(9.5 * len(word), 45)).alias("w"))


BOXES_SQL = f"WITH {IDX}, l AS (SELECT id, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS i FROM idx), h AS (SELECT id, i, instr(lower(l), 'học bổng') AS a, (i // 40)::INT + 1 AS page FROM l) SELECT id, page, (60 + 7.5 * (a - 1))::DOUBLE AS x, (60 + 22 * (row_number() OVER (PARTITION BY id, page ORDER BY i) - 1))::INT AS y, 76.0::DOUBLE AS w FROM h WHERE a > 0"


def faq_match(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, entry, score): each evaluation question against a small knowledge base by weighted keyword overlap."""
    kb = [("scholarship", "hoc bong"), ("scholarship", "khuyen khich"), ("library", "thu vien"), ("library", "phong doc"), ("budget", "kinh phi"), ("exam", "de thi"), ("exam", "lich thi"), ("training", "tap huan")]
    k = spark.createDataFrame(kb, "entry string, phrase string").withColumn("kw", F.split("phrase", " "))
    q = load(spark, d, "eval_items").select("item_id", fold("text").alias("x"), tokens("text").alias("w"))
    both = F.size(F.array_intersect("kw", "w"))
    score = F.when(F.col("x").contains(F.col("phrase")), 35 * F.size("kw")).when(both >= 2, 8 * both).otherwise(4 * both)
    s = q.join(F.broadcast(k)).groupBy("item_id", "entry").agg(F.sum(score).alias("score")).where("score >= 12")
    return s.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "entry"))).where("r = 1").select("item_id", "entry", "score")


FAQ_SQL = f"WITH k AS (SELECT *, string_split(phrase, ' ') AS kw FROM (VALUES ('scholarship', 'hoc bong'), ('scholarship', 'khuyen khich'), ('library', 'thu vien'), ('library', 'phong doc'), ('budget', 'kinh phi'), ('exam', 'de thi'), ('exam', 'lich thi'), ('training', 'tap huan')) v(entry, phrase)), q AS (SELECT item_id, {sql_fold('text')} AS x, {sql_tokens('text')} AS w FROM eval_items), s AS (SELECT item_id, entry, sum(CASE WHEN contains(x, phrase) THEN 35 * len(kw) WHEN len(list_intersect(kw, w)) >= 2 THEN 8 * len(list_intersect(kw, w)) ELSE 4 * len(list_intersect(kw, w)) END)::BIGINT AS score FROM q, k GROUP BY 1, 2) SELECT item_id, entry, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, entry) AS r FROM s WHERE score >= 12) WHERE r = 1"


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed Unicode form; Spark has no built-in for it."""
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.DoubleType())
def word_error(truth: pd.Series, guess: pd.Series) -> pd.Series:
    """Word error in per cent; 0 for two blank texts, 100 where only the truth is blank."""

    def one(a: str, b: str) -> float:
        x, y = ([w for w in re.split(r"\s+", t or "", flags=re.ASCII) if w] for t in (a, b))
        if not x:
            return 0.0 if not y else 100.0
        row = list(range(len(y) + 1))
        for i, w in enumerate(x, 1):
            new = [i]
            for j, v in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
            row = new
        return 100.0 * row[-1] / len(x)

    return pd.Series([one(a, b) for a, b in zip(truth, guess)])


def word_errors(spark: SparkSession, d: str) -> DataFrame:
    """(image, wer, grade) of every line, after composing."""
    c = load(spark, d, "ocr_comparison").dropDuplicates(["image"])
    e = c.select("image", F.round(word_error(nfc("ground_truth"), nfc("pred_b")), 4).alias("wer"))
    return e.withColumn("grade", F.when(F.col("wer") < 2, "A").when(F.col("wer") < 5, "B").when(F.col("wer") < 15, "C").otherwise("D"))


def edits_sql(a: str, b: str) -> str:
    """Edit distance of two lists: a fold over the one of rows that a fold over the other makes."""
    row = f"list_reduce(range(1, len({b}) + 1), lambda new, j: list_append(new, least(row[j + 1] + 1, new[j] + 1, row[j] + CASE WHEN {a}[i] = {b}[j] THEN 0 ELSE 1 END)), [i])"
    return f"list_last(list_reduce(range(1, len({a}) + 1), lambda row, i: {row}, range(0, len({b}) + 1)))"


_SPLIT = lambda c: f"list_filter(regexp_split_to_array(nfc_normalize({c}), '\\s+'), lambda w: w <> '')"
WORDS_SQL = f"WITH c AS (SELECT DISTINCT image, {_SPLIT('ground_truth')} AS x, {_SPLIT('pred_b')} AS y FROM ocr_comparison), e AS (SELECT image, CASE WHEN len(x) = 0 THEN CASE WHEN len(y) = 0 THEN 0.0::DOUBLE ELSE 100 END ELSE round(100.0::DOUBLE * {edits_sql('x', 'y')} / len(x), 4) END AS wer FROM c) SELECT image, wer, CASE WHEN wer < 2 THEN 'A' WHEN wer < 5 THEN 'B' WHEN wer < 15 THEN 'C' ELSE 'D' END AS grade FROM e"

CATALOG = {
    "accent_fold": (folded_titles, FOLD_SQL), "token_statistics": (token_statistics, TOKEN_SQL), "shingle_counts": (shingle_counts, SHINGLE_SQL), "character_frequency": (character_frequency, CHAR_SQL),
    "mask_numbers": (masked_numbers, MASK_SQL), "mask_fields": (field_masks, FIELD_SQL), "quality_scores": (quality_scores, QUAL_SQL), "noise_lines": (noise_lines, NOISE_SQL), "extract_fields": (extracted_fields, EXTRACT_SQL),
    "classify_doctype": (classified, _class_sql()), "auto_tags": (auto_tags, AUTO_SQL), "routing_rules": (routing, ROUTING_SQL), "exact_duplicates": (exact_duplicates, EXACT_SQL), "feature_hash_vectors": (feature_hash, HASH_SQL),
    "stratified_split": (stratified_split, SPLIT_SQL), "label_audit": (label_audit, AUDIT_SQL), "cap_per_label": (capped_labels, CAP_SQL), "spatial_boxes": (spatial_boxes, BOXES_SQL), "faq_match": (faq_match, FAQ_SQL), "word_errors": (word_errors, WORDS_SQL),
}
