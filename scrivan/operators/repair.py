"""Repair of recognised text as columns: ordered rules, a dictionary, numbers and dates, paragraphs, and the signs of bad lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivan.functions.text import fold
from scrivan.operators.index import SQL as IDX
from scrivan.operators.index import doc_index, sql_fold
from scrivan.operators.textops import nfc
from scrivan.sources.tables import load

N = F.count

#: (name, pattern, replacement): applied in this order; the patterns mean the same in both regular-expression dialects.
RULES = [
    ("bar code", r"(?m)^\d{9,14}[ \t]*\n", ""),
    ("bar between letters", r"(\p{L})\|(\p{L})", r"$1 $2"),
    ("underscores", r"_{2,}", " "),
    ("number sign", r"(?m)^([ \t]*)S[oốô0]\s*[;:]\s*", r"$1Số: "),
    ("l for 1 in a number", r"(Số: )[lI](\d)", r"$11$2"),
    ("l inside digits", r"(\d)[lI](\d)", r"$11$2"),
    ("O inside digits", r"(\d)[oO](\d)", r"$10$2"),
    ("O before digits", r"(^|[\s/])O(\d)", r"$10$2"),
    ("O after digits", r"(\d)O([\s/.,]|$)", r"$10$2"),
    ("mark after the day", r"(ngày \d{1,2})\s*[)\]}]\s*(tháng)", r"$1 $2"),
    ("mark after the month", r"(tháng \d{1,2})\s*[)\]}/]\s*(năm)", r"$1 $2"),
    ("day that is none", r"(ngày )3[47]( tháng)", r"$131$2"),
    ("marked day that is none", r"(ngày <hw>)3[47](</hw> tháng)", r"$131$2"),
    ("day and month run together", r"(ngày)(\d{1,2})\s*(tháng)\s*(\d{1,2})", r"$1 $2 $3 $4"),
    ("roman three", r"(?m)^(IH|IIl|lII|Ill)\. ", "III. "),
    ("roman two", r"(?m)^(TI|Il|lI)\. ", "II. "),
    ("roman one", r"(?m)^l\. ", "I. "),
    ("colon and slashes", r":/{1,2}\?", ":"),
    ("blank before a mark", r"[ \t]+([,;:!?])", r"$1"),
    ("no blank after a comma", r",(\p{L})", r", $1"),
    ("doubled marks", r"([,;:])[,;:]+", r"$1"),
    ("dots of a blank field", r"\.{4,}", "..."),
    ("dash for a hyphen", r"(\p{L})[–—](\p{L})", r"$1-$2"),
    ("blanks before a line end", r"[ \t]+\n", "\n"),
    ("empty lines", r"\n{3,}", "\n\n"),
]
# Words that recognition gets wrong, with the right one.
WORDS = dict(
    x.split(">")
    for x in (
        "Điêu>Điều điêu>điều ĐIÊU>ĐIỀU Quyét>Quyết quyét>quyết Quyêt>Quyết quyêt>quyết QUYÊT>QUYẾT đinh>định Đinh>Định Căn>Căn cú>cứ Thong>Thông thong>thông Trưởng>Trưởng trường>trường Truờng>Trường truờng>trường "
        "Hiêu>Hiệu hiêu>hiệu Phong>Phòng phong>phòng hoc>học Hoc>Học sình>sinh Sình>Sinh viền>viên Viền>Viên khoá>khóa Khoá>Khóa nghi>nghị Nghi>Nghị thỏng>thông Thỏng>Thông bảo>báo ngảy>ngày Ngảy>Ngày thảng>tháng Thảng>Tháng "
        "nãm>năm Nãm>Năm đào>đào tao>tạo Tao>Tạo công>công tảc>tác Tảc>Tác duyêt>duyệt Duyêt>Duyệt hoach>hoạch Hoach>Hoạch chinh>chính Chinh>Chính sach>sách Sach>Sách giai>giải Giai>Giải"
    ).split(" ")
)
WORDS = {a: b for a, b in WORDS.items() if a != b and a not in ("phong", "Phong", "bảo")}
# Codes of number suffixes as they are typed without marks.
CODES = {f"{kind}-{body}": f"{right}-{ours}" for kind, right in (("QD", "QĐ"), ("TB", "TB"), ("KH", "KH"), ("CV", "CV"), ("HD", "HD"), ("BC", "BC"), ("TTR", "TTr"), ("BB", "BB"), ("DN", "ĐN"), ("GXN", "GXN")) for body, ours in (("DHDL", "ĐHĐL"), ("DHSL", "ĐHSL"), ("CTSV", "CTSV"))}
REJECTED = "công văn|căn cứ|theo|của|quyết định|thông tư|nghị định"


def ruled(text: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """A text after every rule in order."""
    return reduce(lambda c, r: F.regexp_replace(c, r[1], r[2]), rules, text)


def _ruled_sql(x: str) -> str:
    back = lambda to: "".join(f"\\{to[k + 1]}" if c == "$" else "" if k and to[k - 1] == "$" else c for k, c in enumerate(to))
    quote = lambda v: "'" + v.replace("'", "''") + "'" if "\n" not in v else " || chr(10) || ".join(quote(p) for p in v.split("\n"))
    for _, pattern, to in RULES:
        x = f"regexp_replace({x}, {quote(pattern)}, {quote(back(to))}, 'g')"
    return x


def rule_repairs(spark: SparkSession, d: str) -> DataFrame:
    """(id, hits, text_md5): each run's text after the ordered rules, and how many of them applied to it as it came."""
    r = load(spark, d, "ocr_results").dropDuplicates(["id"]).where("raw_text is not null")
    hits = reduce(lambda a, b: a + b, [F.regexp_like("raw_text", F.lit(p)).cast("int") for _, p, _ in RULES])
    return r.select("id", hits.alias("hits"), F.md5(ruled(F.col("raw_text"))).alias("text_md5"))


_RUNS = "(SELECT DISTINCT id, raw_text FROM ocr_results WHERE raw_text IS NOT NULL)"
RULE_SQL = "SELECT id, " + " + ".join("regexp_matches(raw_text, '{}')::INT".format(p.replace("'", "''")) for _, p, _ in RULES) + f" AS hits, md5({_ruled_sql('raw_text')}) AS text_md5 FROM {_RUNS}"


def worded(text: Column, words: dict[str, str] = WORDS) -> Column:
    """A text with whole words replaced by a dictionary: one look-up a word, whatever the dictionary's size."""
    import json

    table = F.from_json(F.lit(json.dumps(words)), "map<string,string>")
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")


def _worded_sql(x: str) -> str:
    keys, values = (", ".join(f"'{v}'" for v in part) for part in (WORDS.keys(), WORDS.values()))
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda p: coalesce(map_extract(MAP([{keys}], [{values}]), p)[1], p)), '')"


def dictionary_fixes(spark: SparkSession, d: str) -> DataFrame:
    """(id, changed, text_md5)"""
    r = load(spark, d, "ocr_results").dropDuplicates(["id"]).where("raw_text is not null").withColumn("w", worded(F.col("raw_text")))
    return r.select("id", (F.col("w") != F.col("raw_text")).alias("changed"), F.md5("w").alias("text_md5"))


DICTIONARY_SQL = f"SELECT id, w <> raw_text AS changed, md5(w) AS text_md5 FROM (SELECT id, raw_text, {_worded_sql('raw_text')} AS w FROM {_RUNS})"

_NUMBER = r"(?s)(.{0,40}?)(?:Số|SỐ|So|số)\s*[:;.]?\s*([0-9][0-9 .]{0,7})\s*/\s*([A-ZĐa-z]{2,4})\s*-\s*([A-ZĐ]{2,5})"


_MARK, _AFTER = r"(?=(?:Số|SỐ|So|số)\s*[:;.]?\s*[0-9])", _NUMBER.removeprefix("(?s)(.{0,40}?)")


def number_of(text: Column) -> Column:
    """The first document number that no citation word stands before (40 characters), with its code as it is written properly.

    The text is cut before every number sign, so that no place is tried twice; what stands before a sign is the end of
    the part before, without a number that was read there.
    """
    part = lambda seg, k: F.regexp_extract(seg, "^" + _AFTER, k)
    segs = F.split(text, _MARK)
    rows = F.transform(segs, lambda seg, i: F.struct(F.when(i > 0, F.substring(F.regexp_replace(F.get(segs, i - 1), "^" + _AFTER, ""), -40, 40)).otherwise("").alias("before"), seg.alias("seg")))
    kept = F.filter(rows, lambda r: F.regexp_like(r["seg"], F.lit("^" + _AFTER)) & ~F.regexp_like(F.lower(r["before"]), F.lit(REJECTED)))
    first = F.get(kept, 0)["seg"]
    table = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    code = F.concat(part(first, 2), F.lit("-"), part(first, 3))
    return F.concat(F.lit("Số: "), F.regexp_replace(part(first, 1), r"[ .]", ""), F.lit("/"), F.coalesce(F.try_element_at(table, F.upper(code)), code))


def normal_numbers(spark: SparkSession, d: str) -> DataFrame:
    return doc_index(spark, d).select("id", number_of(F.concat_ws("\n", "title", "body")).alias("number"))


_CODE_MAP = "MAP([{}], [{}])".format(", ".join(f"'{k}'" for k in CODES), ", ".join(f"'{v}'" for v in CODES.values()))
NUMBER_SQL = f"""WITH {IDX}, x AS (SELECT id, concat_ws(chr(10), title, body) AS x FROM idx), m AS (SELECT id, unnest(regexp_extract_all(x, '{_NUMBER}', 1)) AS before, unnest(regexp_extract_all(x, '{_NUMBER}', 2)) AS n, unnest(regexp_extract_all(x, '{_NUMBER}', 3)) || '-' || unnest(regexp_extract_all(x, '{_NUMBER}', 4)) AS code, generate_subscripts(regexp_extract_all(x, '{_NUMBER}', 1), 1) AS k FROM x),
f AS (SELECT id, n, code FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS r FROM m WHERE NOT regexp_matches(lower(before), '{REJECTED}')) WHERE r = 1)
SELECT x.id, 'Số: ' || regexp_replace(n, '[ .]', '', 'g') || '/' || coalesce(map_extract({_CODE_MAP}, upper(code))[1], code) AS number FROM x LEFT JOIN f USING (id)"""

_DATE = r"[Nn]gày\s*(\d{1,3})\s*[)\]]?\s*tháng\s*(\d{1,3})\s*[)\]/]?\s*năm\s*(\d{4}|\d{2})"


def date_of(text: Column) -> Column:
    """The first written date, its parts held to what a date can have: day 34 or 37 was 31, 4x was 1x, longer ones are cut."""
    part = lambda k: F.regexp_extract(text, _DATE, k)
    bare = lambda c: F.regexp_replace(c, "^0+", "")
    day, month, year = bare(part(1)), bare(part(2)), part(3)
    n = day.try_cast("int")
    day = F.when(n <= 31, day).when(day.startswith("3") & (F.length(day) == 2), "31").when(day.startswith("4") & (F.length(day) == 2), F.concat(F.lit("1"), F.substring(day, 2, 1))).when(F.substring(day, 1, 2).try_cast("int") <= 31, F.substring(day, 1, 2)).otherwise(F.substring(day, 1, 1))
    month = F.when(month.try_cast("int") > 12, F.substring(month, 1, 1)).otherwise(month)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.when(part(3) != "", F.concat(F.lit("ngày "), day, F.lit(" tháng "), month, F.lit(" năm "), year))


def normal_dates(spark: SparkSession, d: str) -> DataFrame:
    made = F.format_string("Lâm Đồng, ngày %02d tháng %d) năm %d", F.col("o_orderkey") % 50, F.col("o_custkey") % 45, 1990 + F.col("o_orderkey") % 40)
    return load(spark, d, "orders").select("o_orderkey", date_of(made).alias("day"))


DATE_SQL = rf"""WITH m AS (SELECT o_orderkey, printf('Lâm Đồng, ngày %02d tháng %d) năm %d', o_orderkey % 50, o_custkey % 45, 1990 + o_orderkey % 40) AS x FROM orders), p AS (SELECT o_orderkey, regexp_replace(regexp_extract(x, '{_DATE}', 1), '^0+', '') AS d, regexp_replace(regexp_extract(x, '{_DATE}', 2), '^0+', '') AS m, regexp_extract(x, '{_DATE}', 3) AS y FROM m)
SELECT o_orderkey, CASE WHEN y <> '' THEN 'ngày ' || CASE WHEN try_cast(d AS INT) <= 31 THEN d WHEN starts_with(d, '3') AND length(d) = 2 THEN '31' WHEN starts_with(d, '4') AND length(d) = 2 THEN '1' || d[2] WHEN try_cast(d[1:2] AS INT) <= 31 THEN d[1:2] ELSE d[1] END || ' tháng ' || CASE WHEN try_cast(m AS INT) > 12 THEN m[1] ELSE m END || ' năm ' || CASE WHEN length(y) = 2 THEN '20' || y ELSE y END END AS day FROM p"""

_ITEM = r"^([-+–—]|\d+(\.\d+)*\.?|[IVXLCDM]+\.)\s+"
_SECTION = r"^(căn cứ|điều \d+|chương [ivxlcdm\d]+|kính gửi|nơi nhận|thời gian|địa điểm|thành phần)"


def rejoined(text: Column) -> Column:
    """Lines joined to paragraphs by a fold over them: what goes on in small letters follows on, headings and entries stay apart."""

    def step(acc: Column, line: Column) -> Column:
        prev, curr = F.trim(acc["last"]), F.trim(line)
        head = F.substring(curr, 1, 1)
        alone = (prev == "") | (curr == "") | acc["last"].contains("      ")
        cited = F.regexp_like(F.lower(prev), F.lit(r"^căn\s+cứ[:.,?]*$"))
        fixed = ((F.upper(prev) == prev) & (F.lower(prev) != prev) & (F.length(prev) >= 3)) | F.regexp_like(curr, F.lit(_ITEM)) | F.regexp_like(F.lower(curr), F.lit(_SECTION)) | F.regexp_like(prev, F.lit(r"[.:;!?…]$"))
        cut = F.regexp_like(prev, F.lit(r"[-–]$"))
        small = (F.lower(head) == head) & (F.upper(head) != head)
        new = F.struct(F.concat(acc["done"], acc["last"], F.lit("\n")).alias("done"), line.alias("last"))
        same = lambda x: F.struct(acc["done"].alias("done"), x.alias("last"))
        return F.when(alone, new).when(cited, same(F.concat(F.lit("Căn cứ "), curr))).when(fixed, new).when(cut, same(F.concat(F.regexp_replace(acc["last"], r"[-–]+$", ""), curr))).when(small, same(F.concat(acc["last"], F.lit(" "), curr))).otherwise(new)

    lines = F.split(text, "\n")
    start = F.struct(F.lit("").alias("done"), F.element_at(lines, 1).alias("last"))
    return F.aggregate(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), start, step, lambda a: F.concat(a["done"], a["last"]))


def rejoined_texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, lines_before, lines_after, text_md5)"""
    r = load(spark, d, "ocr_results").dropDuplicates(["id"]).where("raw_text is not null").withColumn("j", rejoined(F.col("raw_text")))
    lines = lambda c: F.size(F.split(c, "\n"))
    return r.select("id", lines("raw_text").alias("lines_before"), lines("j").alias("lines_after"), F.md5("j").alias("text_md5"))


def _rejoined_sql(x: str) -> str:
    """The same fold over one growing text, whose last line is what stands after its last line end."""
    prev, curr = "trim(a.last)", "trim(l)"
    alone = f"{prev} = '' OR {curr} = '' OR contains(a.last, '      ')"
    fixed = f"(upper({prev}) = {prev} AND lower({prev}) <> {prev} AND length({prev}) >= 3) OR regexp_matches({curr}, '{_ITEM}') OR regexp_matches(lower({curr}), '{_SECTION}') OR regexp_matches({prev}, '[.:;!?…]$')"
    small = f"lower({curr}[1]) = {curr}[1] AND upper({curr}[1]) <> {curr}[1]"
    new = "{'done': a.done || a.last || chr(10), 'last': l.last}".replace("l.last", "l")
    same = lambda v: "{'done': a.done, 'last': " + v + "}"
    body = f"CASE WHEN {alone} THEN {new} WHEN regexp_matches(lower({prev}), '^căn\\s+cứ[:.,?]*$') THEN {same(f'{chr(39)}Căn cứ {chr(39)} || {curr}')} WHEN {fixed} THEN {new} WHEN regexp_matches({prev}, '[-–]$') THEN {same(f'regexp_replace(a.last, {chr(39)}[-–]+${chr(39)}, {chr(39)}{chr(39)}) || {curr}')} WHEN {small} THEN {same(f'a.last || {chr(39)} {chr(39)} || {curr}')} ELSE {new} END"
    body = body.replace("trim(l)", "trim(b.last)").replace("'last': l}", "'last': b.last}")
    return f"list_reduce(list_transform(string_split({x}, chr(10)), lambda v: {{'done': '', 'last': v}}), lambda a, b: {body})"


REJOIN_SQL = f"SELECT id, lines_before, len(string_split(j, chr(10)))::INT AS lines_after, md5(j) AS text_md5 FROM (SELECT id, len(string_split(raw_text, chr(10)))::INT AS lines_before, j.done || j.last AS j FROM (SELECT id, raw_text, {_rejoined_sql('raw_text')} AS j FROM {_RUNS}))"


def repaired_texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, text_md5): the whole chain: composed form, rules, dictionary, blanks, paragraphs."""
    r = load(spark, d, "ocr_results").dropDuplicates(["id"]).where("raw_text is not null")
    x = F.regexp_replace(worded(ruled(nfc("raw_text"))), r"[ \t]{2,5}", " ")
    return r.select("id", x.alias("x")).select("id", F.md5(F.trim(rejoined(F.col("x")))).alias("text_md5"))


CHAIN_SQL = f"SELECT id, md5(trim(j.done || j.last)) AS text_md5 FROM (SELECT id, {_rejoined_sql('x')} AS j FROM (SELECT id, regexp_replace({_worded_sql(_ruled_sql('nfc_normalize(raw_text)'))}, '[ \\t]{{2,5}}', ' ', 'g') AS x FROM {_RUNS}))"


def degenerate(spark: SparkSession, d: str) -> DataFrame:
    """(id, repeats, brackets, suspicious, bad): texts that repeat themselves or consist of brackets; runs of digits and odd characters lower their quality."""
    r = load(spark, d, "ocr_results").dropDuplicates(["id"]).where("length(raw_text) > 0")
    w = F.filter(F.split("raw_text", r"\s+"), lambda x: x != "")
    repeats = 1 - F.size(F.array_distinct(w)) / F.size(w)
    brackets = F.regexp_count("raw_text", F.lit(r"[\[\](){}<>]")) / F.length("raw_text")
    odd = F.regexp_count("raw_text", F.lit(r"[|~^\\`]"))
    bad = ((repeats > 0.5) & (F.size(w) > 10)) | (brackets > 0.25)
    return r.where(F.size(w) > 0).select("id", F.round(repeats, 6).alias("repeats"), F.round(brackets, 6).alias("brackets"), odd.alias("suspicious"), bad.alias("bad"))


DEGENERATE_SQL = rf"WITH r AS (SELECT id, raw_text AS t, list_filter(regexp_split_to_array(raw_text, '\s+'), lambda x: x <> '') AS w FROM {_RUNS} WHERE length(raw_text) > 0), s AS (SELECT id, 1 - len(list_distinct(w)) / len(w) AS p, len(regexp_extract_all(t, '[\[\](){{}}<>]')) / length(t) AS b, len(regexp_extract_all(t, '[|~^\\`]'))::INT AS suspicious, len(w) AS n FROM r WHERE len(w) > 0) SELECT id, round(p, 6) AS repeats, round(b, 6) AS brackets, suspicious, (p > 0.5 AND n > 10) OR b > 0.25 AS bad FROM s"


def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    """(block, n, chars): every line by what it is: heading, entry, section, furniture, capitals or plain."""
    l = doc_index(spark, d).select(F.explode(F.split("body", "\n")).alias("l")).select(F.trim("l").alias("l")).where("l <> ''")
    c = F.col("l")
    block = F.when(F.regexp_like(c, F.lit(r"^[IVXLC]+\. ")), "heading").when(F.regexp_like(c, F.lit(_ITEM)), "entry").when(F.regexp_like(F.lower(c), F.lit(_SECTION)), "section").when(F.regexp_like(c, F.lit(r"^\W*\d{1,4}(\s*/\s*\d{1,4})?\W*$")), "furniture").when((F.upper(c) == c) & (F.lower(c) != c), "capitals").otherwise("plain")
    return l.groupBy(block.alias("block")).agg(N(F.lit(1)).alias("n"), F.sum(F.length("l")).alias("chars"))


BLOCKS_SQL = rf"WITH {IDX}, l AS (SELECT trim(unnest(string_split(body, chr(10)))) AS l FROM idx) SELECT CASE WHEN regexp_matches(l, '^[IVXLC]+\. ') THEN 'heading' WHEN regexp_matches(l, '{_ITEM}') THEN 'entry' WHEN regexp_matches(lower(l), '{_SECTION}') THEN 'section' WHEN regexp_matches(l, '^\W*\d{{1,4}}(\s*/\s*\d{{1,4}})?\W*$') THEN 'furniture' WHEN upper(l) = l AND lower(l) <> l THEN 'capitals' ELSE 'plain' END AS block, count(*) AS n, sum(length(l))::BIGINT AS chars FROM l WHERE l <> '' GROUP BY 1"


def refinement_guard(spark: SparkSession, d: str) -> DataFrame:
    """(id, ok, ratio): corrected texts that keep the length (0.9 to 1.15) and the raw text's numbers and key words."""
    r = load(spark, d, "ocr_results").dropDuplicates(["id"]).where("length(raw_text) > 0 and length(corrected_text) > 0")
    ratio = F.length("corrected_text") / F.length("raw_text")
    raw, new = fold("raw_text"), fold("corrected_text")
    keys = reduce(lambda a, b: a & b, [~raw.contains(k) | new.contains(k) for k in ("quyet dinh", "thong bao", "can cu", "dieu 1", "sinh vien", "hoc bong", "hoc phi", "kinh gui")])
    return r.select("id", (ratio.between(0.9, 1.15) & keys).alias("ok"), F.round(ratio, 6).alias("ratio"))


GUARD_SQL = f"WITH r AS (SELECT DISTINCT id, raw_text, corrected_text FROM ocr_results WHERE length(raw_text) > 0 AND length(corrected_text) > 0), f AS (SELECT id, length(corrected_text) / length(raw_text) AS q, {sql_fold('raw_text')} AS a, {sql_fold('corrected_text')} AS b FROM r) SELECT id, (q BETWEEN 0.9 AND 1.15) AND " + " AND ".join(f"(NOT contains(a, '{k}') OR contains(b, '{k}'))" for k in ("quyet dinh", "thong bao", "can cu", "dieu 1", "sinh vien", "hoc bong", "hoc phi", "kinh gui")) + " AS ok, round(q, 6) AS ratio FROM f"


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, revision, added, removed, same): each run of a record against the one before it, by distinct words."""
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy("created_at", "id")
    r = load(spark, d, "ocr_results").dropDuplicates(["id"]).where("raw_text is not null").select("id", "document_id", "created_at", F.array_distinct(F.split("raw_text", r"\s+")).alias("w"))
    r = r.withColumn("p", F.lag("w").over(w)).withColumn("revision", F.row_number().over(w)).where("p is not null")
    return r.select("document_id", "revision", F.size(F.array_except("w", "p")).alias("added"), F.size(F.array_except("p", "w")).alias("removed"), F.size(F.array_intersect("w", "p")).alias("same"))


REVISION_SQL = r"WITH r AS (SELECT id, document_id, created_at, list_distinct(regexp_split_to_array(raw_text, '\s+')) AS w FROM (SELECT DISTINCT id, document_id, created_at, raw_text FROM ocr_results WHERE raw_text IS NOT NULL)), l AS (SELECT document_id, w, lag(w) OVER o AS p, row_number() OVER o AS revision FROM r WINDOW o AS (PARTITION BY document_id ORDER BY created_at, id)) SELECT document_id, revision, len(list_filter(w, lambda x: NOT list_contains(p, x)))::INT AS added, len(list_filter(p, lambda x: NOT list_contains(w, x)))::INT AS removed, len(list_intersect(w, p))::INT AS same FROM l WHERE p IS NOT NULL"

CATALOG = {
    "ocr_rules": (rule_repairs, RULE_SQL), "dictionary_fix": (dictionary_fixes, DICTIONARY_SQL), "number_normalise": (normal_numbers, NUMBER_SQL), "date_normalise": (normal_dates, DATE_SQL), "paragraph_rejoin": (rejoined_texts, REJOIN_SQL),
    "repair_chain": (repaired_texts, CHAIN_SQL), "degenerate_texts": (degenerate, DEGENERATE_SQL), "line_blocks": (line_blocks, BLOCKS_SQL), "refinement_guard": (refinement_guard, GUARD_SQL), "run_revisions": (revisions, REVISION_SQL),
}
