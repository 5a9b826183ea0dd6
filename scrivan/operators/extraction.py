"""Fields, types and tags read from texts."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivan.functions.text import fold
from scrivan.operators.index import SQL as IDX
from scrivan.operators.index import doc_index, records, sql_fold
from scrivan.sources.tables import load

N = F.count
_NAME = r"(?:Họ và tên|Họ tên|Em tên là|Tôi tên là|Tên sinh viên)[\s:.\-]+([\p{L} ]{3,35}?)(?:\n|,|\.|  |MSSV|Lớp|Mã|$)"
_STUDENT = [r"(?:MSSV|[Mm]ã\s+số\s+sinh\s+viên|Mã SV|Mã học viên)[\s:.\-]+([A-Za-z0-9]{6,12})", r"(?:[Ss]inh viên|SV) số[\s:.\-]+([0-9]{6,10})", r"Mã số[\s:.\-]+([0-9]{7,8})", r"\b(2[0-9]{6,7}|1[89][0-9]{5,6})\b"]
_CLASS = r"(?:Lớp|lớp|Chi đoàn)[\s:.\-]+([A-Z]{2,6}[A-Za-z0-9\-/]{0,14})"
_FACULTY = r"(?:Khoa|khoa|Viện)\s+((?:\p{L}+ ){1,3}\p{L}+)"
_REASON = r"(?:[Ll]ý do|[Vv]ì lý do|[Nn]guyên nhân)[\s:.\-]+([^\n.]{8,150})"
_DAYS = [r"ngày\s*(\d{1,2})\s*tháng\s*(\d{1,2})\s*năm\s*(\d{4})", r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})\b"]
_NUM = [r"(?:Số|số)[\s:.\-]+([0-9]{1,6}\s*/\s*[A-ZĐa-z0-9\-]+)", r"\b(\d{1,5}/(?:QĐ|KH|TB|HD|TTr|BC|CV|QD)-[A-ZĐa-z0-9\-]+)"]
_CITED = r"^(căn cứ|can cu|điều 1|dieu 1)"
_ASIDE = r"^(căn cứ|can cu|theo |kính gửi|nơi nhận)"
# Kinds of application by words of the text, the first that fits.
KINDS = [("DON_NGHI_HOC", "nghỉ học tạm thời|xin bảo lưu|tạm ngừng học"), ("HOC_BONG", "học bổng|khuyến khích học tập|xét học bổng"), ("MIEN_GIAM_HOC_PHI", "miễn giảm học phí|giảm học phí|trợ cấp xã hội"), ("GIAY_XAC_NHAN", "giấy xác nhận sinh viên|xác nhận sinh viên|cấp lại thẻ"), ("KHEN_THUONG", "khen thưởng|nckh|nghiên cứu khoa học")]


def _first(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


def zones(text: Column) -> tuple[Column, Column]:
    """The lines of the head (twenty at most, up to the first citation), and all lines that are no citation or address."""
    lines = F.transform(F.split(F.regexp_replace(text, "</?hw>", ""), "\n"), lambda x: F.trim(x))
    head = F.slice(lines, 1, 20)
    stop = F.array_position(F.transform(head, lambda x: F.regexp_like(F.lower(x), F.lit(_CITED))), True)
    head = F.when(stop > 0, F.slice(head, F.lit(1), (stop - 1).cast("int"))).otherwise(head)
    return F.array_join(head, "\n"), F.array_join(F.filter(lines, lambda x: ~F.regexp_like(F.lower(x), F.lit(_ASIDE))), "\n")


def fields(spark: SparkSession, d: str) -> DataFrame:
    """(id, student, name, class, faculty, kind, reason, day, number): each by its first pattern that fits; days that don't exist are null."""
    i = doc_index(spark, d).where("body is not null").select("id", F.concat_ws("\n", "title", "body").alias("x"))
    head, rest = zones(F.col("x"))
    i = i.withColumns({"head": head, "rest": rest, "low": F.lower("x")})
    x = F.col("x")
    part = lambda k: F.coalesce(*[F.nullif(F.regexp_extract(x, p, k), F.lit("")) for p in _DAYS])
    # all three parts come from the first pattern that is found
    one = F.regexp_like(x, F.lit(_DAYS[0]))
    pick = lambda k: F.when(one, F.regexp_extract(x, _DAYS[0], k)).otherwise(F.regexp_extract(x, _DAYS[1], k))
    day = F.date_format(F.try_to_timestamp(F.concat_ws("-", pick(3), F.lpad(pick(2), 2, "0"), F.lpad(pick(1), 2, "0")), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")
    name = _first(x, [_NAME])
    kind = reduce(lambda a, b: a.when(F.regexp_like("low", F.lit(b[1])), b[0]), KINDS[1:], F.when(F.regexp_like("low", F.lit(KINDS[0][1])), KINDS[0][0]))
    number = F.coalesce(_first(F.col("head"), _NUM), _first(F.col("rest"), _NUM))
    return i.select(
        "id", _first(x, _STUDENT).alias("student"), F.when(F.size(F.split(name, " +")) >= 2, name).alias("name"), _first(x, [_CLASS]).alias("class"), _first(x, [_FACULTY]).alias("faculty"),
        kind.alias("kind"), _first(x, [_REASON]).alias("reason"), day.alias("day"), F.rtrim(F.regexp_replace(number, r"\s*/\s*", "/"), F.lit(".,;:- ")).alias("number"),
    )


def _fields_sql() -> str:
    first = lambda x, ps: "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({x}, '{p}', 1)), '')" for p in ps) + ")"
    pick = lambda k: f"CASE WHEN regexp_matches(x, '{_DAYS[0]}') THEN regexp_extract(x, '{_DAYS[0]}', {k}) ELSE regexp_extract(x, '{_DAYS[1]}', {k}) END"
    return f"""WITH {IDX}, t AS (SELECT id, concat_ws(chr(10), title, body) AS x FROM idx WHERE body IS NOT NULL), l AS (SELECT id, x, lower(x) AS low, list_transform(string_split(regexp_replace(x, '</?hw>', '', 'g'), chr(10)), lambda v: trim(v)) AS lines FROM t),
s AS (SELECT *, list_position(list_transform(lines[1:20], lambda v: regexp_matches(lower(v), '{_CITED}')), true) AS stop FROM l),
z AS (SELECT id, x, low, array_to_string(CASE WHEN stop > 0 THEN lines[1:20][1:stop - 1] ELSE lines[1:20] END, chr(10)) AS head, array_to_string(list_filter(lines, lambda v: NOT regexp_matches(lower(v), '{_ASIDE}')), chr(10)) AS rest FROM s),
n AS (SELECT *, {first('x', [_NAME])} AS nm FROM z)
SELECT id, {first('x', _STUDENT)} AS student, CASE WHEN len(regexp_split_to_array(nm, ' +')) >= 2 THEN nm END AS name, {first('x', [_CLASS])} AS class, {first('x', [_FACULTY])} AS faculty, CASE {' '.join(f"WHEN regexp_matches(low, '{p}') THEN '{k}'" for k, p in KINDS)} END AS kind, {first('x', [_REASON])} AS reason,
strftime(try_strptime({pick(3)} || '-' || lpad({pick(2)}, 2, '0') || '-' || lpad({pick(1)}, 2, '0'), '%Y-%m-%d'), '%Y-%m-%d') AS day, rtrim(regexp_replace(coalesce({first('head', _NUM)}, {first('rest', _NUM)}), '\\s*/\\s*', '/', 'g'), '.,;:- ') AS number FROM n"""


# Document types: code, title words, number suffixes, words of the head.
TYPES = [
    ("THONG_BAO", ["thong bao", "thong bac"], ["TB"], ["nay thong bao", "thong bao den"]), ("KE_HOACH", ["ke hoach"], ["KH"], ["ban hanh ke hoach", "muc tieu", "yeu cau"]),
    ("QUYET_DINH", ["quyet dinh", "quyet dnh"], ["QD", "QĐ"], ["quyet dinh:", "dieu 1", "dieu 2"]), ("HUONG_DAN", ["huong dan"], ["HD"], ["cac buoc", "huong dan thuc hien"]),
    ("BAO_CAO", ["bao cao"], ["BC"], ["tinh hinh", "ket qua"]), ("TO_TRINH", ["to trinh"], ["TTR"], ["kinh trinh", "de nghi"]), ("CONG_VAN", [], ["CV"], ["kinh gui", "v/v", "ve viec"]),
    ("GIAY_MOI", ["giay moi"], ["GM"], ["tran trong kinh moi", "toi du"]), ("BIEN_BAN", ["bien ban"], ["BB"], ["thanh phan tham du", "noi dung cuoc hop"]), ("DANH_SACH", ["danh sach"], ["DS"], ["stt", "ho va ten", "mssv"]),
    ("DIEU_LE_QUY_CHE", ["dieu le", "quy che", "quy dinh"], ["QC", "DL", "QDI"], ["chuong i", "dieu 1"]), ("DON_TU", ["don xin", "don de nghi", "giay de nghi", "don"], [], ["kinh gui", "em ten la", "ho va ten"]),
    ("GIAY_XAC_NHAN", ["giay xac nhan", "xac nhan"], ["GXN"], ["chung nhan", "xac nhan"]),
]
SUBTYPES = [("hoc_bong", "hoc bong"), ("mien_giam_hoc_phi", "mien giam|hoc phi"), ("bao_luu", "bao luu|ket qua hoc tap"), ("nghi_hoc_tam_thoi", "nghi hoc tam thoi"), ("xac_nhan_sinh_vien", "xac nhan sinh vien"), ("cap_lai_the", "cap lai the|lam lai the"), ("gia_han_hoc_tap", "gia han hoc tap|keo dai thoi gian")]
_SUFFIX = r"\d{1,5}\s*/\s*([A-ZĐa-z]{2,5})"


def types(spark: SparkSession, d: str) -> DataFrame:
    """(id, code, subtype, conf): suffix 0.6, title 0.8, 0.15 for each word of the head, and rules of structure; the best of 0.55 or more, the first of equal ones."""
    i = doc_index(spark, d).select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"))
    h = i.select("id", F.upper(F.regexp_extract("title", _SUFFIX, 1)).alias("s"), fold("title").alias("t"), fold(F.concat_ws("\n", "title", F.array_join(F.slice(F.split("body", "\n"), 1, 30), "\n"))).alias("h"))
    c = F.col
    title = lambda p: F.array_contains(F.split("t", r"\s+"), p) if " " not in p else c("t").contains(p)
    some = lambda ps: reduce(lambda a, b: a | b, [c("h").contains(p) for p in ps])
    gui, don, vv = c("h").contains("kinh gui"), some(["don xin", "don de nghi", "giay de nghi"]), some(["v/v", "ve viec"])
    who, rows = some(["em ten la", "ten em la", "ho va ten", "mssv"]), some(["stt", "mssv", "ma sinh vien", "ho va ten", "ho ten"])
    extra = {"CONG_VAN": F.when(gui & vv & (c("t") == ""), 70).otherwise(0), "DON_TU": F.when(gui & don, 80).when(don & who, 75).otherwise(0), "DANH_SACH": F.when(c("h").contains("danh sach") & rows, 80).otherwise(0)}
    scores = []
    for k, (code, titles, suffixes, hints) in enumerate(TYPES):
        v = F.lit(0)
        if suffixes:
            v += F.when(c("s").isin(*suffixes), 60).otherwise(0)
        if titles:
            v += F.when(reduce(lambda a, b: a | b, [title(p) for p in titles]), 80).otherwise(0)
        v += reduce(lambda a, b: a + b, [F.when(c("h").contains(p), 15).otherwise(0) for p in hints])
        scores.append(F.struct((v + extra.get(code, F.lit(0))).alias("v"), F.lit(-k).alias("k"), F.lit(code).alias("code")))
    best = h.withColumn("b", F.array_max(F.array(*scores)))
    code = F.when(c("b.v") >= 55, c("b.code")).otherwise("KHAC")
    sub = reduce(lambda a, b: a.when(F.regexp_like("h", F.lit(b[1])), b[0]), SUBTYPES[1:], F.when(F.regexp_like("h", F.lit(SUBTYPES[0][1])), SUBTYPES[0][0])).otherwise("khac")
    return best.select("id", code.alias("code"), F.when(code == "DON_TU", sub).alias("subtype"), F.least(c("b.v"), F.when(c("b.v") >= 55, 95).otherwise(c("b.v"))).alias("conf"))


def _types_sql() -> str:
    has = lambda p: f"contains(h, '{p}')"
    title = lambda p: f"list_contains(regexp_split_to_array(t, '\\s+'), '{p}')" if " " not in p else f"contains(t, '{p}')"
    some = lambda ps: "(" + " OR ".join(map(has, ps)) + ")"
    don, who = some(["don xin", "don de nghi", "giay de nghi"]), some(["em ten la", "ten em la", "ho va ten", "mssv"])
    extra = {"CONG_VAN": f"CASE WHEN {has('kinh gui')} AND {some(['v/v', 've viec'])} AND t = '' THEN 70 ELSE 0 END", "DON_TU": f"CASE WHEN {has('kinh gui')} AND {don} THEN 80 WHEN {don} AND {who} THEN 75 ELSE 0 END", "DANH_SACH": f"CASE WHEN {has('danh sach')} AND {some(['stt', 'mssv', 'ma sinh vien', 'ho va ten', 'ho ten'])} THEN 80 ELSE 0 END"}
    legs = []
    for k, (code, titles, suffixes, hints) in enumerate(TYPES):
        parts = [extra.get(code, "0")] + [f"CASE WHEN {has(p)} THEN 15 ELSE 0 END" for p in hints]
        if suffixes:
            parts.append("CASE WHEN s IN ({}) THEN 60 ELSE 0 END".format(", ".join(f"'{x}'" for x in suffixes)))
        if titles:
            parts.append("CASE WHEN {} THEN 80 ELSE 0 END".format(" OR ".join(map(title, titles))))
        legs.append(f"SELECT id, h, {k} AS k, '{code}' AS code, {' + '.join(parts)} AS v FROM hd")
    return f"""WITH {IDX}, hd AS (SELECT id, upper(regexp_extract(coalesce(title, ''), '{_SUFFIX}', 1)) AS s, {sql_fold("coalesce(title, '')")} AS t, {sql_fold("concat_ws(chr(10), coalesce(title, ''), array_to_string(string_split(coalesce(body, ''), chr(10))[1:30], chr(10)))")} AS h FROM idx),
l AS ({' UNION ALL '.join(legs)}), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, k) AS r FROM l)
SELECT id, CASE WHEN v >= 55 THEN code ELSE 'KHAC' END AS code, CASE WHEN v >= 55 AND code = 'DON_TU' THEN CASE {' '.join(f"WHEN regexp_matches(h, '{p}') THEN '{s}'" for s, p in SUBTYPES)} ELSE 'khac' END END AS subtype, CASE WHEN v >= 55 THEN least(v, 95) ELSE v END::INT AS conf FROM b WHERE r = 1"""


# Topics by words of the folded text, in the order in which they are given out.
TOPICS = [
    ("#HocBong", "hoc bong|scholarship|khuyen khich hoc tap"), ("#HocPhi", "hoc phi|tuition"), ("#MienGiam", "mien giam"), ("#KyTucXa", "ky tuc xa|ktx|dormitory"), ("#BaoHiem", "bao hiem|bhyt|insurance"), ("#RenLuyen", "ren luyen|drl"),
    ("#NghienCuu", "nghien cuu khoa hoc|nckh|research"), ("#ThiCu", "lich thi|ky thi|exam"), ("#TotNghiep", "tot nghiep|graduation"), ("#NhapHoc", "nhap hoc|tuyen sinh"), ("#KhaiGiang", "khai giang"), ("#NghiLe", "nghi le|nghi tet"),
    ("#AnNinh", "an ninh|trat tu"), ("#SucKhoe", "suc khoe|kham benh|y te"), ("#ThuVien", "thu vien|library"), ("#KinhPhi", "kinh phi|budget"), ("#TapHuan", "tap huan|training"), ("#KyLuat", "ky luat|canh cao"), ("#KhenThuong", "khen thuong|tuyen duong"),
    ("#VayVon", "vay von|ngan hang chinh sach"), ("#QuanSu", "nghia vu quan su|nvqs"), ("#ViecLam", "viec lam|tuyen dung"), ("#TheSinhVien", "the sinh vien"), ("#BaoLuu", "bao luu|tam dung"), ("#CoVan", "co van hoc tap"), ("#ThucTap", "thuc tap|internship"),
]
GENRES = [("#ThongBao", "^thong bao"), ("#KeHoach", "^ke hoach"), ("#QuyetDinh", "^quyet dinh"), ("#HuongDan", "^huong dan"), ("#ToTrinh", "^to trinh"), ("#BaoCao", "^bao cao"), ("#CongVan", "^cong van"), ("#GiayMoi", "^giay moi"), ("#BienBan", "^bien ban"), ("#DanhSach", "^danh sach"), ("#DonTu", "^(don|giay de nghi)")]
FACULTIES = [("#Khoa_CNTT", "cong nghe thong tin"), ("#Khoa_Luat", "khoa luat|luat hoc"), ("#Khoa_Toan", "khoa toan|toan tin"), ("#Khoa_VatLy", "vat ly"), ("#Khoa_HoaHoc", "hoa hoc"), ("#Khoa_SinhHoc", "sinh hoc"), ("#Khoa_NguVan", "ngu van"), ("#Khoa_NgoaiNgu", "ngoai ngu"), ("#Khoa_NongLam", "nong lam"), ("#Khoa_KinhTe", "kinh te|quan tri")]
PRIORITY = {"SO_HIEU": 100, "LOAI_DON": 85, "CHU_DE": 70, "NGANH": 55, "KHOA": 40, "KHOA_HOC": 25}
COLOURS = {"SO_HIEU": "red", "LOAI_DON": "amber", "CHU_DE": "teal", "NGANH": "green", "KHOA": "blue", "KHOA_HOC": "purple"}


def tag_group(tag: Column) -> Column:
    """Which of the six groups a tag is of."""
    t = F.upper(tag)
    genre = t.isin(*[g.upper() for g, _ in GENRES])
    return F.when(F.regexp_like(t, F.lit("^#(SO_|[0-9])")), "SO_HIEU").when(t.startswith("#NGANH"), "NGANH").when(t.startswith("#KHOA_HOC") | F.regexp_like(t, F.lit("^#K[0-9]{2}")), "KHOA_HOC").when(t.startswith("#KHOA_"), "KHOA").when(genre, "LOAI_DON").otherwise("CHU_DE")


def _group_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches(upper({x}), '^#(SO_|[0-9])') THEN 'SO_HIEU' WHEN starts_with(upper({x}), '#NGANH') THEN 'NGANH' WHEN starts_with(upper({x}), '#KHOA_HOC') OR regexp_matches(upper({x}), '^#K[0-9]{{2}}') THEN 'KHOA_HOC' WHEN starts_with(upper({x}), '#KHOA_') THEN 'KHOA' WHEN upper({x}) IN ({', '.join(repr(g.upper()) for g, _ in GENRES)}) THEN 'LOAI_DON' ELSE 'CHU_DE' END"


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """(id, tags, priority): number, genre, topics (four at most, in their order), faculties and intake of each document, by priority."""
    i = doc_index(spark, d).select("id", F.coalesce("title", F.lit("")).alias("title"), fold(F.coalesce("title", F.lit(""))).alias("t"), fold(F.concat_ws(" ", "title", "body")).alias("x"), F.coalesce("student_id", F.lit("")).alias("sid"))
    hits = lambda rules, of: F.filter(F.array(*[F.when(F.regexp_like(of, F.lit(p)), F.lit(t)) for t, p in rules]), lambda v: v.isNotNull())
    number = F.regexp_extract("title", r"(\d{1,5}/[A-ZĐa-z]{2,4}-[A-ZĐ]{2,5})", 1)
    number = F.when(number != "", F.array(F.concat(F.lit("#"), F.translate(number, "/-ĐđĂâ", "__Dd")))).otherwise(F.array().cast("array<string>"))
    digits = F.regexp_replace("sid", r"\D", "")
    intake = F.when(F.length(digits) >= 8, F.array(F.concat(F.lit("#K"), (F.substring(digits, 3, 2).cast("int") + 24).cast("string")))).otherwise(F.array().cast("array<string>"))
    tags = F.concat(number, F.slice(hits(GENRES, F.col("t")), 1, 1), F.slice(hits(TOPICS, F.col("x")), 1, 4), hits(FACULTIES, F.col("x")), intake)
    table = F.create_map(*[F.lit(v) for kv in PRIORITY.items() for v in kv])
    most = F.coalesce(F.array_max(F.transform("tags", lambda t: table[tag_group(t)])), F.lit(0))
    return i.withColumn("tags", F.array_distinct(tags)).select("id", F.array_join("tags", ",").alias("tags"), most.alias("priority"))


def _tagged_sql() -> str:
    hits = lambda rules, of: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({of}, '{p}') THEN '{t}' END" for t, p in rules) + "], lambda v: v IS NOT NULL)"
    pri = " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items())
    return f"""WITH {IDX}, i AS (SELECT id, regexp_extract(coalesce(title, ''), '(\\d{{1,5}}/[A-ZĐa-z]{{2,4}}-[A-ZĐ]{{2,5}})', 1) AS num, {sql_fold("coalesce(title, '')")} AS t, {sql_fold("concat_ws(' ', title, body)")} AS x, regexp_replace(coalesce(student_id, ''), '\\D', '', 'g') AS sid FROM idx),
g AS (SELECT id, list_concat(CASE WHEN num <> '' THEN ['#' || translate(num, '/-ĐđĂâ', '__Dd')] ELSE []::VARCHAR[] END, {hits(GENRES, 't')}[1:1], {hits(TOPICS, 'x')}[1:4], {hits(FACULTIES, 'x')}, CASE WHEN length(sid) >= 8 THEN ['#K' || (sid[3:4]::INT + 24)::VARCHAR] ELSE []::VARCHAR[] END) AS tags FROM i)
SELECT id, array_to_string(tags, ',') AS tags, coalesce(list_max(list_transform(tags, lambda v: CASE {_group_sql('v')} {pri} END)), 0) AS priority FROM g"""


def tag_table(spark: SparkSession, d: str) -> DataFrame:
    """(tag, n, tag_group, priority, colour): every stored tag with its group, most important and most frequent first."""
    t = doc_index(spark, d).select("id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(N(F.lit(1)).alias("n")).withColumn("tag_group", tag_group(F.col("tag")))
    table = lambda m: F.create_map(*[F.lit(v) for kv in m.items() for v in kv])[F.col("tag_group")]
    return t.withColumns({"priority": table(PRIORITY), "colour": table(COLOURS)}).orderBy(F.desc("priority"), F.desc("n"), "tag")


TAG_SQL = f"WITH {IDX}, t AS (SELECT tag, count(*) AS n, {_group_sql('tag')} AS tag_group FROM (SELECT DISTINCT id, unnest(tags) AS tag FROM idx) GROUP BY tag) SELECT *, CASE tag_group {' '.join(f'WHEN {k!r} THEN {v}' for k, v in PRIORITY.items())} END AS priority, CASE tag_group {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in COLOURS.items())} END AS colour FROM t"


def retagged(spark: SparkSession, d: str) -> DataFrame:
    """(id, added, removed): records whose stored tags and newly given ones differ as sets."""
    new = tagged(spark, d).select("id", F.split("tags", ",").alias("new"))
    old = doc_index(spark, d).select("id", F.coalesce("tags", F.array().cast("array<string>")).alias("old"))
    both = new.join(old, "id").select("id", F.size(F.array_except("new", "old")).alias("added"), F.size(F.array_except("old", "new")).alias("removed"))
    return both.where("added + removed > 0")


RETAG_SQL = f"WITH n AS ({_tagged_sql()}), o AS (WITH {IDX} SELECT id, coalesce(tags, []::VARCHAR[]) AS old FROM idx), b AS (SELECT id, string_split(n.tags, ',') AS new, old FROM n JOIN o USING (id)), c AS (SELECT id, len(list_filter(list_distinct(new), lambda v: NOT list_contains(old, v)))::INT AS added, len(list_filter(list_distinct(old), lambda v: NOT list_contains(new, v)))::INT AS removed FROM b) SELECT * FROM c WHERE added + removed > 0"


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """(original_filename, safe, ascii, key): a name without odd characters, in plain letters, and its object key by month."""
    r = records(spark, d).select("id", "original_filename", "created_at")
    safe = F.regexp_replace("original_filename", r"[^\p{L}\p{N}._\-]+", "_")
    plain = F.regexp_replace(fold(safe), r"[^a-z0-9._\-]+", "_")
    return r.select("id", safe.alias("safe"), plain.alias("ascii"), F.concat_ws("/", F.lit("documents"), F.date_format("created_at", "yyyy/MM"), F.concat_ws("_", F.substring("id", 1, 8), plain)).alias("key"))


FILES_SQL = rf"WITH {IDX}, s AS (SELECT id, created_at, regexp_replace(original_filename, '[^\p{{L}}\p{{N}}._\-]+', '_', 'g') AS safe FROM rec), p AS (SELECT *, regexp_replace({sql_fold('safe')}, '[^a-z0-9._\-]+', '_', 'g') AS ascii FROM s) SELECT id, safe, ascii, 'documents/' || strftime(created_at, '%Y/%m') || '/' || id[1:8] || '_' || ascii AS key FROM p"


def baseline_types(spark: SparkSession, d: str) -> DataFrame:
    """(truth, guess, n): ten key words in order, the first that fits, against the documents' type codes."""
    x = fold("text")
    case = reduce(lambda a, b: a.when(x.contains(b[1]), b[0]), _BASE[1:], F.when(x.contains(_BASE[0][1]), _BASE[0][0])).otherwise("KHAC")
    return load(spark, d, "documents").where("doc_type_code is not null").groupBy(F.col("doc_type_code").alias("truth"), case.alias("guess")).agg(N(F.lit(1)).alias("n"))


_BASE = [("QUYET_DINH", "quyet dinh"), ("THONG_BAO", "thong bao"), ("KE_HOACH", "ke hoach"), ("TO_TRINH", "to trinh"), ("BIEN_BAN", "bien ban"), ("DANH_SACH", "danh sach"), ("GIAY_XAC_NHAN", "xac nhan"), ("HUONG_DAN", "huong dan"), ("CONG_VAN", "cong van"), ("DON_TU", "don")]
BASE_SQL = f"SELECT doc_type_code AS truth, CASE {' '.join(f'WHEN contains(x, {p!r}) THEN {c!r}' for c, p in _BASE)} ELSE 'KHAC' END AS guess, count(*) AS n FROM (SELECT doc_type_code, {sql_fold('text')} AS x FROM documents WHERE doc_type_code IS NOT NULL) GROUP BY 1, 2"


@F.pandas_udf(T.StringType())
def json_object(answers: pd.Series) -> pd.Series:
    """The JSON object inside an answer, mended: fences and words around it, trailing commas, single quotes; null if there is none."""
    import json
    import re

    def one(text: str | None) -> str | None:
        m = re.search(r"\{.*\}", text or "", re.S)
        if not m:
            return None
        for body in (m.group(), re.sub(r",\s*([}\]])", r"\1", m.group()), re.sub(r",\s*([}\]])", r"\1", m.group()).replace("'", '"')):
            try:
                return json.dumps(json.loads(body), ensure_ascii=False, sort_keys=True)
            except ValueError:
                continue
        return None

    return answers.map(one)


def parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """(id, lop, khoa): class code and intake out of answers that wrap the stored JSON in words."""
    m = load(spark, d, "document_metadata").dropDuplicates(["id"]).where("extra is not null")
    j = json_object(F.concat(F.lit("Kết quả:\n```json\n"), F.regexp_replace("extra", r"\}$", ",}"), F.lit("\n```")))
    return m.withColumn("j", j).select("id", F.get_json_object("j", "$.lop").alias("lop"), F.get_json_object("j", "$.khoa_hoc").alias("khoa"))


ANSWERS_SQL = "SELECT DISTINCT id, extra->>'$.lop' AS lop, extra->>'$.khoa_hoc' AS khoa FROM document_metadata WHERE extra IS NOT NULL"


def typed_names(spark: SparkSession, d: str) -> DataFrame:
    """(image, group_id, line): the source of a recognition line by its name, and the number of the line."""
    c = load(spark, d, "ocr_comparison").select("image").distinct()
    stem = F.regexp_extract("image", r"([^/\\]+?)(?:_p\d+)?_line_\d+", 1)
    return c.select("image", F.coalesce(F.nullif(stem, F.lit("")), F.regexp_replace("image", r"\.[A-Za-z0-9]+$", "")).alias("group_id"), F.regexp_extract("image", r"_line_(\d+)", 1).alias("line"))


NAMES_SQL = r"SELECT DISTINCT image, coalesce(nullif(regexp_extract(image, '([^/\\]+?)(?:_p\d+)?_line_\d+', 1), ''), regexp_replace(image, '\.[A-Za-z0-9]+$', '', 'g')) AS group_id, regexp_extract(image, '_line_(\d+)', 1) AS line FROM ocr_comparison"

_ROW = r"\b(\d{7,8})\s+((?:\p{Lu}\p{L}+ ?){2,5})\s*(?:(CTK|QTK|SPK)\w*)?\s*([0-4][.,]\d{1,2})?"


def table_rows(spark: SparkSession, d: str) -> DataFrame:
    """(id, line, number, name): rows of a table by their form: a student number and a name on one line."""
    l = doc_index(spark, d).select("id", F.posexplode(F.split("body", "\n")).alias("line", "l")).where(F.regexp_like("l", F.lit(_ROW)))
    return l.select("id", "line", F.regexp_extract("l", _ROW, 1).alias("number"), F.trim(F.regexp_extract("l", _ROW, 2)).alias("name"))


ROWS_SQL = f"WITH {IDX}, l AS (SELECT id, (generate_subscripts(p, 1) - 1)::INT AS line, unnest(p) AS l FROM (SELECT id, string_split(body, chr(10)) AS p FROM idx)) SELECT id, line, regexp_extract(l, '{_ROW}', 1) AS number, trim(regexp_extract(l, '{_ROW}', 2)) AS name FROM l WHERE regexp_matches(l, '{_ROW}')"

CATALOG = {
    "extract_all_fields": (fields, _fields_sql()), "classify_types": (types, _types_sql()), "tag_documents": (tagged, _tagged_sql()), "tag_groups": (tag_table, TAG_SQL), "retag_changes": (retagged, RETAG_SQL), "file_names": (file_names, FILES_SQL),
    "baseline_types": (baseline_types, BASE_SQL), "json_answers": (parsed_answers, ANSWERS_SQL), "line_groups": (typed_names, NAMES_SQL), "table_rows": (table_rows, ROWS_SQL),
}
