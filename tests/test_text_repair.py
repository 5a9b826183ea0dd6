"""Golden cases of text repair, extraction and query rewriting, and the alignments against direct versions."""

import random

import pytest
from pyspark.sql import functions as F

from scrivan.functions import text
from scrivan.operators import access, extraction, geometry, lexicon, repair, tooling

RULED = [
    ("tháng 4/năm 2025", "tháng 4 năm"), ("ngày 04) tháng 4", "ngày 04 tháng"), ("ngày <hw>34</hw> tháng 7", "ngày <hw>31</hw> tháng"), ("ngày 37 tháng 7", "ngày 31 tháng"), ("Số: l328/QĐ-ĐHĐL", "1328"), ("O1/QĐ-ĐHĐL", "01"),
    ("làm việc", "làm"), ("OCR engine đang hoạt động", "OCR"), ("văn|bản", "văn bản"), ("học__sinh", "học sinh"), ("IH. Các quy định chung", "III."), ("TI. Phạm vi áp dụng", "II."), ("ngày 15 tháng 12 năm 2025", "tháng 12 năm"),
]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_rules(spark):
    rows = spark.createDataFrame(RULED, "x string, want string").select("x", "want", repair.ruled(F.col("x")).alias("y")).collect()
    assert all(r.want in r.y for r in rows), [r for r in rows if r.want not in r.y]
    assert one(spark, "03610000199\nBỘ GIÁO DỤC", repair.ruled) == "BỘ GIÁO DỤC"
    assert "://" not in one(spark, "theo quy định://?", repair.ruled)


def test_dictionary(spark):
    got = [r.y for r in spark.createDataFrame([("Điêu 1. Quy định chung",), ("Quyét định số 123",), ("Căn cú Luật",), ("tên Phong, giữ nguyên",), (None,)], "x string").select(repair.worded(F.col("x")).alias("y")).collect()]
    assert got == ["Điều 1. Quy định chung", "Quyết định số 123", "Căn cứ Luật", "tên Phong, giữ nguyên", None]


@pytest.mark.parametrize(
    "x, want",
    [("Số : 1328 /QD-DHDL", "Số: 1328/QĐ-ĐHĐL"), ("Số: 13.28/QĐ-ĐHĐL", "Số: 1328/QĐ-ĐHĐL"), ("QUYẾT ĐỊNH về việc phân công", None), ("Căn cứ công văn Số: 12/TB-DHDL\n\n" + "x" * 60 + "\nSố: 45/KH-DHSL", "Số: 45/KH-ĐHSL"), ("số 7/XY-UNKNO", "Số: 7/XY-UNKNO"), ("", None), (None, None)],
)
def test_numbers(spark, x, want):
    assert one(spark, x, repair.number_of) == want


@pytest.mark.parametrize("x, want", [("Lâm Đồng, ngày 04 tháng 40) năm 2025", "ngày 4 tháng 4 năm 2025"), ("ngày 04 tháng 4/năm 2025", "ngày 4 tháng 4 năm 2025"), ("ngày 34 tháng 7 năm 25", "ngày 31 tháng 7 năm 2025"), ("ngày 49 tháng 1 năm 2024", "ngày 19 tháng 1 năm 2024"), ("QUYẾT ĐỊNH", None), (None, None)])
def test_dates(spark, x, want):
    assert one(spark, x, repair.date_of) == want


@pytest.mark.parametrize(
    "x, want",
    [("một dòng\ntiếp theo", "một dòng tiếp theo"), ("KẾ HOẠCH\nnăm học", "KẾ HOẠCH\nnăm học"), ("hết câu.\ntiếp theo", "hết câu.\ntiếp theo"), ("Căn cứ\nLuật Giáo dục", "Căn cứ Luật Giáo dục"), ("cắt ngang-\nDòng", "cắt ngangDòng"), ("a\n\nb", "a\n\nb"), ("xem\n1. mục", "xem\n1. mục"), ("", ""), (None, None)],
)
def test_rejoin(spark, x, want):
    assert one(spark, x, repair.rejoined) == want


def test_zones(spark):
    x = "Số: 1395/KH-ĐHĐL\nKẾ HOẠCH\nCăn cứ Kế hoạch số 1153/KH-BGDĐT\nnội dung"
    head, rest = extraction.zones(F.col("x"))
    r = spark.createDataFrame([(x,)], "x string").select(head.alias("h"), rest.alias("r")).first()
    assert r.h == "Số: 1395/KH-ĐHĐL\nKẾ HOẠCH" and "1153" not in r.r


def test_json_answers(spark):
    rows = [("kết quả ```{'a': 1,}```",), ("không có",), (None,), ('{"a": {"b": [1,2,],}}',)]
    got = [r.y for r in spark.createDataFrame(rows, "x string").select(extraction.json_object("x").alias("y")).collect()]
    assert got == ['{"a": 1}', None, None, '{"a": {"b": [1, 2]}}']


def test_query_rewriting():
    assert lexicon.resolved("xin MG HP và hb kkht") == ("xin miễn giảm học phí và học bổng khuyến khích học tập", True)
    assert lexicon.resolved("không có gì") == ("không có gì", False)
    spec = lexicon.Spec.of("Đơn xin KTX")
    assert spec.q == "don xin ktx" and spec.topics == ["ktx"] and spec.forms == ["don", "xin"] and not spec.plain and "ky tuc xa" in spec.syns and "noi tru" in spec.terms
    assert lexicon.domain_of("tam hoan nvqs") == "NVQS" and lexicon.domain_of("thu vien") is None
    assert lexicon.Spec.of("").words == []


def test_account_numbers_and_functions(spark):
    df = spark.createDataFrame([("CCCD: 068199001234, SDT: 0987654321, email: nguyen.a@gmail.com, STK: 12345678901",)], "x string")
    want = "CCCD: 068******234, SDT: 098****321, email: n***@gmail.com, STK: 1234****01"
    assert df.select(text.mask_pii(F.col("x")).alias("y")).first().y == want
    text.register(spark)
    df.createOrReplaceTempView("t_mask")
    assert spark.sql("select mask_pii(x) y, text_quality(x) q from t_mask").first().y == want
    assert one(spark, "gửi a@b", text.mask_pii) == "gửi a@b"


def test_masks_of_short_numbers(spark):
    assert [one(spark, x, lambda c: access.mask_number(c, 3, 3)) for x in ("0912345678", "12345", "", None)] == ["091****678", "****", "****", None]


def test_time_ranges():
    assert access.time_range("7d", "2025-12-01 00:00:00") == ("2025-11-24", "2025-12-01")
    assert access.time_range("semester", "2025-03-05 00:00:00") == ("2025-02-01", "2025-03-05") and access.time_range("x") is None


def test_ratio_and_alignment_equal_direct_versions():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcđ ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert geometry.ratio(a, b) == pytest.approx(200 * lcs(a, b) / max(1, len(a) + len(b)))
    assert [p[:2] for p in geometry.aligned(["một hai ba", "bốn năm", "sáu"], ["mot hai ba", "chen vào", "bốn nam", "sáu"])] == [(0, 0), (1, 2), (2, 3)]
    assert [p[:2] for p in geometry.greedy_pairs(["abc", "xyz"], ["xyzw", "abc", "abc"])] == [(0, 1), (1, 0)]
    assert geometry.aligned([], ["a"]) == [] and geometry.greedy_pairs(["a"], []) == []


def test_chunks(spark):
    got = one(spark, "một hai ba bốn năm sáu bảy tám " + "x" * 40, tooling.chunked)
    assert got == ["một hai ba bốn năm sáu", "bảy tám", "x" * 40] and one(spark, "", tooling.chunked) == []
