"""Scan noise: anagram joins against direct search, repairs of made pages, and the defined cases."""

import random

import pytest
from pyspark.sql import functions as F

from scrivan.llm import scan_noise as sn

SENTENCES = [
    "Khoa ngữ văn phải khôi phục danh sách học bổng trước ngày 12/03/2024.",
    "Phòng đào tạo thông báo kết quả thực tập của sinh viên năm cuối.",
    "Hội đồng trường bình xét học phí và bảo hiểm cho sinh viên nội trú.",
    "The training office supports the optional reading of the approved budget.",
]


def page(rng, n=12):
    return [rng.choice(SENTENCES) for _ in range(n)]


@pytest.fixture(scope="module")
def results():
    rng, rows = random.Random(1), []
    for k in range(60):
        rows.append((f"ok{k}", "\n".join(page(rng)), None))
    for k in range(30):
        a, b = page(rng, 6), page(rng, 6)
        rows.append((f"h{k}", "\n".join(["Trường Đại học Sương Lâm | nội bộ", *a, f"tr. {2 * k}", "TRƯỜNG ĐẠI HỌC SƯƠNG LÂM | NỘI BỘ", *b, f"tr. {2 * k + 1}"]), None))
    rows += [
        ("once", "\n".join(["Trường Đại học Sương Lâm | nội bộ", *page(rng)]), None),
        ("break", "Khoa ngữ văn phải khôi ph-\nục danh sách học bổng trước ngày", "x"),
        ("break2", "The training office supports the optio¬\n- 7 -\nnal reading\n\nmore\nthat\nis\nhere\n- 8 -", None),
        ("code", "theo Thông báo số 12/TB-\nĐHSL của phòng đào tạo", None),
        ("chars", "Kh0a ngữ văn và pliòng đào tạo", "tliông báo|kết quả"),
        ("number", "ngày 12/03/2O24 và số 80344734l", None),
        ("name", "Người ký: Nguyễn Dào Phúc", None),
        ("value", "căn cước\n123\nvăn phòng khoa\nhọc phí", None),
        ("plain", "phải khôi\nphục danh sách", None),
        ("empty", "", None),
        ("null", None, None),
        ("mail", "gửi kh0a@suonglam.example ngay", None),
        ("long", " ".join(page(rng, 3000)) + " kh0a", None),
        ("break", "Khoa ngữ văn phải khôi ph-\nục danh sách học bổng trước ngày", "x"),
    ]
    return [(a, b, c, "z") for a, b, c in rows]


def test_found_and_repaired(spark, results, monkeypatch):
    monkeypatch.setattr(sn, "LEAST", 5)
    df = spark.createDataFrame(results, "id string, raw_text string, corrected_text string, text string")
    got = {}
    out = {(r.ocr_id, r.field_name): r for r in sn.repaired(df).collect()}
    for (key, field), r in out.items():
        got[key] = got.get(key, set()) | set(r.kinds)
    assert got["ok0"] == got["once"] == got["code"] == got["plain"] == got["empty"] == got["value"] == got["mail"] == got["name"] == set()
    assert "null" not in got
    assert got["h3"] == {"running_header", "page_number"}
    assert got["break"] == {"hyphen_break"} and got["break2"] == {"hyphen_break", "page_number"}
    assert got["chars"] == got["number"] == got["long"] == {"char_error"}
    assert out["break", "raw_text"].text == "Khoa ngữ văn phải khôi phục danh sách học bổng trước ngày"
    assert out["chars", "raw_text"].text == "Khoa ngữ văn và phòng đào tạo" and out["chars", "corrected_text"].text == "thông báo kết quả"
    assert out["number", "raw_text"].text == "ngày 12/03/2024 và số 803447341"
    assert out["break2", "raw_text"].text.startswith("The training office supports the optional reading")
    assert "tr." not in out["h3", "raw_text"].text
    assert sn.found(df.limit(0)).count() == 0


def test_blocks_give_the_same(spark, results, monkeypatch):
    monkeypatch.setattr(sn, "LEAST", 5)
    df = spark.createDataFrame(results, "id string, raw_text string, corrected_text string, text string")
    want = {(r.ocr_id, r.field_name, r.text, tuple(r.kinds)) for r in sn.repaired(df).collect()}
    monkeypatch.setattr(sn, "MOST_WORDS", 0)
    monkeypatch.setattr(sn, "BLOCK", 7)
    assert {(r.ocr_id, r.field_name, r.text, tuple(r.kinds)) for r in sn.repaired(df).collect()} == want


def test_a_header_of_one_text_alone():
    repair = sn.Repair({}, set(), [])
    pages = "Xí nghiệp Dệt may Hòa Bình\nDòng thứ nhất của trang\n- 1 -\nXí nghiệp Dệt may Hoà Bìnli\nDòng thứ hai của trang\n- 2 -\nXí nghiệp Dệt may Hòa Bình\nhết"
    text, kinds = repair.run(pages)
    assert kinds == {"running_header", "page_number"} and "Xí nghiệp" not in text
    assert repair.run("Báo cáo tuần   1\nnội dung một\nBáo cáo tuần   2\nnội dung hai")[1] == {"running_header", "page_number"}
    assert repair.run("Xí nghiệp Dệt may\nmột\nhai\nXí nghiệp Dệt may\nba")[1] == set()


def test_anagram_join_finds_every_variant(spark):
    rng = random.Random(3)
    frequent = ["phòng", "khoa", "thông", "viên", "trình", "đồng", "hoàn", "những"]
    rare = {}
    for w in frequent:
        for _ in range(12):
            what = rng.sample(sn.CONFUSIONS, rng.choice([1, 2]))
            rare.update({v: w for v in sn.applied(w, what) if v not in frequent})
    rows = [("w", w, 10_000) for w in frequent] + [("w", v, 3) for v in rare] + [("w", "88", 3), ("h", "x", 1)]
    got = {r.rare: r.word for r in sn.corrections(spark.createDataFrame(rows, "kind string, token string, n bigint")).collect()}
    assert got == rare


def test_anagram_hash_ignores_order():
    assert sn.anagram_hash("abc") == sn.anagram_hash("cab") != sn.anagram_hash("abd")
    assert sn.applied("hoan", [("h", "li"), ("n", "ri")]) == {"lioari"}
    assert sn.applied("hợp", [("ợ", "ọ"), ("ọ", "o")]) == set()


def test_sql_columns(spark, results):
    df = spark.createDataFrame(results, "id string, raw_text string, corrected_text string, text string")
    assert sn.found(df).columns == ["ocr_id", "field_name", "noise_kind"]
    assert sn.clean(df).where(F.col("ocr_id") == "ok1").count() == 1


def test_a_line_is_compared_with_the_headers_once(monkeypatch):
    headers = ["truongdaihockhoahoc", "phongcongtacsinhvien", "truongdaihocnghethuat"]
    repair = sn.Repair({}, set(), headers)
    asked, nearest = [], repair.nearest
    monkeypatch.setattr(repair, "nearest", lambda key: asked.append(key) or nearest(key))
    keys = ["truongdaihockhoahoc", "truongdaihocknoahoc", "truongdaihocnghethual", "khonggiongdongnao", "ngan"]
    assert [repair.header_of(k) for k in keys * 3] == [0, 0, 2, -1, -1] * 3 and asked == keys[1:4]
