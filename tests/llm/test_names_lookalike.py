"""Name linking and look-alike repair against brute force, and their defined cases."""

import unicodedata

import pytest

from scrivan.llm import lookalike, names


def test_similarity():
    assert names.monge_elkan("hieu ksor n x", "hieu ksor nhat xuan") > 0.9
    assert names.monge_elkan("pham trong ty", "phamg trong ty") > 0.9
    assert names.monge_elkan("an nguyen", "binh tran") == 0
    assert names.monge_elkan("", "an") == 0
    assert names.damerau("20009759", "20007959") == 1 and names.damerau("ab", "") == 2
    b = names.bands_needed(0.2, 1, 0.98)
    assert 1 - 0.8**b >= 0.98 > 1 - 0.8 ** (b - 1)


ROWS = [
    ("a1", "MSSV: 20008310", "Nguyễn Đức Vân", '{"lop": "TTK0000"}'),
    ("a2", "2000 8310", "Nguyễn Đ. Vân", None),
    ("a3", "20008310.", "Nguyen Duc Van", '{"lop": "Lớp TTK0000"}'),
    ("a4", "20008301", "Nguyễn Đứcc Vân", '{"lop": "ttk-0000"}'),  # two digits swapped
    ("a5", None, "VAN NGUYEN DUC", '{"lop": "TTK-0000"}'),
    ("b1", "20001111", "Nguyễn Đức Vân", '{"lop": "NKK0001"}'),  # another class, another student
    ("b2", "20001111", "Nguyễn Đức Vân", '{"lop": "NKK0001"}'),
    ("c1", None, "Lê Hữu Điệp", '{"lop": "NKK0000"}'),
    ("c2", None, "Le Huu Diep", '{"lop": "nkk0000"}'),
    ("d1", None, "Lê Hữu Điệp", None),
    ("e1", None, None, None),
    ("e2", "", "", "not json"),
    ("a1", "MSSV: 20008310", "Nguyễn Đức Vân", '{"lop": "TTK0000"}'),
]


def test_students(spark):
    df = spark.createDataFrame([(*r, "z") for r in ROWS], "id string, student_id string, student_name string, extra string, name string")
    got = {tuple(r) for r in names.found(df).collect()}
    a = ["a1", "a2", "a3", "a4", "a5"]
    want = {(x, y) for x in a for y in a if x < y} | {("c1", "c2")}
    assert got == want
    assert names.found(df.limit(0)).count() == 0
    assert {r.id for r in names.linked(df).collect()} == {r[0] for r in ROWS}


def test_no_table_of_names_is_broadcast(spark, monkeypatch):
    plans, stage = [], names.stage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    monkeypatch.setattr(names, "stage", seen)
    last = names.found(spark.createDataFrame(ROWS, "id string, student_id string, student_name string, extra string"))
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


def test_hot_bands(spark, monkeypatch):
    df = spark.createDataFrame([*ROWS], "id string, student_id string, student_name string, extra string")
    want = {tuple(r) for r in names.found(df).collect()}
    monkeypatch.setattr(names, "HOT", 2)
    assert {tuple(r) for r in names.found(df).collect()} <= want


def test_hot_bands_lose_no_link(spark, monkeypatch):
    first, middle, last = ["nguyen", "tran", "le", "pham", "hoang"], ["thi minh", "van quoc", "duc anh", "huu nhat"], ["xuan", "hanh", "vinh", "khoa", "phuong"]
    full = [f"{x} {y} {z}" for x in first for y in middle for z in last]
    short = [" ".join([n.split(" ")[0], *(w[0] for w in n.split(" ")[1:-1]), n.split(" ")[-1]]) for n in full]
    rows = [(str(k), None if k % 2 else f"2{k:07}", n, '{"lop": "TTK0000"}') for k, n in enumerate(full + short)]
    base = names.entities(spark.createDataFrame(rows, "id string, student_id string, student_name string, extra string")).cache()
    want = {(r.a, r.b) for r in names.links(base).collect()}
    monkeypatch.setattr(names, "HOT", 7)
    assert {(r.a, r.b) for r in names.links(base).collect()} == want and len(want) > 50


TEXTS = [
    ("1", "Sinh viên bình thường, số 12/ĐHSL – «договор» α", False),
    ("2", unicodedata.normalize("NFD", "Trường Đại học, nghiệm thu ữ"), True),
    ("3", "ｔｒưởｎｇ ２３／０９ ｔｈｅ̂̉．", True),
    ("4", "ph​òng\xa0công　t﻿ác ­x", True),
    ("5", "chі hội nɡày ðúng Τhư", True),
    ("6", "", False),
    ("7", None, False),
    ("8", "​ ́", True),
    ("9", "từ " * 50_000 + "ngàу", True),
    ("1", "Sinh viên bình thường, số 12/ĐHSL – «договор» α", False),
    ("a", "q̣̂ ệ́ ỡ", True),
]
PLAIN = {"3": "trưởng 23/09 thể.", "4": "phòng công tác x", "5": "chi hội ngày đúng Thư", "8": " ́", "9": "từ " * 50_000 + "ngày"}


def test_normalise(spark):
    df = spark.createDataFrame([(*r, "q") for r in TEXTS], "id string, corrected_text string, dirty boolean, text string")
    none = spark.createDataFrame([("i", "ọ́", 1)], "image string, ground_truth string, map int")
    got = {(r.table_name, r.row_key): r.text for r in lookalike.texts(df, none).collect()}
    assert len(got) == len({r[0] for r in TEXTS}) + 1
    for key, text, _ in TEXTS:
        want = PLAIN.get(key, text if text is None else unicodedata.normalize("NFC", text))
        assert got["ocr_results", key] == want, key
    found = {r.row_key for r in lookalike.found(df, none).collect()}
    assert found == {k for k, _, dirty in TEXTS if dirty} | {"i"}
    assert lookalike.found(df.limit(0), none.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["ệ" * 3, "Ậ ấ ữ ợ", "q̣̂́", "ạ́̂b", "x̧̌"])
def test_recomposition_is_nfc(spark, text):
    both = text + " " + unicodedata.normalize("NFD", text)
    df = spark.createDataFrame([("1", both)], "k string, t string")
    assert lookalike.normalised(df, ["k"], "t").first().text == unicodedata.normalize("NFC", both)
