"""Every core query against its SQL on the smallest tables, and the parts that SQL doesn't show."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from scrivan.functions import text
from scrivan.operators.search import _fold
from scrivan.plans import catalog
from scrivan.plans.pipes import SyntaxFault, compiled, lex
from scrivan.sources import files
from scrivan.streaming import streams
from tests.compare import connection, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_contract(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(catalog.QUERIES) <= set(entry_point.queries())
    assert entry_point.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    from scrivan.operators.analytics import dashboard

    plan = dashboard(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "raw_text" not in plan


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_query_folding_is_idempotent(x):
    assert _fold(_fold(x)) == _fold(x)


def test_column_folding(spark):
    words = ["Đại học SƯƠNG", " ệ ", unicodedata.normalize("NFD", "Trường"), "", None]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.fold("w")).collect()]
    assert got == ["dai hoc suong", "e", "truong", "", None]


def test_masks_hide_what_they_should(spark):
    df = spark.createDataFrame([("012345678901 0912345678 123456789 an@b.vn",)], "x string")
    once = df.select(text.mask_pii(F.col("x")).alias("x"))
    assert once.first().x == "012******901 091****678 123***789 a***@b.vn"
    assert once.select(text.mask_pii(F.col("x")).alias("x")).first().x == once.first().x


def test_registered_functions(spark):
    text.register(spark)
    assert spark.sql("select fold_text('Đỗ Ệ') a, word_tokens('Một, hai') b, mask_name('An Bình') c").first() == ("do e", ["mot", "hai"], "A*** B***")


@pytest.mark.parametrize("query", ["", "FROM", "FROM t | WHERE", "FROM t | JUMP", "FROM t | WHERE a ~ 1", "FROM t | STATS f(a)", "FROM t | LIMIT x", "FROM t extra", "FROM t | WHERE (a == 1"])
def test_faulty_pipes(spark, query):
    with pytest.raises(SyntaxFault):
        compiled(query, lambda _: spark.range(3).toDF("a"))


def test_pipes(spark):
    t = spark.createDataFrame([(1, "x|y", None), (2, "it's", 2.0), (3, None, 3.0)], "a int, s string, v double")
    run = lambda q: [tuple(r) for r in compiled(q, lambda _: t).collect()]
    assert run("FROM t | WHERE s == \"x|y\" | KEEP a") == [(1,)]
    assert run("FROM t | WHERE NOT (a == 1 OR a == 2) | KEEP a") == [(3,)]
    assert run("FROM t | SORT v DESC NULLS LAST | KEEP a | LIMIT 2") == [(3,), (2,)]
    assert run("FROM t | EVAL b = -a + 2 * 3, c = a % 2 | DROP s, v, a | WHERE b > 3") == [(5, 1), (4, 0)]
    assert run("FROM t | WHERE s LIKE 'it*' OR v IN (3) | STATS COUNT(*), m = MAX(a)") == [(2, 3)]
    assert lex("a.b >= 1.5") == [("word", "a.b"), ("sign", ">="), ("number", "1.5")]


def test_file_checks(spark, tmp_path):
    sub = tmp_path / "a"
    sub.mkdir()
    (sub / "x.pdf").write_bytes(b"%PDF-1.7 ...")
    (sub / "y.PNG").write_bytes(b"\x89PNG\r\n\x1a\n0")
    (tmp_path / "z.pdf").write_bytes(b"MZ")
    (tmp_path / "t.tif").write_bytes(b"II*\x00")
    got = {r.path.rsplit("/", 1)[1]: r.accepted for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"x.pdf": True, "y.PNG": True, "z.pdf": False, "t.tif": True}


def test_annotations(spark, tmp_path):
    p = tmp_path / "labels.txt"
    p.write_text("a.png\tMột\n# note\n\nb.png\t\nc.png\thai\tba\nd.png\n")
    out = files.annotations(spark, str(p))
    assert [(r.image, r.label) for r in out.where("not skipped").collect()] == [("a.png", "Một"), ("c.png", "hai\tba")]
    assert out.where("skipped").count() == 4


def test_export_has_mark_and_quotes(spark, tmp_path):
    files.export_csv(spark.createDataFrame([("Đỗ, \"An\"", 1)], "name string, n int"), str(tmp_path / "o"))
    raw = next((tmp_path / "o").glob("*.csv")).read_bytes()
    assert raw.startswith(b'"\xef\xbb\xbfname"') or raw.startswith(b'\xef\xbb\xbf"name"') or "﻿name" in raw.decode()


def test_merge(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 5), (2, "d", 4), (3, "e", 1)], "k int, v string, t int")
    assert {(r.k, r.v) for r in files.merged(base, new, "k", "t").collect()} == {(1, "a"), (2, "c"), (3, "e")}


def test_stream_upsert_is_the_same_in_batches(spark, tmp_path):
    for k, part in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2)], [(3, "d", 3), (1, "z", 0)]]):
        spark.createDataFrame(part, "k int, v string, t int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k int, v string, t int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.upsert_stream(s, str(tmp_path / "out"), "k", "t")
    last = max((tmp_path / "out").glob("v*"), key=lambda p: int(p.name[1:]))
    assert {(r.k, r.v) for r in spark.read.parquet(str(last)).collect()} == {(1, "a"), (2, "c"), (3, "d")}
