"""Boxes, lines and alignments: rows of a page, intervals, and sequences set against one another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivan.functions.text import fold
from scrivan.operators.index import SQL as IDX
from scrivan.operators.index import doc_index, sql_fold
from scrivan.sources.tables import load

N = F.count


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(page, box, x, y, w, h): boxes whose sizes and places come from the line items of an order."""
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("box"), (F.col("l_partkey") % 600).cast("double").alias("x"), (F.col("l_suppkey") % 40 * 11).cast("double").alias("y"), (20 + F.col("l_quantity") * 4).alias("w"), (10 + F.col("l_partkey") % 9).cast("double").alias("h"))


_BOXES = "b AS (SELECT l_orderkey AS page, l_linenumber AS box, (l_partkey % 600)::DOUBLE AS x, (l_suppkey % 40 * 11)::DOUBLE AS y, 20 + l_quantity * 4 AS w, (10 + l_partkey % 9)::DOUBLE AS h FROM lineitem)"


def text_rows(spark: SparkSession, d: str) -> DataFrame:
    """(page, line, n, left, right): boxes of a page in rows: a gap of over 15 between centres, from top to bottom, begins a new one."""
    w = Window.partitionBy("page").orderBy("c", "box")
    b = boxes(spark, d).withColumn("c", F.col("y") + F.col("h") / 2)
    b = b.withColumn("new", F.when(F.col("c") - F.lag("c").over(w) <= 15, 0).otherwise(1)).withColumn("line", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("page", "line").agg(N(F.lit(1)).alias("n"), F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"))


ROWS_SQL = f"WITH {_BOXES}, c AS (SELECT *, y + h / 2 AS c FROM b), n AS (SELECT *, CASE WHEN c - lag(c) OVER o <= 15 THEN 0 ELSE 1 END AS new FROM c WINDOW o AS (PARTITION BY page ORDER BY c, box)), l AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY c, box)::BIGINT AS line FROM n) SELECT page, line, count(*) AS n, min(x) AS \"left\", max(x + w) AS \"right\" FROM l GROUP BY 1, 2"


def nearest_boxes(spark: SparkSession, d: str) -> DataFrame:
    """(page, box, other, gap): of the boxes of a page that a box overlaps across and that begin within 0.7 of the greater height, the nearest."""
    a = boxes(spark, d)
    b = a.toDF("page", "other", "x2", "y2", "w2", "h2")
    gap = F.abs(F.col("y") + F.col("h") / 2 - F.col("y2") - F.col("h2") / 2)
    met = a.join(b, "page").where((F.col("box") != F.col("other")) & (F.col("x") < F.col("x2") + F.col("w2")) & (F.col("x2") < F.col("x") + F.col("w"))).withColumn("gap", gap).where(F.col("gap") <= 0.7 * F.greatest("h", "h2"))
    w = Window.partitionBy("page", "box").orderBy("gap", "other")
    return met.withColumn("k", F.row_number().over(w)).where("k = 1").select("page", "box", "other", "gap")


NEAREST_SQL = f"WITH {_BOXES}, m AS (SELECT a.page, a.box, o.box AS other, abs(a.y + a.h / 2 - o.y - o.h / 2) AS gap, greatest(a.h, o.h) AS hh FROM b a JOIN b o ON a.page = o.page AND a.box <> o.box AND a.x < o.x + o.w AND o.x < a.x + a.w) SELECT page, box, other, gap FROM (SELECT *, row_number() OVER (PARTITION BY page, box ORDER BY gap, other) AS k FROM m WHERE gap <= 0.7 * hh) WHERE k = 1"


def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    """(page, start, stop, n): the spans of a page's boxes across, overlapping ones merged: a span begins where none before reaches."""
    w = Window.partitionBy("page").orderBy("x", F.desc("e"), "box")
    s = boxes(spark, d).withColumn("e", F.col("x") + F.col("w"))
    s = s.withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("g", F.sum(F.when(F.col("x") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("page", "g").agg(F.min("x").alias("start"), F.max("e").alias("stop"), N(F.lit(1)).alias("n")).drop("g")


SPANS_SQL = f"WITH {_BOXES}, e AS (SELECT *, x + w AS e FROM b), r AS (SELECT *, max(e) OVER (PARTITION BY page ORDER BY x, e DESC, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e), g AS (SELECT *, sum(CASE WHEN x <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY x, e DESC, box) AS g FROM r) SELECT page, min(x) AS start, max(e) AS stop, count(*) AS n FROM g GROUP BY page, g"


def kept_spans(spark: SparkSession, d: str) -> DataFrame:
    """(page, kept): spans taken from left to right, each that begins where the last one taken has ended; a fold over the page's spans."""
    s = boxes(spark, d).groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("x").alias("s"), (F.col("x") + F.col("w")).alias("e"), "box"))).alias("spans"))
    step = lambda a, v: F.when(v["s"] >= a["end"], F.struct(v["e"].alias("end"), F.concat(a["kept"], F.array(v["box"])).alias("kept"))).otherwise(a)
    start = F.struct(F.lit(-1.0).alias("end"), F.array().cast("array<int>").alias("kept"))
    return s.select("page", F.array_join(F.aggregate("spans", start, step, lambda a: a["kept"]), ",").alias("kept"))


KEPT_SQL = f"""WITH RECURSIVE {_BOXES}, o AS (SELECT page, box, x, x + w AS e, row_number() OVER (PARTITION BY page ORDER BY x, x + w, box) AS k FROM b),
r AS (SELECT page, k, e AS stop, box::VARCHAR AS kept FROM o WHERE k = 1 UNION ALL SELECT o.page, o.k, CASE WHEN o.x >= r.stop THEN o.e ELSE r.stop END, CASE WHEN o.x >= r.stop THEN r.kept || ',' || o.box::VARCHAR ELSE r.kept END FROM r JOIN o ON o.page = r.page AND o.k = r.k + 1)
SELECT page, kept FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY k DESC) AS z FROM r) WHERE z = 1"""


def profile_regions(spark: SparkSession, d: str) -> DataFrame:
    """(start, stop, height): runs of days with more than a level of orders, gaps of two days closed, runs of two days left out."""
    o = load(spark, d, "orders").groupBy(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("y")).agg(N(F.lit(1)).alias("n"))
    level = o.agg(F.avg("n").alias("m"))
    on = o.crossJoin(F.broadcast(level)).where("n > m").select("y")
    w = Window.orderBy("y")  # one row a day
    g = on.withColumn("g", F.sum(F.when(F.col("y") - F.lag("y").over(w) <= 3, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("g").agg(F.min("y").alias("start"), F.max("y").alias("stop")).withColumn("height", F.col("stop") - F.col("start") + 1).where("height > 2").drop("g")


PROFILE_SQL = "WITH o AS (SELECT date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS y, count(*) AS n FROM orders GROUP BY 1), l AS (SELECT y FROM o WHERE n > (SELECT avg(n) FROM o)), g AS (SELECT y, CASE WHEN y - lag(y) OVER (ORDER BY y) <= 3 THEN 0 ELSE 1 END AS new FROM l), s AS (SELECT y, sum(new) OVER (ORDER BY y) AS g FROM g) SELECT min(y)::INT AS start, max(y)::INT AS stop, (max(y) - min(y) + 1)::INT AS height FROM s GROUP BY g HAVING max(y) - min(y) + 1 > 2"


def adjacent_repeats(spark: SparkSession, d: str) -> DataFrame:
    """(id, repeats, words): words that are the same as the one before them."""
    w = F.filter(F.split(fold("body"), r"\s+"), lambda x: x != "")
    same = F.size(F.filter(F.zip_with(F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    return doc_index(spark, d).where("body is not null").select("id", w.alias("w")).where(F.size("w") > 0).select("id", same.alias("repeats"), F.size("w").alias("words"))


REPEATS_SQL = rf"WITH {IDX}, w AS (SELECT id, list_filter(regexp_split_to_array({sql_fold('body')}, '\s+'), lambda x: x <> '') AS w FROM idx WHERE body IS NOT NULL) SELECT id, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::INT AS repeats, len(w)::INT AS words FROM w WHERE len(w) > 0"


def window_functions(spark: SparkSession, d: str) -> DataFrame:
    """(c_custkey, quarter, next_key, first_key, last_key, pct): quarters by balance in each nation, neighbours and ends."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return load(spark, d, "customer").select("c_custkey", F.ntile(4).over(w).alias("quarter"), F.lead("c_custkey").over(w).alias("next_key"), F.first("c_custkey").over(whole).alias("first_key"), F.last("c_custkey").over(whole).alias("last_key"), F.round(F.percent_rank().over(w), 6).alias("pct"))


WINDOW_SQL = "SELECT c_custkey, ntile(4) OVER w AS quarter, lead(c_custkey) OVER w AS next_key, first_value(c_custkey) OVER w2 AS first_key, last_value(c_custkey) OVER w2 AS last_key, round(percent_rank() OVER w, 6) AS pct FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey), w2 AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _places(b: str) -> dict[str, int]:
    """Of each character, the places where it stands, as bits."""
    out: dict[str, int] = {}
    for j, c in enumerate(b):
        out[c] = out.get(c, 0) | 1 << j
    return out


def ratio(a: str, b: str, places: dict[str, int] | None = None) -> float:
    """How alike two strings are, 0 to 100: twice the longest common subsequence (bit-parallel) over both lengths."""
    places = _places(b) if places is None else places
    full = (1 << len(b)) - 1
    left = full
    for c in a:
        if m := places.get(c):
            u = left & m
            left = ((left + u) | (left - u)) & full
    return 200.0 * (len(b) - left.bit_count()) / max(1, len(a) + len(b))


def ratios(left: list[str], right: list[str]) -> list[list[float]]:
    tables = [_places(b) for b in right]
    return [[ratio(a, b, t) for b, t in zip(right, tables)] for a in left]


def greedy_pairs(left: list[str], right: list[str], least: float = 60.0) -> list[tuple[int, int, float]]:
    """One-to-one pairs, the most alike first, of what is more alike than ``least``; ties by place."""
    scored = sorted((-r, i, j) for i, row in enumerate(ratios(left, right)) for j, r in enumerate(row) if r > least)
    used_l, used_r, out = set(), set(), []
    for s, i, j in scored:
        if i not in used_l and j not in used_r:
            used_l.add(i)
            used_r.add(j)
            out.append((i, j, -s))
    return sorted(out)


def aligned(truth: list[str], guess: list[str], gap: float = 0.8) -> list[tuple[int, int, float]]:
    """Lines set against one another in order at the least cost: a pair costs its share of edits, a line alone ``gap``; pairs under 0.6 match."""
    n, m = len(truth), len(guess)
    cost = [[1 - r / 100 for r in row] for row in ratios(truth, guess)]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        best[i][0] = i * gap
    for j in range(1, m + 1):
        best[0][j] = j * gap
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = min(best[i - 1][j - 1] + cost[i - 1][j - 1], best[i - 1][j] + gap, best[i][j - 1] + gap)
    out, i, j = [], n, m
    while i and j:
        if abs(best[i][j] - best[i - 1][j - 1] - cost[i - 1][j - 1]) < 1e-9:
            if cost[i - 1][j - 1] < 0.6:
                out.append((i - 1, j - 1, cost[i - 1][j - 1]))
            i, j = i - 1, j - 1
        elif abs(best[i][j] - best[i - 1][j] - gap) < 1e-9:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    lines = lambda c: F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    r = load(spark, d, "ocr_results").dropDuplicates(["id"]).where("length(raw_text) > 0 and length(corrected_text) > 0")
    return r.select("id", lines("corrected_text").alias("truth"), lines("raw_text").alias("guess"))


def line_alignment(spark: SparkSession, d: str) -> DataFrame:
    """(id, truth_line, guess_line, cost): the lines of a corrected text against those of the raw one; a text is a row, so no group is gathered."""

    def run(frames):
        for f in frames:
            rows = [(k, i, j, round(c, 6)) for k, a, b in zip(f.id, f.truth, f.guess) for i, j, c in aligned(list(a), list(b))]
            yield pd.DataFrame(rows, columns=["id", "truth_line", "guess_line", "cost"])

    return _lines(spark, d).mapInPandas(run, "id string, truth_line int, guess_line int, cost double")


def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(id, truth_line, guess_line, score): the same lines paired one to one by likeness alone."""

    def run(frames):
        for f in frames:
            rows = [(k, i, j, round(s, 6)) for k, a, b in zip(f.id, f.truth, f.guess) for i, j, s in greedy_pairs(list(a), list(b))]
            yield pd.DataFrame(rows, columns=["id", "truth_line", "guess_line", "score"])

    return _lines(spark, d).mapInPandas(run, "id string, truth_line int, guess_line int, score double")


CATALOG = {
    "text_rows": (text_rows, ROWS_SQL), "nearest_boxes": (nearest_boxes, NEAREST_SQL), "merged_spans": (merged_spans, SPANS_SQL), "kept_spans": (kept_spans, KEPT_SQL), "profile_regions": (profile_regions, PROFILE_SQL),
    "adjacent_repeats": (adjacent_repeats, REPEATS_SQL), "window_functions": (window_functions, WINDOW_SQL), "line_alignment": (line_alignment, None), "label_pairs": (label_pairs, None),
}
