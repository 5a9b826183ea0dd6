"""Every query of the core by name, with the SQL that gives the same rows."""

from __future__ import annotations

from scrivan.operators import access, analytics, duplicates, extraction, geometry, relational, repair, scoring, search, textops, tooling
from scrivan.plans.pipes import compiled
from scrivan.sources import files
from scrivan.sources.tables import load
from scrivan.streaming import streams


def _piped(text: str):
    return lambda spark, d: compiled(text, lambda name: load(spark, d, name))


_PIPES = {
    "pipe_stats_by": (
        _piped("FROM orders | WHERE o_totalprice > 1000 AND o_orderstatus IN ('F', 'O') | STATS n = COUNT(*), total = ROUND(SUM(o_totalprice), 2), people = COUNT_DISTINCT(o_custkey) BY o_orderpriority | SORT n DESC"),
        "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS people FROM orders WHERE o_totalprice > 1000 AND o_orderstatus IN ('F', 'O') GROUP BY 1",
    ),
    "pipe_where_sort_limit": (
        _piped("from customer | where c_mktsegment RLIKE '^(BUILD|HOUSE).*' and not c_acctbal < 500 | eval twice = c_acctbal * 2 + 1 | sort c_acctbal desc, c_custkey | keep c_custkey, twice | limit 25"),
        "SELECT c_custkey, c_acctbal * 2 + 1 AS twice FROM customer WHERE regexp_matches(c_mktsegment, '^(BUILD|HOUSE).*') AND NOT c_acctbal < 500 ORDER BY c_acctbal DESC, c_custkey LIMIT 25",
    ),
    "pipe_null_tests": (
        _piped("FROM document_records | WHERE page_count IS NOT NULL AND (is_public == TRUE OR ocr_status LIKE 'AP*') | EVAL y = YEAR(created_at) | STATS n = COUNT(*), p = MEDIAN(page_count) BY y, ocr_status | RENAME ocr_status AS state"),
        "SELECT year(created_at)::INT AS y, ocr_status AS state, count(*) AS n, median(page_count) AS p FROM document_records WHERE page_count IS NOT NULL AND (is_public OR ocr_status LIKE 'AP%') GROUP BY 1, 2",
    ),
}
_ALL = {**search.CATALOG, **duplicates.CATALOG, **relational.CATALOG, **analytics.CATALOG, **textops.CATALOG, **scoring.CATALOG, **repair.CATALOG, **extraction.CATALOG, **geometry.CATALOG, **access.CATALOG, **tooling.CATALOG, **_PIPES, **files.CATALOG, **streams.CATALOG}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
