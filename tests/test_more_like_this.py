"""Similar records by their texts."""

import math
import random
from collections import Counter

import pytest

from scrivan.operators import search


def test_bodies_count(spark, monkeypatch):
    rows = [("00000064-a", "Thông báo", "học bổng khuyến khích"), ("00000001-b", "Kế hoạch", "xét học bổng khuyến khích"), ("00000002-c", "Thông báo", "nghỉ lễ"), ("00000003-d", None, None)]
    docs = spark.createDataFrame(rows, "id string, title string, body string")
    monkeypatch.setattr(search, "doc_index", lambda spark, d: docs)
    best = lambda query: [r.id for r in query(spark, "").orderBy("rank").collect()]
    assert best(search.more_like_this_texts) == ["00000001-b", "00000002-c"]
    assert best(search.more_like_this) == ["00000002-c"]
    monkeypatch.setattr(search, "MOST_TERMS", 0)
    assert best(search.more_like_this_texts) == ["00000001-b", "00000002-c"]


def brute(rows, terms=12, k=5):
    texts = {i: Counter(t.split()) for i, t in rows}
    df = Counter(w for c in texts.values() for w in c)
    weight = lambda i, w: round(texts[i][w] * math.log(len(rows) / df[w]), 6)
    out = set()
    for src in (i for i, _ in rows if int(i[:8], 16) % 100 == 0):
        best = sorted((-weight(src, w), w) for w in texts[src] if len(w) > 1)[:terms]
        hits = [(-round(sum(-m * weight(i, w) for m, w in best if w in c), 4), i) for i, c in texts.items() if i != src and any(w in c for _, w in best)]
        out |= {(src, i, -score, rank) for rank, (score, i) in enumerate(sorted(hits)[:k], 1)}
    return out


@pytest.mark.parametrize("terms, cells", [(300_000, 4_000_000), (30, 50)])
def test_first_ones_equal_all_pairs_and_no_pair_is_shuffled(spark, monkeypatch, terms, cells):
    monkeypatch.setattr(search, "MOST_TERMS", terms)
    monkeypatch.setattr(search, "CELLS", cells)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    rows = [(f"{k * 25:08x}-{k % 7}", " ".join(["the", *(rng.choice(words) for _ in range(rng.randrange(1, 9)))] * (1 + k % 2))) for k in range(80)]
    rows += [(f"{k:08x}-x", "the w1 w2") for k in range(1, 12)] + [("00000190-e", "the")]
    got = search.alike(spark.createDataFrame(rows, "id string, text string").repartition(3), 12, 5)
    assert {tuple(r) for r in got.select("src", "id", "score", "rank").collect()} == brute(rows)
    assert search.alike(spark.createDataFrame([], "id string, text string"), 12, 5).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
