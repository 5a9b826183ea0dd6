"""The duplicate check over whole texts against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from scrivan.operators import duplicates


def similarity(a: str, b: str) -> float:
    wa, wb = (set(re.findall(r"\w+", x.lower())) for x in (a, b))
    if not wa or not wb:
        return 0.0
    words = len(wa & wb) / len(wa | wb)
    pa, pb = (set(itertools.pairwise(x.lower().split())) for x in (a, b))
    return round(0.4 * words + 0.6 * len(pa & pb) / len(pa | pb), 4) if pa and pb else round(words, 4)


def fixture():
    rng = random.Random(7)
    words = [f"từ{k}" for k in range(60)]
    base = [rng.choice(words) for _ in range(40)]
    rows = [("moved", "Thông báo số 1 " + " ".join(base)), ("start", "Kế hoạch khác hẳn " + " ".join(base)), ("same1", " ".join(base)), ("same2", " ".join(base))]
    rows += [(f"r{k:02}", " ".join(rng.choice(words) for _ in range(rng.randrange(5, 50)))) for k in range(40)]
    rows += [("cut", " ".join(base[:5] + base[6:])), ("one", "Từ1"), ("one2", "từ1,"), ("none", "..."), ("none2", "..."), ("empty", ""), ("null", None)]
    return rows


@pytest.mark.parametrize("block, dense", [(1000, 8000), (7, 20)])
def test_all_pairs(spark, monkeypatch, block, dense):
    monkeypatch.setattr(duplicates, "BLOCK", block)
    monkeypatch.setattr(duplicates, "DENSE", dense)
    monkeypatch.setattr(duplicates, "WIDTH", 16)
    monkeypatch.setattr(duplicates, "STEP", 50)
    rows = fixture()
    got = {(r.a, r.b): (r.score, r.level) for r in duplicates.scores(spark.createDataFrame(rows, "id string, text string")).collect()}
    texts = sorted((k, t) for k, t in rows if t is not None)
    want = {(a, b): s for (a, x), (b, y) in itertools.combinations(texts, 2) if (s := similarity(x, y)) >= 0.3}
    assert {k: s for k, (s, _) in got.items()} == pytest.approx(want, abs=1.01e-4)
    assert all(level == ("CRITICAL" if s >= 0.85 else "WARNING" if s >= 0.65 else "LOW") for s, level in got.values())
    # no common beginning
    assert ("moved", "start") in got and got["same1", "same2"] == (1.0, "CRITICAL") and ("cut", "same1") in got
    assert duplicates.scores(spark.createDataFrame([], "id string, text string")).count() == 0


@pytest.mark.parametrize("own, shared", [(1024, 2048), (10, 32), (0, 1)])
@pytest.mark.parametrize("floats", [False, True])
def test_bounds_lose_no_pair_and_spare_most(monkeypatch, own, shared, floats):
    for name, value in (("ROWS", 5), ("COLUMNS", 7), ("DENSE", own), ("WIDTH", shared), ("STEP", 50)):
        monkeypatch.setattr(duplicates, name, value)
    if floats:
        monkeypatch.setattr(duplicates, "_multiplier", lambda: lambda x, y: x.astype(np.float32) @ y.astype(np.float32))
    texts = [t for t in dict.fromkeys(t for _, t in fixture()) if t and re.search(r"\w", t)]
    sets = [duplicates.sets_of(t, {}) for t in texts]
    columns = duplicates.frequent(texts)

    def block(low, high):
        of = lambda k: np.unique(np.concatenate([x[k] for x in sets[low:high]]), return_inverse=True)
        return duplicates.Block(np.arange(low, high), [(np.array([len(x[k]) for x in sets[low:high]]), *of(k)) for k in (0, 1)], columns)

    looked = []
    bounded = duplicates.bounded
    monkeypatch.setattr(duplicates, "bounded", lambda *args: looked.append(bounded(*args)) or looked[-1])
    got, blocks = {}, [block(0, 20), block(20, len(texts))]
    for a, b in itertools.combinations_with_replacement(blocks, 2):
        got |= {tuple(sorted((int(a.keys[i]), int(b.keys[j])))): s for i, j, s in zip(*duplicates.block_scores(a, b, 0.3))}
    want = {(x, y): s for x, y in itertools.combinations(range(len(texts)), 2) if (s := similarity(texts[x], texts[y])) >= 0.3}
    assert got == pytest.approx(want, abs=1.01e-4)
    if own > 1000:
        # with a column for each element no pair but these is looked up: both orders within a block, and each text with itself
        assert sum(len(i) for i, *_ in looked) <= 2 * len(want) + len(texts)
