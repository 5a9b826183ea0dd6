"""Near-duplicate search against all pairs, and its defined cases."""

import random
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scrivan.llm import neardup


def brute(rows, shingle, p, q):
    out, sets = set(), []
    for key, text in rows:
        if key is None or text is None:
            continue
        w = text.lower().split()
        s = frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1))
        if s:
            sets.append((key, s))
    for (a, x), (b, y) in combinations(sets, 2):
        if a != b and q * len(x & y) >= p * len(x | y):
            out.add((min(a, b), max(a, b)))
    return out


def texts():
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):
        w = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 20, 60]))]
        rows.append((f"d{k:03d}", " ".join(w)))
        for j in range(rng.randrange(3)):
            v = list(w)
            for _ in range(rng.randrange(6)):
                v.insert(rng.randrange(len(v)), rng.choice(vocab))
            rows.append((f"d{k:03d}x{j}", "\u00a0 ".join(v).upper() + " \n"))
    return rows + [("n1", None), ("n2", ""), ("n3", "  "), (None, "w1 w2 w3"), rows[0], ("e1", "w1 w2 w3"), ("e2", "W1  w2\tw3"), ("long", "w1 w2 w3 " * 30_000)]


def pairs_of(out):
    return {(r.document_id_a, r.document_id_b) for r in neardup.document_pairs(*out).collect()}


def test_equal_to_all_pairs(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, t string, sid string")
    assert pairs_of(neardup.linked(df, "id", "t", 1, (7, 10), 256, 6)) == brute(rows, 1, 7, 10)
    want = brute(rows, 3, 1, 2)
    assert want and pairs_of(neardup.linked(df, "id", "t", 3, (1, 2), 512, 4)) == want
    monkeypatch.setattr(neardup, "SHARD", 5)  # hot shards in many trees
    assert pairs_of(neardup.linked(df, "id", "t", 3, (1, 2), 512, 4)) == want
    assert pairs_of(neardup.linked(df.limit(0), "id", "t", 3, (1, 2), 512, 4)) == set()


def test_classes(spark):
    rows = [(f"c{k}", "a b c d e f") for k in range(50)] + [("x", "a b c d e f g"), ("y", "other words here now")]
    got = {r.document_id: r for r in neardup.classes(*neardup.linked(spark.createDataFrame(rows, "id string, t string"), "id", "t", 1, (7, 10), 256, 6)).collect()}
    assert len(got) == 52 and got["c0"].class_id == got["c49"].class_id != got["x"].class_id
    assert got["c0"].group_id == got["x"].group_id != got["y"].group_id
    assert (got["c0"].n_links, got["y"].n_links) == (1, 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.frozensets(st.integers(-50, 50), min_size=1, max_size=20), min_size=1, max_size=30), st.sampled_from([0.5, 0.7, 0.8]))
def test_tree_loses_nothing(sets, share):
    def sign(x):
        return int.from_bytes(neardup.signature(np.array(sorted(x), dtype=np.int64).view(np.uint64), 64), "little")

    tree = neardup.BKTree()
    for k, s in enumerate(sets):
        tree.add(sign(s), len(s), k)
    for s in sets:
        got = set(tree.within(sign(s), len(s), share))
        assert {k for k, o in enumerate(sets) if len(s & o) >= share * len(s | o)} <= got
