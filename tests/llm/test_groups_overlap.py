"""Grouping and cross-split overlap against brute force, and their defined cases."""

from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrivan.llm import groups, overlap
from scrivan.llm.words import located, words


def union(edges):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[top(a)] = top(b)
    return {frozenset(y for y in root if top(y) == top(x)) for x in root}


def test_contraction_equals_union_find(spark):
    edges = [(f"c{k}", f"c{k + 1}") for k in range(40)] + [("hub", f"h{k}") for k in range(30)] + [("a", "b"), ("b", "a"), ("x", "x"), (None, "a")]
    got = {}
    for r in groups.contract(spark.createDataFrame(edges, "u string, v string")).collect():
        got.setdefault(r.label, set()).add(r.vertex)
    want = union((a, b) for a, b in edges if a and b and a != b)
    assert {frozenset(x) for x in got.values()} == want


def test_ids_and_files(spark):
    rows = [
        ("SYNTH0000103", r"E:\Anh quet\dot 2\HSL_1_2020_so_goc_p05_line_038.jpg"),
        ("synth_103", "crops/other_p01_line_000.png"),
        ("Synth 0000104", "/mnt/x/HSL-1-2020-SO-GOC_p01-line-002(1).tif"),
        ("SYNTH200", "plain.png"),
        ("SYNTH201", None),
        (None, "crops/other_p02_line_001_copy1.png"),
        ("", None),
        ("  ", ""),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id string, image_path string, member string")
    got = {(r.doc_id, r.group_id) for r in groups.found(df).collect()}
    assert got == {(x, "SYNTH0000103") for x in ("SYNTH0000103", "synth_103", "Synth 0000104")}
    assert groups.found(df.limit(0)).count() == 0


def test_split_shares_and_unity(spark):
    rows = [(f"d{k:04d}", f"f{k // 3}_p01_line_{k:03d}.png") for k in range(600) for _ in range(1 + (k == 7) * 100)]
    out = groups.grouped_split(spark.createDataFrame(rows, "doc_id string, image_path string")).collect()
    by_file, share = {}, {}
    for r in out:
        by_file.setdefault(r.file, set()).add(r.split)
        share[r.split] = share.get(r.split, 0) + r.n_rows
    assert all(len(x) == 1 for x in by_file.values())
    assert sum(share.values()) == len(rows)
    assert abs(share["train"] / len(rows) - 0.8) < 0.01 and abs(share["test"] / len(rows) - 0.1) < 0.01


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=10), st.lists(st.sampled_from("abc"), max_size=10))
def test_banded_distance(a, b):
    assert overlap.near(a, b, 2) == (distance(a, b) <= 2)


def test_overlap_equals_brute_force(spark):
    import random

    rng, rows = random.Random(3), []
    vocab = ["Số", "thứ", "tự", "lưu", "văn", "thư", "hồ", "sơ", "Kính", "gửi"]
    for k in range(300):
        ws = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 8, 9, 14]))]
        split = rng.choice(["train", "train", "validation", "test", None])
        rows.append((k, " ".join(ws), split, rng.choice(["s", None])))
        for _ in range(rng.randrange(3)):
            other = list(ws)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(other) + 1)
                rng.choice([lambda: other.insert(at, "thừa"), lambda: other.pop(at % len(other)) if len(other) > 1 else None, lambda: other.__setitem__(at % len(other), "KHÁC")])()
            rows.append((len(rows) + 1000, ", ".join(other).upper(), rng.choice(["train", "test"]), "s"))
    rows += [(1, "", "test", "s"), (2, None, "test", "s"), (3, "...", "test", "s"), (4, "!!", "train", "s"), rows[5]]
    df = spark.createDataFrame(rows, "row_id bigint, text string, split string, source string")
    train = [words(t) for _, t, s, _ in rows if s == "train" and t]
    want = set()
    for key, text, split, _ in rows:
        if split in ("validation", "test") and text and (ws := words(text)):
            if any(ws == o or (len(ws) >= 8 and len(o) >= 8 and abs(len(ws) - len(o)) <= 2 and distance(ws, o) <= 2) for o in train):
                want.add(key)
    assert {r.row_id for r in overlap.found(df).collect()} == want
    report = overlap.report(df).collect()
    assert sum(r.n_overlap for r in report) == len(want)
    assert overlap.found(df.limit(0)).count() == 0


def test_words():
    assert words("Đơn số 669/ĐN-ĐHSL, é_è ﬁ") == ["don", "so", "669", "dn", "dhsl", "e", "e", "fi"]
    text = "Lưu: văn-thư ĐẠI"
    assert [text[a:b] for _, a, b in located(text)] == ["Lưu", "văn", "thư", "ĐẠI"]
    assert [w for w, _, _ in located(text)] == words(text)
    assert words("") == [] and list(combinations(words("..."), 2)) == []


@pytest.mark.parametrize("n", [0, 1, 5])
def test_contract_small(spark, n):
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(n)], "u string, v string")
    assert groups.contract(edges).select("label").distinct().count() == (n > 0)


def test_lines_that_share_a_run_only_are_not_compared_word_by_word(monkeypatch):
    import pandas as pd

    calls, near = [], overlap.near
    monkeypatch.setattr(overlap, "near", lambda *x: calls.append(x) or near(*x))
    norms = ["a b c " + " ".join(f"{y}{k}" for k in range(7)) for y in "xyz"]
    evals = pd.DataFrame({"norm": norms, "start": 0, "stop": 3})
    lines = pd.DataFrame({"line": ["a b c " + " ".join(f"{y}{k}" for k in range(7)) for y in "uvw"] + ["new a b c y0 y1 y2 y3 y4 y5 other"]})
    assert overlap._scan(2, 8)(evals, lines).values.tolist() == [[norms[1], 0, 3]] and len(calls) == 1
