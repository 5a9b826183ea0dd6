"""Leak search and packing against brute force, and their defined cases."""

import random

from scrivan.llm import leaks, packing
from scrivan.llm.words import words


def corpus():
    rng = random.Random(5)
    vocab = [f"từ{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 9, 10, 25])))) for k in range(20)]
    items += [(100, items[3][1]), (101, None), (102, "")]
    docs = []
    for k in range(120):
        ws = [rng.choice(vocab + ["khác"]) for _ in range(30)]
        other = words(items[k % 20][1])
        a = rng.randrange(len(other))
        ws[5:5] = other[a : a + rng.choice([9, 10, 11, 30])]
        docs.append((k, ",\n".join(ws).upper(), "x"))
    return docs + [(500, None, "x"), (501, "", "x"), docs[3]], items


def test_leaks_equal_brute_force(spark):
    docs, items = corpus()
    want = set()
    grams = {k: {tuple(w[i : i + 10]) for i in range(len(w) - 9)} for k, t in items if t for w in [words(t)]}
    for d, t, _ in docs:
        w = words(t or "")
        mine = {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
        want |= {(d, k) for k, g in grams.items() if g & mine}
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in leaks.found(df, it).collect()} == want and want
    assert leaks.found(df.limit(0), it).count() == 0 and leaks.found(df, it.limit(0)).count() == 0
    out = {r.doc_id: r for r in leaks.cleaned(df, it, most_share=0.9).collect()}
    hit = {d for d, _ in want}
    assert {d for d, r in out.items() if r.removed_words} == hit
    for d, r in out.items():
        if not r.dropped and d in hit:
            w = words(r.text)
            assert len(w) == len(words(next(t for k, t, _ in docs if k == d))) - r.removed_words


def test_groups_of_items_give_the_same(spark, monkeypatch):
    docs, items = corpus()
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {tuple(r) for r in leaks.found(df, it).collect()}
    clean = {(r.doc_id, r.text, r.removed_words) for r in leaks.cleaned(df, it).collect()}
    monkeypatch.setattr(leaks, "MOST_WORDS", 3)
    assert {(r.doc_id, r.text, r.removed_words) for r in leaks.cleaned(df, it).collect()} == clean
    assert {tuple(r) for r in leaks.found(df, it).collect()} == want


def test_packing(spark):
    rng = random.Random(1)
    sizes = [(k, rng.choice([1, 3, 40, 300, 900, 1500, 2048, 5000])) for k in range(800)] + [(9000, 0)]
    out = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), block=100).collect()
    pieces, bins = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r.n_tokens)
        bins.setdefault(r.container, []).append(r.n_tokens)
    assert {k: sum(v) for k, v in pieces.items()} == {k: n for k, n in sizes if n}
    assert all(len(v) == -(-dict(sizes)[k] // 2048) for k, v in pieces.items())
    assert all(sum(v) <= 2048 and len(v) <= packing.MOST_DOCUMENTS and (len(v) == 1 or sum(x * x for x in v) <= 0.9 * 2048**2) for v in bins.values())
    least = -(-sum(n for _, n in sizes) // 2048)
    assert len(bins) <= 1.1 * least + 2


def test_best_fit_is_the_best_and_every_capacity_refuses():
    rng = random.Random(3)
    sizes = sorted((rng.choice([3, 5, 8, 40, 300, 950, 1500, 1990]) + rng.randrange(3) for _ in range(700)), reverse=True)
    capacity, most, cost = 2048, 16, int(0.9 * 2048**2)
    refused = {"tokens": 0, "documents": 0, "cost": 0}
    got = packing.best_fit(sizes, capacity, most, cost, refused=refused)
    assert all(refused.values())
    wt, wd, wc = packing.WEIGHTS[0] / capacity**2, packing.WEIGHTS[1] / most**2, packing.WEIGHTS[2] / cost**2
    bins: list[list[int]] = []
    for size, mine in zip(sizes, got):
        norm = []
        for k, b in enumerate(bins):
            r, d, c = capacity - sum(b) - size, most - len(b) - 1, cost - sum(x * x for x in b) - size * size
            if min(r, d, c) >= 0:
                norm.append((wt * r * r + wd * d * d + wc * float(c) ** 2, k))
        if norm:
            assert abs(min(norm)[0] - next(v for v, k in norm if k == mine)) < 1e-12
        else:
            assert mine == len(bins)
            bins.append([])
        bins[mine].append(size)
    dotted = packing.best_fit(sizes, capacity, most, cost, choose="dot")
    assert len(set(dotted)) >= -(-sum(sizes) // capacity) and packing.best_fit([], 10, 2, 90) == []


def test_parts_have_the_tokens_of_the_whole():
    enc = packing.encoder("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    text = "".join(f"Dòng {k}:\n\n  thụt vào\r\n\tvà\nhết " for k in range(300))
    assert "".join(packing._parts(text, 50)) == text and len(list(packing._parts(text, 50))) > 50
    assert sum(len(enc.encode_ordinary(p)) for p in packing._parts(text, 50)) == len(enc.encode_ordinary(text))


def test_token_counts(spark):
    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    long = "Trường Đại học Sương Lâm\n" * 30_000
    rows = [(1, "xin chào"), (2, ""), (3, None), (4, long), (1, "xin chào")]
    got = dict(packing.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), path).collect())
    enc = packing.encoder(path)
    assert set(got) == {1, 4} and got[1] == len(enc.encode_ordinary("xin chào"))
    assert got[4] == 30_000 * len(enc.encode_ordinary("Trường Đại học Sương Lâm\n"))
    assert packing.containers(spark.createDataFrame([], "doc_id bigint, text string"), path).count() == 0
