"""Near-duplicate records: BK-trees over Hamming signatures, in shards.

A text is a set of hashed tokens (words or word shingles). Its signature has one bit for each hash value modulo its
width, toggled by every token there, so two signatures differ in at most as many bits as the sets differ in elements.
Sets of Jaccard similarity ``t`` and sizes n, m differ in at most (1-t)/(1+t) (n+m) elements: that is the radius, and a
BK-tree search within it loses no pair. The pairs it yields are confirmed on the whole sets.

Distances of unrelated texts crowd around one value, so a tree over everything would visit nearly all nodes. Trees are
therefore per shard: a shard holds the sets with one band of MinHashes in common, and the number of bands follows from
the collision curve for the wanted recall right at the threshold. The shard's task builds its tree and follows the edges
within the radius; shipping every tree to every executor, as the words "broadcast shard trees" suggest, would send all
fingerprints everywhere, so a tree stays where its shard is. Shards above ``SHARD`` sets are cut by set size into cells
of which only neighbours can hold similar sets, and cells above that into trees of that size, which all sets of the cell
and of the next one query; no task holds more than one tree.

Equal sets form a class before anything else; a class is searched once, so groups of copies cost one search.

Cases: null texts, and texts without a token, belong to nobody; a repeated (id, text) counts once; one id with several
texts counts for each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivan.llm.groups import contract
from scrivan.runtime import stage

#: Sets in one tree; how often two sets right at the similarity share a shard (more alike ones do so more often).
SHARD, RECALL = 4000, 0.999


_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens_of(text: str, shingle: int, memo: dict[str, int]) -> np.ndarray:
    """The distinct hashed words, or runs of ``shingle`` words, of a text, in rising order."""
    words = text.lower().split()
    if len(words) < shingle:
        return np.empty(0, np.uint64)
    for w in words:
        if w not in memo:
            if len(memo) > 1_000_000:
                memo.clear()
            memo[w] = xxhash.xxh64_intdigest(w)
    try:
        x = np.array([memo[w] for w in words], dtype=np.uint64)
    except KeyError:  # the memo was emptied half-way
        x = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
    if shingle > 1:
        n = len(x) - shingle + 1
        out = np.zeros(n, np.uint64)
        for k in range(shingle):
            out = (out ^ (out >> np.uint64(31))) * _ONE + x[k : k + n]
        x = (out ^ (out >> np.uint64(29))) * _TWO
    return np.unique(x)


def class_of(toks: np.ndarray) -> int:
    """The class of equal sets: a hash of the set."""
    return xxhash.xxh64_intdigest(toks.tobytes()) - 2**63


def signature(toks: np.ndarray, width: int) -> bytes:
    """One bit for each hash modulo ``width``, toggled by every token there."""
    odd = np.bincount((toks % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class BKTree:
    """Nodes keyed by integer Hamming distance to their parent."""

    def __init__(self) -> None:
        self.sigs: list[int] = []
        self.sizes: list[int] = []
        self.ids: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, sig: int, size: int, key: int) -> None:
        new = len(self.sigs)
        self.sigs.append(sig)
        self.sizes.append(size)
        self.ids.append(key)
        self.kids.append({})
        node = 0
        while node != new:
            node = self.kids[node].setdefault((self.sigs[node] ^ sig).bit_count(), new)

    def within(self, sig: int, size: int, share: float) -> Iterator[int]:
        """Keys of the sets that may have similarity ``share`` with this one, by size and distance."""
        widest = size * (1 - share) / share + 1e-9
        slope = (1 - share) / (1 + share)
        low, high = size * share - 1e-9, size / share + 1e-9
        todo = [0] if self.sigs else []
        while todo:
            node = todo.pop()
            d = (self.sigs[node] ^ sig).bit_count()
            if low <= self.sizes[node] <= high and d <= slope * (size + self.sizes[node]) + 1e-9:
                yield self.ids[node]
            kids = self.kids[node]
            if kids:
                first, last = d - widest, d + widest
                todo.extend(kid for edge, kid in kids.items() if first <= edge <= last)


def bands_needed(share: float, rows: int, recall: float) -> int:
    """The least b with 1 - (1 - share^rows)^b >= recall: two sets of that similarity meet in a band as often."""
    return math.ceil(math.log(1 - recall) / math.log(1 - share**rows))


def sketches(rows: DataFrame, id_col: str, text_col: str, shingle: int, width: int, bands: int, band_rows: int) -> DataFrame:
    """(id, sid, n, sig, keys): class, size, signature and band keys (minima of multiply-add hashes) of every text's set."""
    rng = np.random.default_rng(20_240_601)
    factor = rng.integers(1, 2**63, bands * band_rows, dtype=np.uint64) | np.uint64(1)
    term = rng.integers(0, 2**63, bands * band_rows, dtype=np.uint64)
    weight = rng.integers(1, 2**63, band_rows, dtype=np.uint64) | np.uint64(1)

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for frame in frames:
            out = []
            for key, text in zip(frame.id, frame.text):
                x = tokens_of(text, shingle, memo)
                if not len(x):
                    continue
                low = np.full(bands * band_rows, 2**64 - 1, dtype=np.uint64)
                for part in range(0, len(x), 4096):  # whole sets, a bounded table at a time
                    mixed = x[part : part + 4096, None] * factor + term
                    mixed >>= np.uint64(20)
                    np.minimum(low, mixed.min(axis=0), out=low)
                band = (low.reshape(bands, band_rows) * weight).sum(axis=1, dtype=np.uint64) * _ONE + np.arange(bands, dtype=np.uint64)
                out.append((key, class_of(x), len(x), signature(x, width), (band ^ (band >> np.uint64(31))).view(np.int64)))
            yield pd.DataFrame(out, columns=["id", "sid", "n", "sig", "keys"])

    kind = rows.schema[id_col].dataType.simpleString()
    texts = rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(sketch, f"id {kind}, sid bigint, n int, sig binary, keys array<bigint>")


def class_pairs(rows: DataFrame, sets: DataFrame, id_col: str, text_col: str, shingle: int, share: tuple[int, int]) -> DataFrame:
    """(a, b): classes of staged ``sketches`` whose sets have ``share`` = (p, q), p/q, of their union in common; a < b."""
    p, q = share
    copies = sets.groupBy("sid").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("sid", "first")
    spare = stage(sets.select("row", "sid").join(copies, "sid").where("row <> first").select("row"))
    one = sets.join(spare, "row", "left_anti")
    keyed = one.select("sid", "n", F.explode("keys").alias("key")).repartition("key")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met_keys = stage(keyed.join(sizes.hint("shuffle_hash"), "key").select("key", "c", "n", "sid"))  # most keys are of one set
    cold = met_keys.where(F.col("c") <= SHARD).select("key", F.lit(0).alias("cell"), F.lit(0).alias("tree"), F.lit(False).alias("guest"), "sid")
    # a hot shard is cut by set size: sets of the wanted similarity lie in one cell or in neighbouring ones, and the larger visits the smaller
    own = F.floor(F.log(F.col("n").cast("double")) / math.log(q / p) + 1e-9).cast("int")
    hot = met_keys.where(F.col("c") > SHARD).select("key", own.alias("own"), "sid")
    trees = hot.groupBy("key", F.col("own").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("trees"))
    visits = hot.withColumn("cell", F.explode(F.array(F.col("own"), F.col("own") - 1))).join(trees, ["key", "cell"])
    visits = visits.withColumn("home", F.pmod(F.xxhash64("sid"), F.col("trees")).cast("int")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    placed = cold.unionByName(visits.select("key", "cell", "tree", ((F.col("cell") != F.col("own")) | (F.col("tree") != F.col("home"))).alias("guest"), "sid"))
    ready = placed.join(one.select("sid", "n", "sig"), "sid")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tree = None, BKTree()
        for frame in frames:
            out: set[tuple[int, int]] = set()
            for key, cell, shard, guest, sid, n, sig in zip(frame.key, frame.cell, frame.tree, frame.guest, frame.sid, frame.n, frame.sig):
                if (key, cell, shard) != at:
                    at, tree = (key, cell, shard), BKTree()
                number = int.from_bytes(sig, "little")
                for other in tree.within(number, n, p / q):
                    if other != sid:
                        out.add((min(sid, other), max(sid, other)))
                if not guest:
                    tree.add(number, n, sid)
            yield pd.DataFrame(list(out), columns=["a", "b"], dtype="int64")

    found = ready.repartition("key", "cell", "tree").sortWithinPartitions("key", "cell", "tree", "guest").mapInPandas(search, "a bigint, b bigint").distinct()
    met = stage(found)
    # the sets of the classes concerned, read again from one text of each
    ids = met.select(F.col("a").alias("sid")).unionByName(met.select(F.col("b").alias("sid"))).distinct().join(one.select("sid", "id"), "sid").select("id").distinct()

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for frame in frames:
            sets_ = [tokens_of(text, shingle, memo) for text in frame.text]
            sets_ = [x for x in sets_ if len(x)]
            yield pd.DataFrame({"sid": pd.Series([class_of(x) for x in sets_], dtype="int64"), "toks": [x.view(np.int64) for x in sets_]})

    texts = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi").select("text")
    toks = texts.mapInPandas(again, "sid bigint, toks array<bigint>").dropDuplicates(["sid"])
    left, right = toks.toDF("a", "ta"), toks.toDF("b", "tb")
    both = met.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("ta", "tb")))
    return both.where(F.col("i") * q >= (F.size("ta") + F.size("tb") - F.col("i")) * p).select("a", "b")


def linked(rows: DataFrame, id_col: str, text_col: str, shingle: int, share: tuple[int, int], width: int, band_rows: int) -> tuple[DataFrame, DataFrame]:
    """The members (id, sid) of each class, and the pairs (a, b) of similar classes; both staged."""
    bands = bands_needed(share[0] / share[1], band_rows, RECALL)
    sets = stage(sketches(rows, id_col, text_col, shingle, width, bands, band_rows).withColumn("row", F.monotonically_increasing_id()))
    return sets.select("id", "sid").distinct(), stage(class_pairs(rows, sets, id_col, text_col, shingle, share))


def document_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(document_id_a, document_id_b) of every two different records in one class or in two similar ones."""
    same = members.toDF("x", "sid").join(members.toDF("y", "sid"), "sid").where("x < y").select("x", "y")
    near = pairs.join(members.toDF("x", "a"), "a").join(members.toDF("y", "b"), "b").where("x <> y").select("x", "y")
    every = same.unionByName(near)
    return every.select(F.least("x", "y").alias("document_id_a"), F.greatest("x", "y").alias("document_id_b")).distinct()


def classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(document_id, class_id, group_id, n_links): classes of equal sets, groups of linked classes, links of each class."""
    links = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    labels = contract(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = members.join(links, F.col("sid") == F.col("a"), "left").join(labels, F.col("sid") == F.col("vertex"), "left")
    return named.select(F.col("id").alias("document_id"), F.col("sid").alias("class_id"), F.coalesce("label", "sid").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def titles(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    return linked(records, "id", "title", 1, (7, 10), 256, 6)


def pages(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    return linked(results.where("is_latest"), "document_id", "raw_text", 3, (1, 2), 512, 4)


def pages_strict(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The usual near-duplicate setting: shingles of five words, similarity 0.8."""
    return linked(results.where("is_latest"), "document_id", "raw_text", 5, (4, 5), 512, 8)


def _named(name: str) -> Column:
    return F.lit(name).alias("field_name")


def found(records: DataFrame, results: DataFrame) -> DataFrame:
    """(field_name, document_id_a, document_id_b) of similar titles and of similar pages."""
    a = document_pairs(*titles(records)).select(_named("title"), "*")
    return a.unionByName(document_pairs(*pages(results)).select(_named("raw_text"), "*"))


def groups(records: DataFrame, results: DataFrame) -> DataFrame:
    """(field_name, document_id, class_id, group_id, n_links) of all records, by title and by page."""
    a = classes(*titles(records)).select(_named("title"), "*")
    return a.unionByName(classes(*pages_strict(results)).select(_named("raw_text"), "*"))
