"""Duplicate check over whole texts: every pair of records by word and word-pair similarity.

The score mixes two Jaccard similarities (0.4 words, 0.6 word pairs), and 0.3 is low enough that two letters of one
office reach it without a rare word or a common prefix. Any blocking key loses such pairs, so none is used: equal texts
form a class, classes are packed into blocks, and for each pair of blocks a matrix product bounds the scores of all its
pairs from above. Frequent words and word pairs have columns of their own, the others share columns by their hash, so
that a product counts what two texts share, or more. Pairs whose bound reaches ``LEAST`` are scored by their sets. The
work grows with the square of the number of different texts.

Cases: null texts are in no pair; texts without a word score 0; a text of one word has no word pair and is scored by
words alone; copies are scored once and listed each.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivan.operators.index import doc_index
from scrivan.runtime import stage

#: Texts in a block, and blocks at least where there are texts enough; words, and word pairs, with columns of their own;
#: columns that the other word pairs share (other words a 32nd); elements that are looked up at once.
BLOCK, FEWEST, DENSE, WIDTH, STEP = 2000, 12, 1024, 2048, 2_000_000
LEAST = 0.3
#: Texts of two blocks whose scores are bounded at once; texts that tell which words are frequent (a choice of columns only);
#: blocks that a task keeps.
ROWS, COLUMNS, TOLD, HELD = 256, 512, 2000, 3

_PACKED = "block int, keys binary, wn binary, w binary, wi binary, bn binary, b binary, bi binary"
_ONE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")


def sets_of(text: str, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words of a text, and its hashed pairs of neighbours between blanks."""
    import xxhash

    def hashed(parts: list[str]) -> np.ndarray:
        out = np.empty(len(parts), np.uint64)
        for k, x in enumerate(parts):
            if (h := memo.get(x)) is None:
                if len(memo) > 100_000:
                    memo.clear()
                h = memo[x] = xxhash.xxh64_intdigest(x)
            out[k] = h
        return out

    text = text.lower()
    x = hashed(text.split())
    first = x[:-1] * _ONE
    return np.unique(hashed(_WORD.findall(text))), np.unique((first ^ (first >> np.uint64(29))) * _ONE + x[1:])


class Block:
    """Texts as sets of hashed words and word pairs, and as counts by column."""

    def __init__(self, keys: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray, np.ndarray]], columns: list[np.ndarray]) -> None:
        self.keys, self.sizes, self.ends, self.known, self.ids, self.columns = keys, [], [], [], [], []
        for (sizes, known, ids), own, shared in zip(sets, columns, (max(1, WIDTH // 32), WIDTH)):
            column = len(own) + (known % np.uint64(shared)).astype(np.int64)
            if len(own):
                at = np.minimum(np.searchsorted(own, known), len(own) - 1)
                column = np.where(own[at] == known, at, column)
            self.sizes.append(sizes)
            self.ends.append(np.cumsum(sizes))
            self.known.append(known)
            self.ids.append(ids)
            self.columns.append((column, len(own) + shared))

    def _counts(self, k: int, start: int, many: int) -> np.ndarray:
        sizes, (column, wide) = self.sizes[k][start : start + many], self.columns[k]
        first = int(self.ends[k][start] - self.sizes[k][start])
        cells = np.repeat(np.arange(len(sizes)) * wide, sizes) + column[self.ids[k][first : first + int(sizes.sum())]]
        # of two counts over 127 the product is still more than the lesser one
        return np.minimum(np.bincount(cells, minlength=len(sizes) * wide), 127).astype(np.uint8).reshape(len(sizes), wide)

    @functools.cached_property
    def down(self) -> list[list[np.ndarray]]:
        """Counts of words and of word pairs, a text a row, ``ROWS`` texts each."""
        return [[self._counts(k, start, ROWS) for start in range(0, len(self.keys), ROWS)] for k in (0, 1)]

    @functools.cached_property
    def across(self) -> list[list[np.ndarray]]:
        """The same, a text a column, ``COLUMNS`` texts each."""
        return [[np.ascontiguousarray(self._counts(k, start, COLUMNS).T).view(np.int8) for start in range(0, len(self.keys), COLUMNS)] for k in (0, 1)]


def _proto(number: int, x: bytes | int) -> bytes:
    """A field of a protocol buffer, below 128 bytes."""
    return bytes([number << 3 | 2, len(x)]) + x if isinstance(x, bytes) else bytes([number << 3, x])


@functools.cache
def _multiplier() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The product of two matrices of small whole numbers: by onnxruntime where it is installed, twelve times as fast as by floats."""
    try:
        import onnxruntime
    except ImportError:
        return lambda x, y: x.astype(np.float32) @ y.astype(np.float32)
    matrix = lambda name, kind: _proto(1, name) + _proto(2, _proto(1, _proto(1, kind)))
    node = _proto(1, b"x") + _proto(1, b"y") + _proto(2, b"z") + _proto(4, b"MatMulInteger")
    graph = _proto(1, node) + _proto(2, b"product") + _proto(11, matrix(b"x", 2)) + _proto(11, matrix(b"y", 3)) + _proto(12, matrix(b"z", 6))
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    session = onnxruntime.InferenceSession(_proto(1, 8) + _proto(7, graph) + _proto(8, _proto(1, b"") + _proto(2, 13)), options, providers=["CPUExecutionProvider"])
    return lambda x, y: session.run(None, {"x": x, "y": y})[0].astype(np.float32)


def bounded(a: Block, b: Block, rows: slice, cols: slice, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of some texts of two blocks that may score ``least``, none left out, with the most that their words can be alike."""
    alike = []
    for k in (0, 1):
        na, nb = (x.sizes[k].astype(np.float32) for x in (a, b))
        both = _multiplier()(a.down[k][rows.start // ROWS], b.across[k][cols.start // COLUMNS])
        np.minimum(both, na[rows][:, None], out=both)  # shared columns count too much, but never more than the whole set
        rest = np.add.outer(na[rows], nb[cols])
        rest -= both
        both /= rest
        alike.append(both)
    words, mixed = alike[0], alike[1]
    alone = [np.flatnonzero(x.sizes[1][y] == 0) for x, y in ((a, rows), (b, cols))]
    kept = words[alone[0]], words[:, alone[1]]
    mixed *= 1.5
    mixed += words
    mixed[alone[0]], mixed[:, alone[1]] = 2.5 * kept[0], 2.5 * kept[1]
    hit = np.flatnonzero(mixed >= 2.5 * (least - 1e-4))
    i, j = np.divmod(hit, mixed.shape[1])
    return i + rows.start, j + cols.start, words[i, j]


class Shared:
    """Counts what texts of two blocks share of their words (0) or word pairs (1)."""

    def __init__(self, a: Block, b: Block, k: int) -> None:
        self.a, self.b, self.k, known = a, b, k, a.known[k]
        at = np.minimum(np.searchsorted(known, b.known[k]), max(0, len(known) - 1))
        self.place = np.where(known[at] == b.known[k], at, len(known)) if len(known) else np.zeros(len(b.known[k]), np.int64)
        self.wide = len(known) + 1
        self.has = np.zeros(ROWS * self.wide, bool)

    def alike(self, low: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The Jaccard similarities of pairs whose first texts are within ``ROWS`` of one."""
        a, b, k = self.a, self.b, self.k
        high = min(low + ROWS, len(a.keys))
        start = int(a.ends[k][low] - a.sizes[k][low])
        marked = np.repeat(np.arange(high - low), a.sizes[k][low:high]) * self.wide + a.ids[k][start : a.ends[k][high - 1]]
        self.has[marked] = True
        n = b.sizes[k][j]
        ends = np.cumsum(n)
        both = np.zeros(len(i), np.int64)
        at = 0
        while at < len(i):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            m = n[at:to]
            inner = np.arange(int(m.sum())) + np.repeat(b.ends[k][j[at:to]] - np.cumsum(m), m)
            hit = self.has[np.repeat((i[at:to] - low) * self.wide, m) + self.place[b.ids[k][inner]]]
            both[at:to] = np.diff(np.concatenate([[0], np.cumsum(hit)])[np.cumsum(m)], prepend=0)
            at = to
        self.has[marked] = False
        return both / np.maximum(a.sizes[k][i] + n - both, 1)


def block_scores(a: Block, b: Block, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in two blocks, with their scores, of all pairs that score ``least``."""
    words, pairs = Shared(a, b, 0), Shared(a, b, 1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    with np.errstate(divide="ignore", invalid="ignore"):
        for low in range(0, len(a.keys), ROWS):
            rows = slice(low, min(low + ROWS, len(a.keys)))
            hits = [bounded(a, b, rows, slice(c, min(c + COLUMNS, len(b.keys))), least) for c in range(0, len(b.keys), COLUMNS)]
            i, j, most = (np.concatenate([h[k] for h in hits]) for k in (0, 1, 2))
            keep = a.keys[i] < b.keys[j] if a is b else a.keys[i] != b.keys[j]
            i, j, most = i[keep], j[keep], most[keep]
            two = pairs.alike(low, i, j)
            alone = (a.sizes[1][i] == 0) | (b.sizes[1][j] == 0)
            keep = alone | (0.4 * most + 0.6 * two >= least - 1e-4)
            i, j, two, alone = i[keep], j[keep], two[keep], alone[keep]
            one = words.alike(low, i, j)
            score = np.round(np.where(alone, one, 0.4 * one + 0.6 * two), 4)
            keep = score >= least
            found.append((i[keep], j[keep], score[keep]))
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1, 2))


def frequent(texts: list[str]) -> list[np.ndarray]:
    """The hashes of the words, and word pairs, that most of some texts have."""
    memo: dict[str, int] = {}
    both = [sets_of(t, memo) for t in texts]
    out = []
    for k in (0, 1):
        known, many = np.unique(np.concatenate([np.zeros(0, np.uint64), *[x[k] for x in both]]), return_counts=True)
        out.append(np.sort(known[np.argsort(-many, kind="stable")[:DENSE]]))
    return out


def class_scores(classes: DataFrame, least: float = LEAST) -> DataFrame:
    """(x, y, score): every pair of (key, text) rows with that score at least, x < y."""
    many = classes.count()
    blocks = max(1, -(-many // BLOCK), min(FEWEST, many // 500))
    columns = frequent([r.text for r in classes.select("text").limit(TOLD).collect()])

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, int] = {}
        for frame in frames:
            both = [sets_of(t, memo) for t in frame.text]
            made = pd.DataFrame({"key": frame.key, "w": [w.tobytes() for w, _ in both], "b": [b.tobytes() for _, b in both]})
            yield made[[len(w) > 0 for w, _ in both]]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        row = [int(frame.block.iat[0]), frame.key.to_numpy(np.int64).tobytes()]
        for c in ("w", "b"):
            known, ids = np.unique(np.frombuffer(b"".join(frame[c]), np.uint64), return_inverse=True)
            row += [np.array([len(x) // 8 for x in frame[c]], np.int64).tobytes(), known.tobytes(), ids.astype(np.int32).tobytes()]
        return pd.DataFrame([row], columns=names)

    names = ["block", "keys", "wn", "w", "wi", "bn", "b", "bi"]
    sets = classes.mapInPandas(sketch, "key bigint, w binary, b binary").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    packed = stage(sets.groupBy("block").applyInPandas(pack, _PACKED).repartitionByRange(-(-blocks // 2), "block"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Block] = {}

        def block(row: tuple) -> Block:
            if (known := held.pop(row[0], None)) is None:
                keys, *sets = (np.frombuffer(x, kind) for x, kind in zip(row[1:], (np.int64, *(np.int64, np.uint64, np.int32) * 2)))
                known = Block(keys, [tuple(sets[:3]), tuple(sets[3:])], columns)
            while len(held) >= HELD:
                held.pop(next(iter(held)))
            held[row[0]] = known
            return known

        for frame in frames:
            for row in frame.itertuples(index=False):
                left, right = block(row[: len(names)]), block(row[len(names) :])
                i, j, score = block_scores(left, right, least)
                x, y = left.keys[i], right.keys[j]
                yield pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y), "score": score})

    a, b = packed.toDF(*[f"{n}_a" for n in names]), packed.toDF(*[f"{n}_b" for n in names])
    # a nested loop over a broadcast side would ship all texts: the staged blocks are read again instead
    pairs = a.hint("shuffle_replicate_nl").join(b, F.col("block_a") <= F.col("block_b"))
    return pairs.mapInPandas(compare, "x bigint, y bigint, score double")


def scores(docs: DataFrame) -> DataFrame:
    """(a, b, score, level) of every pair of (id, text) rows that scores 0.3 or more."""
    members = stage(docs.where("text is not null").select("id", F.sha2("text", 256).alias("class"), "text"))
    classes = stage(members.groupBy("class").agg(F.first("text").alias("text")).withColumn("key", F.monotonically_increasing_id()))
    named = stage(members.select("id", "class").join(classes.select("class", "key"), "class").select("id", "key"))
    near = class_scores(classes.select("key", "text"))
    met = near.join(named.toDF("a", "x"), "x").join(named.toDF("b", "y"), "y").select("a", "b", "score")
    wordy = classes.where(F.lower("text").rlike(r"[\p{L}\p{N}_]")).select("key")
    some = named.join(wordy, "key", "left_semi").select("id", "key")
    same = some.toDF("a", "key").join(some.toDF("b", "key"), "key").where("a < b").select("a", "b", F.lit(1.0).alias("score"))
    every = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").unionByName(same)
    return every.withColumn("level", F.when(F.col("score") >= 0.85, "CRITICAL").when(F.col("score") >= 0.65, "WARNING").otherwise("LOW"))


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    return scores(doc_index(spark, d).select("id", F.col("body").alias("text")))


CATALOG = {"search_duplicate_texts": (duplicate_texts, None)}
