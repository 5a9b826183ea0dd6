"""Fixed-capacity containers: vector best-fit over tokens, documents and attention cost.

Sizes are tokens of a public byte-level BPE vocabulary (its path is a parameter). A document longer than the capacity is
cut into full pieces and a rest; only such documents are cut. A container has three capacities: tokens, documents, and
the sum of squared sizes, which is what attention inside each document costs; the last is below the square of the token
capacity, so that no container costs as much as one long document beside others (an item that alone costs more has a
container of its own). Items go, by a hash, to blocks of a bounded expected size; each block is packed by itself,
largest item first, into the best of all open containers under every capacity. Containers that stay emptier than
``full`` are opened again and packed once more in fewer, mixed blocks.

Cases: null texts and empty texts have no tokens and no container; equal ids with equal text are one item; ties fall to
the smaller id; an empty table gives an empty result. Texts of any length are tokenised whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivan.runtime import stage

#: Tokens, documents and share of the squared tokens that a container may hold; items of a block.
CAPACITY, MOST_DOCUMENTS, COST_SHARE, BLOCK = 2048, 16, 0.9, 20_000
WEIGHTS = (1.0, 0.05, 0.1)
_encoders: dict[str, object] = {}


def encoder(path: str):
    """A tokenizer from a public rank file, kept for the life of the process."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        _encoders[path] = tiktoken.Encoding(Path(path).stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens) of every document with a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            sizes = []
            for text in batch.column(1).to_pylist():
                # whole texts; only the call is cut, where the tokenizer always cuts too
                sizes.append(sum(len(enc.encode_ordinary(p)) for p in _parts(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.where("text is not null and text <> '' and doc_id is not null").select("doc_id", "text")
    return rows.mapInArrow(count, f"doc_id {kind}, n_tokens bigint").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


_FRESH_LINE = re.compile(r"\n(?=\S)")


def _parts(text: str, size: int = 200_000) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut only between a line end and a character that is no blank.

    No token of the vocabulary's pattern spans such a place, so the parts have as many tokens as the whole.
    """
    at = 0
    while len(text) - at > size and (m := _FRESH_LINE.search(text, at + size)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def best_fit(sizes: list[int], capacity: int, most: int, cost: int, weights: tuple[float, float, float] = WEIGHTS, choose: str = "norm", refused: dict[str, int] | None = None) -> list[int]:
    """The container of each item, items being in falling size.

    An open container is fit for an item under all three capacities; an item that alone exceeds the cost stands alone.
    Of all the fit ones the item goes to the one of least weighted residual norm (``norm``), or of greatest weighted dot
    product of demand and residuals (``dot``); ties fall to the older container. ``refused`` counts what each capacity
    alone kept out.
    """
    wt, wd, wc = weights[0] / capacity**2, weights[1] / most**2, weights[2] / cost**2
    n = len(sizes)
    rest, docs, used, name = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    live = made = 0
    least = sizes[-1] if n else 0
    out = []
    for turn, size in enumerate(sizes):
        own = size * size
        r, d, c = rest[:live] - size, most - 1 - docs[:live], cost - own - used[:live]
        fits = (r >= 0) & (d >= 0) & (c >= 0)
        if refused is not None:
            refused["tokens"] += int(((r < 0) & (d >= 0) & (c >= 0)).sum())
            refused["documents"] += int(((r >= 0) & (d < 0) & (c >= 0)).sum())
            refused["cost"] += int(((r >= 0) & (d >= 0) & (c < 0)).sum())
        at = np.flatnonzero(fits)
        if len(at):
            if choose == "norm":
                score = wt * r[at] ** 2 + wd * d[at] ** 2 + wc * c[at].astype(float) ** 2
            else:
                score = -(wt * size * rest[at] + wd * (most - docs[at]) + wc * float(own) * (cost - used[at]))
            best = int(at[score.argmin()])
            rest[best] -= size
            docs[best] += 1
            used[best] += own
        else:
            best = live
            rest[best], docs[best], used[best], name[best] = capacity - size, 1, own, made
            live += 1
            made += 1
        out.append(int(name[best]))
        if turn % 256 == 255:  # containers that no later item fits are closed
            room, few, cheap = rest[:live] >= least, docs[:live] < most, used[:live] < cost
            if refused is not None:
                refused["documents"] += int((room & ~few & cheap).sum())
                refused["cost"] += int((room & few & ~cheap).sum())
            keep = np.flatnonzero(room & few & cheap)
            for x in (rest, docs, used, name):
                x[: len(keep)] = x[keep]
            live = len(keep)
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, most: int = MOST_DOCUMENTS, cost: int | None = None, block: int = BLOCK, full: float = 0.97) -> DataFrame:
    """(doc_id, n_tokens) -> (doc_id, piece, n_tokens, container, fill): the container of each document or piece."""
    cost = cost or int(COST_SHARE * capacity**2)
    kind = items.schema["doc_id"].dataType.simpleString()
    whole = F.expr(f"n_tokens div {capacity}")
    pieces = F.when(
        F.col("n_tokens") > capacity,
        F.filter(F.concat(F.array_repeat(F.lit(capacity), whole.cast("int")), F.array((F.col("n_tokens") % capacity).cast("int"))), lambda x: x > 0),
    ).otherwise(F.array(F.col("n_tokens").cast("int")))
    parts = stage(items.where("n_tokens > 0").select("doc_id", F.posexplode(pieces).alias("piece", "n_tokens")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True])
        bins = best_fit(frame.n_tokens.tolist(), capacity, most, cost)
        frame["bin"] = bins
        frame["fill"] = frame.groupby("bin").n_tokens.transform("sum") / capacity
        return frame[["doc_id", "piece", "n_tokens", "block", "bin", "fill"]]

    schema = f"doc_id {kind}, piece int, n_tokens int, block int, bin int, fill double"
    n = parts.count()
    blocks = max(1, -(-n // block))
    first = stage(parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(run, schema))
    kept, rest = first.where(F.col("fill") >= full), first.where(F.col("fill") < full)
    again = max(1, -(-rest.count() // block))
    second = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(2)), F.lit(again)).cast("int")).groupBy("block").applyInPandas(run, schema)
    name = lambda d, turn: d.select("doc_id", "piece", "n_tokens", F.concat_ws("-", F.lit(turn), "block", "bin").alias("container"), "fill")
    return name(kept, "a").unionByName(name(second, "b"))


def containers(documents: DataFrame, vocabulary: str, **how) -> DataFrame:
    return pack(token_counts(documents, vocabulary), **how)
