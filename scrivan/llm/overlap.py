"""Evaluation lines that occur, exactly or almost, in the training split: Aho–Corasick over sharded evaluation pieces.

Every distinct normalised evaluation line is cut into ``edits + 1`` runs of words; a training line that equals it up to
``edits`` inserted, removed or replaced words holds one of the runs unbroken, within ``edits`` places of where it stands
in the evaluation line. The runs are sharded; each shard's automaton scans the training lines routed to it, and a hit is
confirmed by a banded word edit distance. A line is routed by word pairs: each run is known by one of its pairs (its
rarest among all runs), and a training line goes to the shards of those of its pairs that some run is known by, where
the pair stands, and the line is as long, as ``edits`` allow for one of these runs. Nothing is lost by this, and a line
goes to no more shards than it has words, however many shards there are.

Shards grow in number with the evaluation lines; an anchor that more than ``PIECES`` runs share is cut into parts of
about that size, and every part is salted by the number of lines routed to it, so no task holds more than a bounded
number of either. Equal lines are scanned once.

Cases: null and empty texts, and texts without a letter or digit, are no cases; rows whose split is null are in no
split; repeated rows count once; empty tables give empty results; columns beyond the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivan.llm.words import words
from scrivan.runtime import parallelism, stage

#: Runs per automaton, training lines scanned by one task, and anchors that are broadcast (8 bytes each).
PIECES, LINES, MOST_ANCHORS = 40_000, 100_000, 1_000_000


@F.pandas_udf(T.StringType())
def _norm(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(words(t)) if t else "")


def near(a: list[str], b: list[str], edits: int) -> bool:
    """Whether the word edit distance is at most ``edits``: a band around the diagonal."""
    n, m = len(a), len(b)
    if abs(n - m) > edits:
        return False
    far = edits + 1
    row = [j if j <= edits else far for j in range(m + 1)]
    for i in range(1, n + 1):
        low, high = max(1, i - edits), min(m, i + edits)
        new = [far] * (m + 1)
        if i <= edits:
            new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, new[j - 1] + 1)
        if min(new) > edits:
            return False
        row = new
    return row[m] <= edits


def _pieces(norm: str, edits: int, least: int) -> list[tuple[int, int]]:
    n = norm.count(" ") + 1
    if n < least:
        return [(0, n)]
    cuts = [n * k // (edits + 1) for k in range(edits + 2)]
    return list(zip(cuts, cuts[1:]))


def _scan(edits: int, least: int):
    import ahocorasick

    def run(evals: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        if evals.empty or lines.empty:
            return pd.DataFrame({"norm": [], "start": [], "stop": []})
        automaton = ahocorasick.Automaton()
        texts: dict[str, dict[tuple[int, int], list[tuple[int, int]]]] = {}
        norms = evals.norm.tolist()
        split = [x.split(" ") for x in norms]
        for k, (ws, start, stop) in enumerate(zip(split, evals.start, evals.stop)):
            piece = " " + " ".join(ws[start:stop]) + " "
            texts.setdefault(piece, {}).setdefault((len(ws), int(start)), []).append((k, int(stop)))
        for piece, owners in texts.items():
            automaton.add_word(piece, (len(piece), owners))
        automaton.make_automaton()
        out, done = [], set()
        shifts = range(-edits, edits + 1)
        sets: dict[int, set[str]] = {}
        for line in lines.line:
            padded = f" {line} "
            own = line.split(" ")
            words_of_line, far = set(own), set()
            for end, (size, owners) in automaton.iter(padded):
                at = padded.count(" ", 0, end - size + 2) - 1
                if len(owners) < len(shifts) ** 2:
                    places = [x for x in owners if abs(x[0] - len(own)) <= edits and abs(x[1] - at) <= edits]
                else:
                    places = [x for n in shifts for shift in shifts if (x := (len(own) + n, at + shift)) in owners]
                for place in places:
                    for k, stop in owners[place]:
                        if k in done or norms[k] in far:
                            continue
                        norm = norms[k]
                        if norm != line:
                            if len(own) < least or place[0] < least:
                                continue
                            # each edit takes one word of a line at most
                            if (mine := sets.get(k)) is None:
                                mine = sets[k] = set(split[k])
                            if len(mine - words_of_line) > edits or len(words_of_line - mine) > edits or not near(split[k], own, edits):
                                far.add(norm)
                                continue
                        done.add(k)
                        out.append((norm, place[1], stop))
        return pd.DataFrame(out, columns=["norm", "start", "stop"])

    return run


def _anchored(df: DataFrame, col: str) -> DataFrame:
    """Adds ``pairs``: hashes of the word pairs of a normalised text, of its word where it has one."""
    w = F.split(F.col(col), " ")
    last = F.size(w) - 1
    both = F.arrays_zip(F.slice(w, F.lit(1), last).alias("x"), F.slice(w, F.lit(2), last).alias("y"))
    pairs = F.when(last < 1, F.array(F.xxhash64(w[0], F.lit("")))).otherwise(F.transform(both, lambda x: F.xxhash64(x["x"], x["y"])))
    return df.withColumn("pairs", pairs)


def overlapping(rows: DataFrame, edits: int = 2, least: int = 8, evaluated: tuple[str, ...] = ("validation", "test"), train: str = "train") -> DataFrame:
    """(norm, start, stop): each evaluation line, normalised, that the training split holds, with the runs found there."""
    spark = rows.sparkSession
    texts = rows.where("text is not null and text <> ''").where(F.col("split").isin(*evaluated, train))
    kinds = texts.groupBy("text").agg(F.max(F.when(F.col("split") == train, 1).otherwise(0)).alias("t"), F.max(F.when(F.col("split") != train, 1).otherwise(0)).alias("e"))
    normed = stage(kinds.withColumn("norm", _norm("text")).where("norm <> ''").groupBy("norm").agg(F.max("t").alias("t"), F.max("e").alias("e")))

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def cut(norm: pd.Series) -> pd.Series:
        return norm.map(lambda x: [{"start": a, "stop": b} for a, b in _pieces(x, edits, least)])

    runs = normed.where("e = 1").select("norm", F.explode(cut("norm")).alias("p")).select("norm", "p.start", "p.stop")
    runs = _anchored(runs.withColumn("run", F.array_join(F.slice(F.split("norm", " "), F.col("start") + 1, F.col("stop") - F.col("start")), " ")), "run")
    runs = stage(runs.select("norm", "start", "stop", "pairs"))
    # each run is known by its rarest pair, so that a pair that many runs hold is the anchor of those only that have no other
    held = runs.select("norm", "start", F.explode(F.array_distinct("pairs")).alias("pair"))
    rarest = held.join(held.groupBy("pair").agg(F.count(F.lit(1)).alias("c")), "pair").groupBy("norm", "start").agg(F.min(F.struct("c", "pair")).alias("m"))
    runs = stage(runs.join(rarest, ["norm", "start"]).select("norm", "start", "stop", F.col("m.pair").alias("anchor"), (F.col("start") + F.array_position("pairs", F.col("m.pair")) - 1).alias("at")))
    n_runs = runs.count()
    shards = max(1, -(-n_runs // PIECES))
    # an anchor of more runs than an automaton holds is cut into parts of that size, each of which its lines visit
    size = F.size(F.split("norm", " "))
    reach = [(F.min("at") - edits).alias("from_at"), (F.max("at") + edits).alias("to_at"), (F.min(size) - edits).alias("from_size"), (F.max(size) + edits).alias("to_size")]
    known = stage(runs.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / PIECES).cast("int").alias("parts"), *reach).withColumn("shard", F.pmod("anchor", F.lit(shards)).cast("int")))
    runs = runs.join(known.select("anchor", "parts", "shard"), "anchor").select("norm", "start", "stop", "shard", F.pmod(F.xxhash64("norm", "start"), F.col("parts")).cast("int").alias("part"))
    lines = _anchored(normed.where("t = 1").select(F.col("norm").alias("line")), "line")
    placed = lambda x: F.transform(x, lambda h, k: F.struct(h.alias("anchor"), k.alias("at")))
    pairs = placed(F.col("pairs"))
    # a run of one word is known by that word: then lines are routed by their words too
    if not runs.where("stop - start = 1").isEmpty():
        pairs = F.concat(pairs, placed(F.transform(F.split("line", " "), lambda x: F.xxhash64(x, F.lit("")))))
    keys = lines.select("line", F.size(F.split("line", " ")).alias("size"), F.inline(pairs))
    # beside few anchors the lines stay where they are; more of them are joined by shuffles, with the same result
    near = F.broadcast(known) if known.count() <= MOST_ANCHORS else known
    fits = F.col("at").between(F.col("from_at"), F.col("to_at")) & F.col("size").between(F.col("from_size"), F.col("to_size"))
    visits = keys.join(near, "anchor").where(fits).select("line", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    routed = stage(visits.distinct())
    load = routed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    cells = load.count()
    spread = max(1, -(-parallelism(spark) // max(1, cells)))
    load = load.select("shard", "part", F.greatest(F.ceil(F.col("n") / LINES), F.least(F.lit(spread), F.ceil(F.col("n") / 1000))).cast("int").alias("salts"))
    left = runs.join(load, ["shard", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("norm", "start", "stop", "shard", "part", "salt")
    right = routed.join(load, ["shard", "part"]).select("line", "shard", "part", F.pmod(F.xxhash64("line"), F.col("salts")).cast("int").alias("salt"))
    hits = left.groupBy("shard", "part", "salt").cogroup(right.groupBy("shard", "part", "salt")).applyInPandas(
        lambda a, b: _scan(edits, least)(a, b), "norm string, start int, stop int"
    )
    return hits.distinct()


def coverage(hits: DataFrame) -> DataFrame:
    """(norm, covered): per evaluation line, the share of its words inside merged matched runs."""
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", "stop"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda s, x: F.struct(F.greatest(s["end"], x["stop"]).alias("end"), (s["sum"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["end"], x["start"]))).alias("sum")),
    )
    return hits.groupBy("norm").agg(merged["sum"].alias("n")).select("norm", (F.col("n") / F.size(F.split("norm", " "))).alias("covered"))


def found(rows: DataFrame) -> DataFrame:
    """(row_id) of the evaluation rows whose line the training split holds, exactly or almost."""
    hits = overlapping(rows).select("norm").distinct()
    mine = rows.where("text is not null and text <> ''").where(F.col("split").isin("validation", "test"))
    return mine.select("row_id", _norm("text").alias("norm")).join(hits, "norm", "left_semi").select("row_id").distinct()


def report(rows: DataFrame) -> DataFrame:
    """(split, source, n_rows, n_overlap, mean_covered): overlaps per evaluation split and source, over distinct row ids."""
    hits = coverage(overlapping(rows))
    mine = rows.where(F.col("split").isin("validation", "test")).select("row_id", "split", "source", _norm(F.coalesce("text", F.lit(""))).alias("norm")).distinct()
    return (
        mine.join(hits, "norm", "left")
        .groupBy("split", "source")
        .agg(F.countDistinct("row_id").alias("n_rows"), F.countDistinct(F.when(F.col("covered").isNotNull(), F.col("row_id"))).alias("n_overlap"), F.avg("covered").alias("mean_covered"))
    )
