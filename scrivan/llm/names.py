"""Variant spellings of names: MinHash bands over padded q-grams, Monge–Elkan similarity, star clustering.

An entity is what is surely one student beforehand: all rows with the same student number (however it is written), or,
without a number, all rows with the same folded name and class code. Entities are linked when one of two things holds:

* both have a number, the numbers differ by one mistyped digit or two swapped neighbours, at most one of them stands in
  more than one row (a mistyped number belongs to nobody else), the names agree and the class codes don't disagree;
* at least one has no number, the class codes are equal and the names agree.

Names agree when the Monge–Elkan similarity of the shorter to the longer, over folded parts in any order (initials
stand for parts that begin with them), reaches a threshold. Candidates for it share a band: a MinHash of the padded
q-grams of the name's parts together with the class code, or of the number with one place masked or two swapped. The
number of bands follows from the collision curve 1 - (1 - s^r)^b for a wanted recall at the least q-gram similarity.
Bands of more than ``HOT`` entities are cut into blocks of about that size, and each pair of blocks is compared by
itself, so that no pair is lost.

Star clustering: the centres are the entities with more rows than every neighbour they compete with; each other entity
joins the best centre beside it, and none if two different centres fit equally well. Rounds go on until no link is left.

Cases: null or blank names still follow their number; rows without name and number are alone; repeated rows count once;
ties fall to the smaller entity; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivan.llm.words import words
from scrivan.runtime import stage

Q, RECALL, LEAST_SIMILARITY, THRESHOLD, HOT = 3, 0.98, 0.2, 0.88, 2000


def _met(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that broadcasts nothing: staged tables of names are many times larger in memory than the files that Spark goes by."""
    return a.hint("merge").join(b.hint("merge"), on, how)


def bands_needed(similarity: float, rows: int, recall: float) -> int:
    """The least b with 1 - (1 - s^r)^b >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def number_key(number: Column) -> Column:
    """The digits of a student number; null if there are none."""
    return F.nullif(F.regexp_replace(number, r"\D", ""), F.lit(""))


def class_key(code: Column) -> Column:
    """Letters and year digits of a class code without the word for class, blanks, dashes and letter case."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(code), r"[^\p{L}\p{N}]", ""), "^l(ớ|o)p", ""), F.lit(""))


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    """The folded parts of a name in one order; a dot after an initial is kept."""
    return names.map(lambda n: " ".join(sorted(words(n))) if n else "")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _minhash(names: pd.Series, count: pd.Series) -> pd.Series:
    """MinHashes over the padded q-grams of a name's parts."""
    import xxhash

    def one(name: str, n: int) -> list[int]:
        grams = {f"{'#' * (Q - 1)}{part}#"[i : i + Q].encode() for part in name.split(" ") for i in range(len(part) + 1)}
        return [min(xxhash.xxh64_intdigest(g, seed) for g in grams) >> 1 for seed in range(n)]

    return pd.Series([one(a, b) for a, b in zip(names, count)])


def damerau(a: str, b: str) -> int:
    """Edits of two strings, a swap of two neighbours counting as one."""
    before, row = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        new = [i]
        for j in range(1, len(b) + 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if before and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
    return row[-1]


def part_similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.9 if a[0] == b[0] else 0.0
    d = damerau(a, b)
    return 1 - d / max(len(a), len(b)) if d <= (1 if max(len(a), len(b)) < 6 else 2) else 0.0


def monge_elkan(a: str, b: str) -> float:
    """Of the name with fewer parts to the other one: the mean of each part's best partner, each partner serving once."""
    x, y = sorted((a.split(" "), b.split(" ")), key=len)
    if not a or not b or len(x) < 2:
        return 1.0 if a == b and a else 0.0
    scored = sorted(((part_similarity(p, q), -i, -j) for i, p in enumerate(x) for j, q in enumerate(y)), reverse=True)
    left, right, total = set(), set(), 0.0
    for s, i, j in scored:
        if i not in left and j not in right and s > 0:
            left.add(i)
            right.add(j)
            total += s
    lost = len(y) - len(x)
    return total / len(x) - 0.02 * lost


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = monge_elkan(*pair)
        out.append(known[pair])
    return pd.Series(out)


def entities(rows: DataFrame) -> DataFrame:
    """(id, student_name, entity, number, name, code): each distinct row with its entity."""
    code = class_key(F.get_json_object("extra", "$.lop"))
    base = rows.where("id is not null").select("id", "student_name", number_key(F.col("student_id")).alias("number"), code.alias("code")).dropDuplicates(["id"])
    base = base.withColumn("name", _folded("student_name"))
    alone = F.when((F.col("name") != "") & F.col("code").isNotNull(), F.concat_ws(":", F.lit("n"), "code", "name")).otherwise(F.concat(F.lit("x:"), "id"))
    return base.withColumn("entity", F.coalesce(F.concat(F.lit("s:"), "number"), alone))


def _neighbour_keys(number: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(number))
    masked = F.transform(places, lambda i: F.concat(F.lit("m"), i.cast("string"), F.substring(number, F.lit(1), i - 1), F.lit("*"), F.substring(number, i + 1, F.length(number))))
    pair = lambda i: F.array_join(F.array_sort(F.array(F.substring(number, i, F.lit(1)), F.substring(number, i + 1, F.lit(1)))), "")
    swapped = F.transform(
        F.filter(places, lambda i: i < F.length(number)),
        lambda i: F.concat(F.lit("t"), i.cast("string"), F.substring(number, F.lit(1), i - 1), pair(i), F.substring(number, i + 2, F.length(number))),
    )
    return F.concat(masked, swapped)


def _pairs(keyed: DataFrame) -> DataFrame:
    """(key, vertex, open) -> distinct (a, b) that share a key, one of them open at least."""
    a, b = keyed.where("open").toDF("key", "a", "open_a"), keyed.toDF("key", "b", "open_b")
    return _met(a, b, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _blocked_pairs(banded: DataFrame) -> DataFrame:
    """``_pairs`` of staged (key, vertex, open, number), by pairs of blocks of a band; only what ``links`` may keep by its numbers."""
    hot = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("key", F.ceil(F.col("c") / HOT).cast("int").alias("blocks"))
    marked = _met(banded, hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    marked = marked.withColumn("home", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a = marked.where("open").select("key", F.col("home").alias("i"), F.col("other").alias("j"), F.col("vertex").alias("a"), F.col("number").alias("number_a"))
    b = marked.select("key", F.col("other").alias("i"), F.col("home").alias("j"), F.col("vertex").alias("b"), F.col("number").alias("number_b"))
    near = F.coalesce(F.levenshtein("number_a", "number_b") <= 2, F.lit(True))
    return _met(a, b, ["key", "i", "j"]).where((F.col("a") != F.col("b")) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(base: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, score): entities that may be the same student."""
    every = base.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("number"), F.mode("code").alias("code"))
    every = stage(every)
    # who may join another entity: no number, or a number that stands in one row
    open_ = (F.col("number").isNull()) | (F.col("n") == 1)
    spelt = stage(base.where("name <> ''").select("entity", "name").distinct())
    count = bands_needed(LEAST_SIMILARITY, 1, RECALL)
    hashed = _met(spelt, every.where("code is not null").select("entity", "code", "number", open_.alias("open")), "entity").withColumn("h", _minhash("name", F.lit(count)))
    banded = hashed.select("entity", "open", "number", F.posexplode("h").alias("band", "value"), "code").select(
        F.xxhash64("code", "band", "value").alias("key"), F.col("entity").alias("vertex"), "open", "number"
    )
    by_name = _blocked_pairs(stage(banded.distinct()))
    numbers = every.where("number is not null").select(F.explode(_neighbour_keys(F.col("number"))).alias("key"), F.col("entity").alias("vertex"), open_.alias("open"))
    candidates = stage(by_name.unionByName(_pairs(numbers)).distinct())
    side = lambda x: every.select(*[F.col(c).alias(f"{c}_{x}") for c in ("n", "number", "code")], F.col("entity").alias(x))
    near = F.levenshtein("number_a", "number_b")
    swapped = F.array_sort(F.split("number_a", "")) == F.array_sort(F.split("number_b", ""))
    both = F.col("number_a").isNotNull() & F.col("number_b").isNotNull()
    one_edit = (F.length("number_a") == F.length("number_b")) & ((near <= 1) | (swapped & (near == 2)))
    two_slips = (F.col("n_a") == 1) & (F.col("n_b") == 1) & (near <= 2) & (F.col("code_a") == F.col("code_b"))
    agree = F.col("code_a") == F.col("code_b")
    fit = F.when(both, (one_edit | two_slips) & F.coalesce(agree, F.lit(True))).otherwise(F.coalesce(agree, F.lit(False)))
    apart = both & (F.col("n_a") > 1) & (F.col("n_b") > 1)
    kept = _met(_met(candidates, side("a"), "a"), side("b"), "b").where(fit & ~apart)
    named = _met(_met(kept, spelt.toDF("a", "name_a"), "a"), spelt.toDF("b", "name_b"), "b").select("a", "b", "name_a", "name_b", both.alias("both"))
    scored = named.withColumn("score", _similarity("name_a", "name_b")).groupBy("a", "b").agg(F.max("score").alias("score"), F.first("both").alias("both"))
    # a number one slip away is evidence of its own
    return scored.where(F.col("score") >= F.when(F.col("both"), threshold - 0.08).otherwise(threshold)).select("a", "b", (F.col("score") + F.when(F.col("both"), 1.0).otherwise(0.0)).alias("score"))


def stars(edges: DataFrame, weight: DataFrame, most_rounds: int = 30) -> DataFrame:
    """(satellite, centre): star clustering of (a, b, score) edges; (entity, w) ranks centres, heavier first."""
    out, live = None, None
    half = edges.select(F.col("a").alias("v"), F.col("b").alias("o"), "score").unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("o"), "score"))
    live = stage(_met(_met(half, weight.toDF("v", "wv"), "v"), weight.toDF("o", "wo"), "o"))
    for _ in range(most_rounds):
        if live.isEmpty():
            break
        above = (F.col("wo") > F.col("wv")) | ((F.col("wo") == F.col("wv")) & (F.col("o") < F.col("v")))
        centre = live.groupBy("v").agg(F.max(above).alias("below")).where("not below").select(F.col("v").alias("c"))
        offers = _met(live, centre.toDF("o"), "o", "left_semi")
        best = Window.partitionBy("v").orderBy(F.desc("score"), F.desc("wo"), "o")
        ranked = offers.withColumn("k", F.row_number().over(best)).withColumn("next", F.lead("score").over(best))
        joined = ranked.where("k = 1 and (next is null or next < score - 1e-6)").select(F.col("v").alias("satellite"), F.col("o").alias("centre"))
        # what two centres fit equally well joins neither
        settled = stage(ranked.where("k = 1").select(F.col("v").alias("x")).unionByName(centre.toDF("x")).distinct())
        joined = stage(joined)
        out = joined if out is None else out.unionByName(joined)
        live = stage(_met(_met(live, settled.toDF("v"), "v", "left_anti"), settled.toDF("o"), "o", "left_anti"))
    else:
        raise RuntimeError("star clustering did not end")
    return out if out is not None else edges.select(F.col("a").alias("satellite"), F.col("b").alias("centre")).limit(0)


def linked(rows: DataFrame) -> DataFrame:
    """(id, student_name, student): every row with the student it belongs to."""
    base = stage(entities(rows))
    weight = base.groupBy("entity").agg(F.max(F.when(F.col("number").isNotNull(), 1_000_000).otherwise(0)).alias("k"), F.count(F.lit(1)).alias("c"))
    sure = F.when(F.col("c") > 1, F.col("k") + F.col("c")).otherwise(F.col("k") / 2 + F.col("c"))
    joined = stars(links(base), weight.select("entity", sure.alias("w")))
    return _met(base, joined, base.entity == joined.satellite, "left").select("id", "student_name", F.coalesce("centre", "entity").alias("student"))


def found(rows: DataFrame) -> DataFrame:
    """(metadata_id_a, metadata_id_b): two rows of one student whose names differ as strings."""
    named = stage(linked(rows).where("student_name is not null"))
    a, b = named.toDF("x", "name_x", "student"), named.toDF("y", "name_y", "student")
    pairs = _met(a, b, "student").where("x < y and name_x <> name_y")
    return pairs.select(F.col("x").alias("metadata_id_a"), F.col("y").alias("metadata_id_b"))
