"""Splits that keep related records together: random-mate contraction in SQL joins, then splits by cumulative weight.

Cases: null or blank ids link nothing; rows without both id and path are groups of their own; empty input gives empty
output; repeated rows add weight, not links. Extra columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivan.runtime import stage


def id_key(doc_id: Column) -> Column:
    """How an id is written doesn't matter: letter case, separators and leading zeros go."""
    bare = F.regexp_replace(F.lower(doc_id), r"[^\p{L}\p{N}]", "")
    return F.nullif(F.regexp_replace(bare, r"^(\D*)0+(?=\d)", "$1"), F.lit(""))


def source_file(path: Column) -> Column:
    """The source file of ``<folders>/<source file>_p<page>_line_<line><copy mark>.<type>``; null if the name has no such end.

    A name of another form counts as a file by itself, without its type.
    """
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    stem = F.regexp_extract(name, r"^(.*?)[\s_\-]*p\d+[\s_\-]*line[\s_\-]*\d+[^/]*$", 1)
    whole = F.regexp_replace(name, r"\.[a-z0-9]{1,5}$", "")
    base = F.when(stem != "", stem).otherwise(whole)
    return F.nullif(F.regexp_replace(base, r"[^\p{L}\p{N}]+", ""), F.lit(""))


def contract(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(u, v) -> (vertex, label): the vertices that have an edge and a label shared by each component.

    Random mate: each round every vertex draws a coin; a tail with a head beside it collapses into the smallest such
    head. An edge vanishes in a round with probability 1/2 or more, so rounds are logarithmic in the number of edges.
    Each round is a few equi-joins over what is left; the maps of all rounds are unwound last to first.
    """
    live = stage(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps: list[DataFrame] = []
    for turn in range(most_rounds):
        if live.isEmpty():
            break
        coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2)) == 1
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = stage(both.where(~coin("u") & coin("v")).groupBy("u").agg(F.min("v").alias("p")))
        maps.append(step)
        left, right = step.toDF("u", "pu"), step.toDF("v", "pv")
        moved = live.join(left, "u", "left").join(right, "v", "left").select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b"))
        live = stage(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    else:
        raise RuntimeError(f"{most_rounds} rounds did not contract every component")
    spark = edges.sparkSession
    if not maps:
        return spark.createDataFrame([], edges.select("u", F.col("v").alias("l")).schema).toDF("vertex", "label")
    done = maps[-1].toDF("vertex", "label")
    for number, step in enumerate(reversed(maps[:-1])):
        known = done.toDF("p", "l")
        done = step.join(known, "p", "left").select(F.col("u").alias("vertex"), F.coalesce("l", "p").alias("label")).unionByName(done)
        if number % 4 == 3:
            done = stage(done)
    roots = done.select(F.col("label").alias("vertex"), "label").distinct()
    return stage(done.unionByName(roots))


def record_groups(rows: DataFrame, id_col: str = "doc_id", path_col: str = "image_path") -> DataFrame:
    """One row per distinct (id as written, path's file): ``member`` (id as written), ``file``, ``grp``, ``n_rows``."""
    base = (
        rows.select(F.col(id_col).alias("member"), id_key(F.col(id_col)).alias("nid"), source_file(F.col(path_col)).alias("file"))
        .groupBy("member", "nid", "file")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    base = stage(base.withColumn("vertex", F.coalesce(F.concat(F.lit("i:"), "nid"), F.concat(F.lit("f:"), "file"), F.lit("none"))))
    linked = base.where("vertex <> 'none' and file is not null").select("vertex", "file").distinct()
    hubs = linked.groupBy("file").agg(F.min("vertex").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    labels = contract(linked.join(hubs, "file").select(F.col("vertex").alias("u"), F.col("hub").alias("v")))
    return base.join(labels, "vertex", "left").select("member", "file", "n_rows", F.coalesce("label", "vertex").alias("grp"))


def found(rows: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every id as written that shares its group with another id as written."""
    members = stage(record_groups(rows).where("member is not null and grp <> 'none'").select("grp", "member").distinct())
    size = members.groupBy("grp").agg(F.min("member").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(size, "grp").select(F.col("member").alias("doc_id"), "group_id")


def assign_splits(weights: DataFrame, shares: dict[str, float], order_parts: int | None = None) -> DataFrame:
    """(grp, weight) -> (grp, weight, split): groups in falling weight lie on a line; the split is where a group's middle falls.

    The heaviest groups come first and so into the first (largest) share; the boundaries fall among light groups, so
    shares are off by less than one light group. The running sum is made from sums per range partition, so no task
    holds more than its range; ties break on a hash of the group.
    """
    spark = weights.sparkSession
    ranged = stage(
        weights.withColumn("tie", F.xxhash64("grp"))
        .repartitionByRange(order_parts or int(spark.conf.get("spark.sql.shuffle.partitions")), F.desc("weight"), "tie", "grp")
        .withColumn("part", F.spark_partition_id())
    )
    sums = ranged.groupBy("part").agg(F.sum("weight").alias("w")).orderBy("part").collect()  # one row per partition
    total, before, starts = sum(r.w for r in sums), 0, []
    for r in sums:
        starts.append((r.part, before))
        before += r.w
    offset = F.create_map(*[F.lit(x) for pair in starts for x in pair])[F.col("part")] if starts else F.lit(0)
    from pyspark.sql import Window

    line = Window.partitionBy("part").orderBy(F.desc("weight"), "tie", "grp").rowsBetween(Window.unboundedPreceding, 0)
    middle = (offset + F.sum("weight").over(line) - F.col("weight") / 2) / F.lit(max(total, 1))
    names, edge, case = list(shares), 0.0, None
    for name in names[:-1]:
        edge += shares[name]
        case = F.when(F.col("middle") < edge, name) if case is None else case.when(F.col("middle") < edge, name)
    case = case.otherwise(names[-1]) if case is not None else F.lit(names[-1])
    return ranged.withColumn("middle", middle).select("grp", "weight", case.alias("split"))


def grouped_split(rows: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, file, split, n_rows): every id as written and source file with its new split."""
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    groups = stage(record_groups(rows))
    splits = assign_splits(groups.groupBy("grp").agg(F.sum("n_rows").alias("weight")), shares)
    return groups.join(splits, "grp").select(F.col("member").alias("doc_id"), "file", "split", "n_rows")


__all__ = ["assign_splits", "contract", "found", "grouped_split", "id_key", "record_groups", "source_file"]
