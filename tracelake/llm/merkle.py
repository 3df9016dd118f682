"""A Merkle manifest of a dataset: a tree per language, a tree of their roots, and a proof of every row.

1. A row is a leaf: the SHA-256 of its framed fields. Leaves are put in order by
   language and doc_id in ranges, so a language that holds most rows is many tasks;
   a row's place in its language is its place in the range and what stands before it.
2. Slot pivot: the children of a node are spread into FANOUT columns by conditional
   aggregates. All columns joined and hashed are the node; all but a child's own column,
   in two halves, are that child's siblings.
3. From the top downwards each level takes the siblings that its parents have gathered
   and puts its own in front. Tables shrink eightfold by level, so this costs little more
   than the last level, where the rows of the dataset are.

Columns beside the five named fields are ignored, whatever their names. Defined results:
a null field is framed as ``-`` and thus differs from an empty one. Null languages form
a group of their own, the first. Rows without a doc_id come first in their language. Rows
of one doc_id are ordered by their leaves; equal rows have equal leaves, each with a place of
its own. Texts of any length are hashed whole. An empty table has no root and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**other: Column) -> Column:
    """The leaf of a row, some of its fields replaced."""
    return F.sha2(F.concat(*[framed(other.get(f, F.col(f))) for f in FIELDS]), 256)


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with ``place``, their number from 0 in their group by order, and ``n``, the rows of the group.

    Rows are dealt to ranges of (group, order). Equal rows may stand in any order; what tells
    them apart is where they stand in the written table, so they are dealt to several ranges too.
    """
    keys = [*group, *order]
    source = rows.withColumn("_copy", F.monotonically_increasing_id())
    sorted_rows = source.repartitionByRange(*[F.col(k).asc_nulls_first() for k in [*keys, "_copy"]]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in [*keys, "_copy"]]).drop("_copy")
    numbered = written(sorted_rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "places")
    # One row for each range and group in it.
    runs = numbered.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    by = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_run"), "_first", before.alias("_before"), F.sum("_rows").over(by).alias("n"))
    same = F.col("_part") == F.col("_run")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return numbered.join(runs, same).select(*rows.columns, place.alias("place"), "n")


def slots(nodes: DataFrame, group: list[str], child: Column) -> DataFrame:
    """group, place, n, s0..s7: the parents of nodes, their children spread into columns."""
    own = F.col("place") % FANOUT
    columns = [F.max(F.when(own == i, child)).alias(f"s{i}") for i in range(FANOUT)]
    return nodes.groupBy(*group, F.floor(F.col("place") / FANOUT).alias("place"), F.ceil(F.col("n") / FANOUT).alias("n")).agg(*columns)


def joined_slots(digest: str, slots_: range = range(FANOUT)) -> Column:
    """The digests of some slots, joined; a missing child adds nothing."""
    return F.concat_ws("", *[F.col(f"s{i}{digest}") for i in slots_]) if len(slots_) else F.lit("")


def children(parents: DataFrame, group: list[str], digest: str, told: list[str]) -> DataFrame:
    """The children of parents that have their ``path``: group, place, child, path and the columns ``told``.

    path lists, from a node upwards, what stands before and behind it among its parent's children.
    """
    one = lambda i: F.struct(
        (F.col("place") * FANOUT + i).alias("place"),
        F.col(f"s{i}").alias("child"),
        F.array_insert("path", 1, F.struct(joined_slots(digest, range(i)).alias("before"), joined_slots(digest, range(i + 1, FANOUT)).alias("behind"))).alias("path"),
    )
    spread = parents.select(*group, *told, F.explode(F.array(*map(one, range(FANOUT)))).alias("x"))
    return spread.select(*group, "x.place", "x.child", "x.path", *told).where("child IS NOT NULL")


def grown(first: DataFrame, group: list[str], digest: str) -> list[DataFrame]:
    """Levels above: the parents of ``first`` (its parents, pivoted) up to a single node for each group.

    Each is a written table with ``digest`` of the node; only the greatest count of a level reaches the driver.
    """
    levels = [written(first.withColumn("digest", F.sha2(joined_slots(digest), 256)), "level")]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        above = slots(levels[-1].where("n > 1"), group, F.col("digest"))
        levels.append(written(above.withColumn("digest", F.sha2(joined_slots(""), 256)), "level"))
    return levels


def same_group(group: list[str], with_place: bool = False) -> Column:
    found = F.lit(True)
    for g in group:
        found &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    return found & (F.col("place") == F.col("_place")) if with_place else found


def with_paths(levels: list[DataFrame], group: list[str], tops: DataFrame, told: list[str]) -> DataFrame:
    """The lowest level with the paths of its nodes.

    tops: of each group, the path of its single node and the columns ``told``, which all nodes below it get.
    """
    named, more = [F.col(g).alias(f"_{g}") for g in group], ["path", *told]
    found = None
    for level in reversed(levels):
        above = None if found is None else children(found, group, "", told)
        found = level.where("n = 1").join(tops.select(*named, *more), same_group(group)).select(*level.columns, *more)
        if above is not None:
            parents = above.select(*named, F.col("place").alias("_place"), *more)
            found = found.unionByName(level.where("n > 1").join(parents, same_group(group, with_place=True)).select(*level.columns, *more))
    return found


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs.

    doc_id, leaf, subroot (of its language), root, path (array of before and behind, from the leaf to the
    root), other_leaf: the leaf with the fields of ``tampered`` in place of its own.
    """
    tampered = tampered or {}
    other = leaf_of(**tampered) if tampered else F.col("leaf")
    rows = docs.select(*FIELDS).withColumn("leaf", leaf_of()).withColumn("other", other)
    rows = rows.select("lang", "doc_id", "leaf", F.when(F.col("other") != F.col("leaf"), F.col("other")).alias("other"))
    leaves = placed(written(rows, "leaves"), ["lang"], ["doc_id", "leaf"])
    lone = leaves.where("n = 1")  # the subroot of its language
    child = F.struct("leaf", "doc_id", "other")
    levels = grown(slots(leaves.where("n > 1"), ["lang"], child), ["lang"], ".leaf")
    subroots = lone.select("lang", F.col("leaf").alias("digest"))
    for level in levels:
        subroots = subroots.unionByName(level.where("n = 1").select("lang", "digest"))

    named = placed(written(subroots.withColumn("set", F.lit(0)), "subroots"), ["set"], ["lang"])
    child = F.struct(F.col("digest").alias("leaf"), "lang")
    above = grown(slots(named.where("n > 1"), ["set"], child), ["set"], ".leaf")
    no_path = F.array().cast("array<struct<before:string,behind:string>>").alias("path")
    top = above[-1].where("n = 1").select("set", no_path, F.col("digest").alias("root"))
    found = children(with_paths(above, ["set"], top, ["root"]), ["set"], ".leaf", ["root"])
    found = found.select("child.lang", "path", F.col("child.leaf").alias("subroot"), "root")
    alone = named.where("n = 1").select("lang", no_path, F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    langs, told = written(found.unionByName(alone), "langs"), ["subroot", "root"]

    leafy = children(with_paths(levels, ["lang"], langs, told), ["lang"], ".leaf", told).select("child.*", "path", *told)
    alike = langs.select(F.col("lang").alias("_lang"), "path", *told)
    lonely = lone.join(alike, same_group(["lang"])).select("leaf", "doc_id", "other", "path", *told)
    return leafy.unionByName(lonely).select("doc_id", "leaf", F.coalesce("other", "leaf").alias("other_leaf"), *told, "path")


def folded(leaf: str, path: str = "path") -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, F.col(leaf), lambda node, p: F.sha2(F.concat(p["before"], node, p["behind"]), 256))


def proof(path: str = "path") -> Column:
    """The siblings of a path, level by level."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["behind"])), "")


def lowered(text: str = "text") -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)
