"""Regions of interest: pixel sets, edges, annuli, crops, id hierarchies."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def boundary_edges(pixels: DataFrame) -> DataFrame:
    """roi_id, r0, c0, r1, c1: edges that one pixel only of the region has."""
    edge = lambda a, b, c, d: F.struct((F.col("row") + a).alias("r0"), (F.col("col") + b).alias("c0"), (F.col("row") + c).alias("r1"), (F.col("col") + d).alias("c1"))
    edges = pixels.select("roi_id", "row", "col").distinct().select("roi_id", F.explode(F.array(edge(0, 0, 0, 1), edge(1, 0, 1, 1), edge(0, 0, 1, 0), edge(0, 1, 1, 1))).alias("e"))
    return edges.groupBy("roi_id", "e").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("roi_id", "e.*")


def dilated(pixels: DataFrame, steps: int) -> DataFrame:
    """roi_id, row, col: pixels within steps moves to a side neighbour."""
    ball = [(r, c) for r in range(-steps, steps + 1) for c in range(-steps, steps + 1) if abs(r) + abs(c) <= steps]
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ball])
    return pixels.select("roi_id", "row", "col", F.explode(moves).alias("m")).select("roi_id", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col")).distinct()


def annuli(pixels: DataFrame, inner: int, outer: int, height: int, width: int, threshold: float = 0.0) -> DataFrame:
    """roi_id, row, col: the ring between inner and outer dilations, inside the image.

    Pixels of other regions go where the share that stays is at least the threshold. A negative
    inner radius switches rings off.
    """
    if inner < 0:
        return pixels.select("roi_id", "row", "col").limit(0)
    inside = (F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)
    ring = dilated(pixels, outer).where(inside).join(dilated(pixels, inner), ["roi_id", "row", "col"], "left_anti")
    taken = pixels.select("row", "col").distinct().withColumn("_t", F.lit(1))
    marked = ring.join(taken, ["row", "col"], "left")
    own = Window.partitionBy("roi_id")
    left = F.sum(F.when(F.col("_t").isNull(), 1).otherwise(0)).over(own) / F.count(F.lit(1)).over(own)
    return marked.withColumn("_left", left).where((F.col("_left") < threshold) | F.col("_t").isNull()).select("roi_id", "row", "col")


def crop_bounds(pixels: DataFrame, pad: int, height: int, width: int) -> DataFrame:
    """roi_id, row0, row1, col0, col1 (ends exclusive) around the pixels of each region, with a margin, inside the image."""
    return pixels.groupBy("roi_id").agg(
        F.greatest(F.min("row") - pad, F.lit(0)).alias("row0"), F.least(F.max("row") + 1 + pad, F.lit(height)).alias("row1"), F.greatest(F.min("col") - pad, F.lit(0)).alias("col0"), F.least(F.max("col") + 1 + pad, F.lit(width)).alias("col1")
    )


def linear_index(row, col, height: int):
    """1-based column-major index of a pixel."""
    return col * height + row + 1


def from_linear_index(rows: DataFrame, height: int) -> DataFrame:
    return rows.withColumn("col", F.expr(f"cast((idx - 1) div {height} AS int)")).withColumn("row", F.expr(f"cast((idx - 1) % {height} AS int)"))


def paint(pixels: DataFrame, values: DataFrame) -> DataFrame:
    """row, col, value: the value of each region on its pixels; of several, the region with the highest roi_ord."""
    return pixels.join(values, "roi_id").groupBy("row", "col").agg(F.max_by("value", "roi_ord").alias("value"))


def uniform_weights(pixels: DataFrame) -> DataFrame:
    """pixels with weight 1 / number of pixels of the region."""
    return pixels.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("roi_id")))


def touched_edges(before: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges after an exclusive or of two edge sets."""
    keys = ["roi_id", "r0", "c0", "r1", "c1"]
    return before.select(*keys).union(changed.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").drop("n")


def pixel_changes(committed: DataFrame, candidate: DataFrame) -> DataFrame:
    """roi_id, row, col, change: pixels that a candidate adds (1) or takes (-1)."""
    keys = ["roi_id", "row", "col"]
    added = candidate.select(*keys).join(committed, keys, "left_anti").withColumn("change", F.lit(1))
    return added.union(committed.select(*keys).join(candidate, keys, "left_anti").withColumn("change", F.lit(-1)))


# Ids: dotted paths.


def parts(column: str):
    return F.filter(F.split(column, r"\."), lambda p: p != "")


def id_columns(ids: DataFrame) -> DataFrame:
    """id with parts, depth and parent (NULL where the parent is no id of the table)."""
    split = ids.select("id").distinct().withColumn("parts", parts("id")).withColumn("depth", F.size("parts"))
    up = split.withColumn("_p", F.when(F.col("depth") > 1, F.array_join(F.slice("parts", 1, F.col("depth") - 1), ".")))
    known = split.select(F.array_join("parts", ".").alias("_k")).distinct()
    return up.join(known, up["_p"] == known["_k"], "left").select("id", "parts", "depth", F.col("_k").alias("parent"))


def ancestors(ids: DataFrame) -> DataFrame:
    """id, ancestor, distance: every strict prefix of an id that is an id of the table. Prefixes are exploded and joined, so no recursion is needed."""
    split = ids.select("id").distinct().withColumn("parts", parts("id"))
    prefixes = split.where(F.size("parts") > 1).select("id", F.size("parts").alias("d"), F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"), "parts")
    named = prefixes.select("id", (F.col("d") - F.col("k")).alias("distance"), F.array_join(F.slice("parts", F.lit(1), F.col("k")), ".").alias("ancestor"))
    return named.join(split.select(F.array_join("parts", ".").alias("ancestor")).distinct(), "ancestor").select("id", "ancestor", "distance")


def children(ids: DataFrame) -> DataFrame:
    """id, children: the ids whose parent it is, in order; an empty list for a leaf."""
    found = id_columns(ids)
    own = found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("_p")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    name = found.select("id", F.array_join("parts", ".").alias("_k"))
    return name.join(own, name["_k"] == own["_p"], "left").select("id", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def roots(ids: DataFrame) -> DataFrame:
    """id, root: the topmost of an unbroken line of parents above an id, itself where its parent is no id of the table."""
    known = id_columns(ids).select("id", F.array_join("parts", ".").alias("name"), F.size("parts").alias("depth"), F.col("parent").isNull().alias("top"))
    up = ancestors(ids).join(known.select(F.col("name").alias("ancestor"), "top", F.col("depth").alias("at")), "ancestor")
    # The root is the deepest ancestor (or self) without a parent: above it the line is broken.
    own = known.select("id", F.col("name").alias("ancestor"), "top", F.col("depth").alias("at"))
    all_up = up.select("id", "ancestor", "top", "at").unionByName(own).where("top")
    return all_up.groupBy("id").agg(F.max_by("ancestor", "at").alias("root"))


def subtrees(ids: DataFrame) -> DataFrame:
    """root (every id, by its name), id, place: the id and all below it through known parents, numbered from 0 in pre-order."""
    known = id_columns(ids).select("id", F.array_join("parts", ".").alias("name"), F.array_join("parts", "\x01").alias("path"))
    tops = roots(ids)
    below = ancestors(ids).select(F.col("ancestor").alias("root"), "id").union(known.select("name", "id"))
    # Where a parent between two ids is missing, their topmost ids differ.
    own = below.join(known.select("id", "path"), "id").join(tops.select("id", F.col("root").alias("top")), "id")
    named = known.join(tops, "id").select(F.col("name").alias("root"), tops["root"].alias("its_top"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("path")) - 1
    return own.join(named, "root").where("top = its_top").select("root", "id", place.alias("place"))


def topological(ids: DataFrame, ordered: DataFrame | None = None) -> DataFrame:
    """id, depth, label (indented), in pre-order by the column path; siblings by id, or by ord of ordered (id, ord) where that is given."""
    found = id_columns(ids)
    label = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.element_at("parts", -1))
    if ordered is None:
        path = F.transform("parts", lambda p: F.struct(F.lit(0).cast("bigint").alias("ord"), p.alias("part")))
        return found.select("id", "depth", label.alias("label"), path.alias("path")).orderBy("path")
    names = found.select("id", F.array_join("parts", ".").alias("name")).join(ordered.select("id", F.col("ord").cast("bigint").alias("ord")), "id").select("name", "ord")
    steps = found.select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice("parts", F.lit(1), k), "."))).alias("k", "name"))
    told = steps.join(names, "name", "left").select("id", "k", F.struct(F.coalesce("ord", F.lit(-1).cast("bigint")).alias("ord"), F.col("name").alias("part")).alias("step"))
    paths = told.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "step"))), lambda x: x["step"]).alias("path"))
    return found.join(paths, "id").select("id", "depth", label.alias("label"), "path").orderBy("path")


#: Kinds of region, in the order in which their prefixes are tried, and their short codes.
KINDS = (("soma", "s"), ("branch", "b"), ("unk", "u"), ("s", "s"), ("b", "b"), ("u", "u"))


def process_ids(ids: DataFrame) -> DataFrame:
    """id, kind, short, long: the kind is that of the last prefix that fits the last part; numbers alone are left of the parts."""
    split = ids.select("id", parts("id").alias("p"))
    last = F.element_at("p", -1)
    full = {"s": "soma", "b": "branch", "u": "unk"}
    kind = F.lit("unk")
    for prefix, code in KINDS:
        kind = F.when(F.startswith(last, F.lit(prefix)), full[code]).otherwise(kind)
    bare = F.transform("p", lambda x: F.regexp_replace(x, r"^(soma|branch|unk|s|b|u)(?=[0-9]|$)", ""))
    known = split.withColumn("kind", kind).withColumn("bare", bare)
    stem = F.array_join(F.slice("bare", F.lit(1), F.size("bare") - 1), ".")
    joined = lambda tag: F.concat_ws(".", F.when(F.size("bare") > 1, stem), F.concat(tag, F.element_at("bare", -1)))
    return known.select("id", "kind", joined(F.substring("kind", 1, 1)).alias("short"), joined(F.col("kind")).alias("long"))


def color_cycle(ids: DataFrame, n_colors: int) -> DataFrame:
    """id, color: the place among siblings plus the depth, so that a child differs from its parent; siblings cycle."""
    found = id_columns(ids)
    place = F.row_number().over(Window.partitionBy("parent").orderBy("id")) - 1
    raw = found.select("id", "parent", (place % (n_colors - 1)).alias("k"))
    # A colour is the sum of the steps 1 + k along the path, so that it is never the parent's.
    up = ancestors(ids).select(F.col("id").alias("_i"), "ancestor")
    above = up.join(raw.select(F.col("id").alias("ancestor"), F.col("k").alias("_k")), "ancestor").groupBy("_i").agg(F.sum(F.col("_k") + 1).alias("s"))
    return raw.join(above, raw["id"] == above["_i"], "left").select("id", ((F.col("k") + 1 + F.coalesce("s", F.lit(0))) % n_colors).cast("int").alias("color"))


def recursive_closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """root, node, depth of every tree of edges (parent, child), by a recursive common table expression.

    spark.sql.cteRecursionRowLimit bounds what it may make; ancestors() does the same for dotted ids without a limit.
    """
    view = f"edges_{uuid.uuid4().hex}"  # a name of its own, so that no view of the caller's is touched
    edges.createOrReplaceTempView(view)
    return spark.sql(
        f"WITH RECURSIVE tree(root, node, depth) AS (SELECT parent, child, 1 FROM {view} UNION ALL SELECT t.root, e.child, t.depth + 1 FROM tree t JOIN {view} e ON e.parent = t.node) SELECT root, node, depth FROM tree"
    )
