"""Removal of repeated passages of three lines or more, in DataFrame functions only.

A window is three consecutive lines of one text that are not all blank. Windows
are compared by a 128-bit hash over the whole table; the first occurrence of
each, by (doc_id, text hash, line), stays and every line that a later one
covers is removed, overlapping occurrences together.

A window that a third of all documents hold costs no large group: its first
occurrence is found by a partial aggregate, and joining it back is an
equi-join that adaptive execution can split.

Defined results: a null text stays null, with 0 lines. Texts of fewer than three
lines never change. Rows equal in doc_id and text are one document and change
alike. A null doc_id comes after all others. Texts of any length are whole. An
empty table gives an empty result. Other columns of the input are passed
through under any name; input columns named n_lines or n_removed give way to the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import quoted, without


def later_windows(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and starts: where windows begin that occur earlier too."""
    lines = docs.where("instr(text, '\n') > 0").select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("l"))
    windows = (
        lines.where("size(l) > 2")
        .select(
            "doc_id",
            "th",
            F.explode(
                F.expr(
                    "filter(transform(sequence(0, size(l) - 3), i -> CASE WHEN trim(concat(get(l, i), get(l, i + 1), get(l, i + 2))) <> '' THEN"
                    " struct(i, xxhash64(get(l, i), get(l, i + 1), get(l, i + 2)) AS h1, xxhash64(0, get(l, i + 2), get(l, i), get(l, i + 1)) AS h2) END), x -> x IS NOT NULL)"
                )
            ).alias("x"),
        )
        .select("doc_id", "th", "x.*")
    )
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th", "i")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(first, ["h1", "h2"]).where(place != F.col("first")).groupBy("doc_id", "th").agg(F.collect_set("i").alias("starts"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs with repeated lines taken out of text, and n_lines and n_removed."""
    kept = without(docs, "n_lines", "n_removed")
    # All columns but text travel in one struct, beside which no internal name can clash.
    rest = F.struct(*[quoted(c) for c in kept.columns if c.lower() != "text"])
    keyed = kept.select("doc_id", "text", rest.alias("row"), F.xxhash64("text").alias("th"))
    starts = later_windows(keyed).select(F.col("doc_id").alias("id"), F.col("th").alias("key"), "starts")
    joined = keyed.join(starts, keyed["doc_id"].eqNullSafe(starts["id"]) & (keyed["th"] == starts["key"]), "left").select("row", "text", "starts")
    counted = joined.withColumn("l", F.split("text", "\n")).withColumn(
        "kept", F.expr("CASE WHEN starts IS NOT NULL THEN array_except(sequence(0, size(l) - 1), flatten(transform(starts, p -> array(p, p + 1, p + 2)))) END")
    )
    text = F.expr("CASE WHEN kept IS NULL THEN text ELSE array_join(transform(kept, i -> get(l, i)), '\n') END")
    return counted.select(
        *[text.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in kept.columns],
        F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size("l") - F.size("kept")).cast("long").alias("n_removed"),
    )
