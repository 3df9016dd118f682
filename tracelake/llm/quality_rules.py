"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets counts (words, characters, symbols, repeated lines and
words) and from them five integer ratios. Counts that most documents lack are
taken as (count + 1) / (words + 1), so that a group in which they are rare still has a
spread: that of its documents' lengths. Per (lang, source) every ratio has a quantile
sketch: a histogram over buckets with 7 significant bits, so a quantile is within
1/64 of the true value. Sketches merge by adding counts; groups of fewer than
``min_docs`` documents take the sketch merged over their language, and small languages
the one merged over everything. A fence lies ``WIDTH`` times as far from the median as
the outer quantile (5 or 95 of 100) does; all of it comes from the sketch, and no
constant stands in where a group is uniform. The joined filter drops documents beyond
the fences. All arithmetic is on integers, so results do not depend on partitioning.

Fences are one row per (lang, source). They are counted and broadcast up to
``BROADCAST_ROWS``; beyond that, documents of a group are spread over ``SALTS`` keys, so
one language and source is never one task.

Defined results: null or blank text has no words and fails the base rule. A
null lang or source is a group of its own. Equal rows get equal verdicts. A value on
a fence is let through. A text of any length is counted whole. An empty table gives an
empty result. Extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import text_or_empty, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Ratio, its integer form, and whether low values are outliers too.
RATIOS = (
    ("mean_word", "100 * word_chars div n_words", True),
    ("symbols", "10000 * (n_symbols + 1) div (n_words + 1)", False),
    ("shouts", "10000 * (n_shouts + 1) div (n_words + 1)", False),
    ("dup_lines", "10000 * (n_dup_lines + 1) div (n_words + 1)", False),
    ("repeats", "10000 * (n_repeat_words + 1) div (n_words + 1)", False),
)
#: Outer quantiles in hundredths, and how many times their distance from the median is let through.
OUTER, WIDTH = 5, 3
MIN_DOCS = 200
BROADCAST_ROWS = 100_000
SALTS = 64


def _without(text: str, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(F.col(text), chars, ""))


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep and the counts of each text, in one pass and without a shuffle."""
    word = ", ".join(f"get(_w, i + {k})" for k in range(8))
    spaced = docs.select(*keep, text_or_empty().alias("_t"))
    split = spaced.select(
        *keep,
        "_t",
        F.trim(F.col("_t"), F.lit(SPACES)).alias("_trim"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0).alias("_lines"),
    ).select(
        *keep,
        "_t",
        "_lines",
        F.when(F.length("_trim") == 0, F.array().cast("array<string>")).otherwise(F.split("_trim", r"[\x20\x09-\x0D]+")).alias("_w"),
    )
    grams = split.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - _without("_t", SPACES)).cast("long").alias("word_chars"),
        _without("_t", SYMBOLS).cast("long").alias("n_symbols"),
        _without("_t", "!").cast("long").alias("n_shouts"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(_w) < 9 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size(_w) - 8), i -> xxhash64({word})) END").alias("_g"),
    )
    # Only texts with an equal pair of windows need the sorted form.
    ordered = grams.withColumn(
        "_s",
        F.expr("CASE WHEN size(array_distinct(_g)) = size(_g) THEN NULL ELSE sort_array(transform(_g, (h, i) -> struct(h, i))) END"),
    ).drop("_g")
    starts = ordered.withColumn(
        "_p",
        F.expr(
            "sort_array(transform(filter(sequence(0, size(_s) - 1), k -> coalesce(get(_s, k - 1).h = get(_s, k).h, false)"
            " OR coalesce(get(_s, k + 1).h = get(_s, k).h, false)), k -> get(_s, k).i))"
        ),
    ).drop("_s")
    return starts.withColumn(
        "n_repeat_words",
        F.expr("CASE WHEN _p IS NULL THEN 0L ELSE aggregate(sequence(0, size(_p) - 1), 0L, (a, k) -> a + CASE WHEN k = 0 THEN 8 ELSE least(8, get(_p, k) - get(_p, k - 1)) END) END"),
    ).drop("_p")


def sketches(ratios: DataFrame) -> DataFrame:
    """Bucket counts by (_lang, _source), by _lang and over all; level tells which."""
    cells = ratios.select("_lang", "_source", F.explode(F.array(*[F.struct(F.lit(n).alias("ratio"), F.col(n).alias("v")) for n, *_ in RATIOS])).alias("_e")).select(
        "_lang", "_source", "_e.ratio", "_e.v"
    )
    cells = cells.where("v IS NOT NULL").withColumn("bucket", F.expr("shiftleft(shiftright(v, greatest(0, length(bin(v)) - 7)), greatest(0, length(bin(v)) - 7))"))
    fine = cells.groupBy("_lang", "_source", "ratio", "bucket").agg(F.count("*").alias("n"))
    whole = fine.withColumn("level", F.lit(0))
    by_lang = fine.groupBy("_lang", "ratio", "bucket").agg(F.sum("n").alias("n")).selectExpr("_lang", "cast(NULL AS string) _source", "ratio", "bucket", "n", "1 level")
    over_all = fine.groupBy("ratio", "bucket").agg(F.sum("n").alias("n")).selectExpr("cast(NULL AS string) _lang", "cast(NULL AS string) _source", "ratio", "bucket", "n", "2 level")
    return whole.unionByName(by_lang).unionByName(over_all)


def fences(sketch: DataFrame) -> DataFrame:
    """Per group and ratio: number of documents, and lowest and highest value let through."""
    low_too = F.create_map(*[F.lit(x) for n, _, both in RATIOS for x in (n, both)])
    at = "PARTITION BY level, _lang, _source, ratio"
    quantile = lambda percent: F.min(F.expr(f"CASE WHEN 100 * below >= {percent} * total THEN bucket END"))
    found = (
        sketch.selectExpr("*", f"sum(n) OVER ({at} ORDER BY bucket) below", f"sum(n) OVER ({at}) total")
        .groupBy("level", "_lang", "_source", "ratio")
        .agg(F.max("total").alias("total"), quantile(OUTER).alias("least"), quantile(50).alias("mid"), quantile(100 - OUTER).alias("most"))
        # The last value of a bucket: those of one bucket are not told apart.
        .withColumn("top", F.expr("most + shiftleft(1L, greatest(0, length(bin(most)) - 7)) - 1"))
    )
    low = F.when(low_too[F.col("ratio")], F.expr(f"mid - {WIDTH} * (mid - least)")).otherwise(F.lit(-1))
    return found.select("level", "_lang", "_source", "ratio", "total", low.alias("low"), F.expr(f"mid + {WIDTH} * (top - mid)").alias("high"))


def thresholds(ratios: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (_lang, _source): a map from ratio to its (low, high)."""
    found = fences(sketches(ratios))
    own = found.where("level = 0").select("_lang", "_source", "ratio", "total", "low", "high")
    lang = found.where("level = 1").select("_lang", "ratio", F.col("total").alias("total1"), F.col("low").alias("low1"), F.col("high").alias("high1"))
    over = found.where("level = 2").select("ratio", F.col("low").alias("low2"), F.col("high").alias("high2"))
    picked = own.join(lang, ["_lang", "ratio"]).join(over, ["ratio"])
    choose = lambda a: F.expr(f"CASE WHEN total >= {min_docs} THEN {a} WHEN total1 >= {min_docs} THEN {a}1 ELSE {a}2 END")
    return picked.groupBy("_lang", "_source").agg(F.map_from_entries(F.collect_list(F.struct("ratio", F.struct(choose("low").alias("low"), choose("high").alias("high"))))).alias("_fence"))


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, the counts, base_failed, outlier (names of the ratios beyond their fences) and kept."""
    named = docs.select("doc_id", F.coalesce("lang", F.lit("\x00")).alias("_lang"), F.coalesce("source", F.lit("\x00")).alias("_source"), "text")
    measured = written(counts(named, "doc_id", "_lang", "_source"), "quality")
    ratios = measured.selectExpr("*", *[f"CASE WHEN n_words > 0 THEN {e} END AS {n}" for n, e, *_ in RATIOS])
    told = written(thresholds(ratios, min_docs), "fences")
    if told.count() <= broadcast_rows:
        judged = ratios.join(F.broadcast(told), ["_lang", "_source"], "left")
    else:
        salted = told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = ratios.withColumn("_salt", F.pmod(F.hash("doc_id", "n_words", "word_chars"), F.lit(SALTS))).join(salted, ["_lang", "_source", "_salt"], "left")
    out = F.filter(F.array(*[F.when((F.col(n) < F.col("_fence")[n]["low"]) | (F.col(n) > F.col("_fence")[n]["high"]), F.lit(n)) for n, *_ in RATIOS]), lambda x: x.isNotNull())
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.array_join(out, ",").alias("outlier"), (~failed & (F.size(out) == 0)).alias("kept")
    )
