"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised to words and cut into windows of ten words; an item of
fewer words is one window. The automaton over all windows passes each normalised
text once. Hits are counted in words and mapped back to offsets in the original.

The windows are counted before they are sent to the executors. Beyond
``max_windows`` of them or ``MAX_CHARS`` characters, where one automaton would no longer
fit beside each task, the windows of the texts meet those of the items in a join
instead: also one pass over the texts, with the same results. A bitmap of fixed size
holds back all but a few of the windows that cannot match.

Defined results: a null or empty text has no words and no hits; a null item text
has no windows. Items with equal windows all count; the windows of an item with a
null item_id hit and name no item. Equal rows give equal results. An empty table gives
an empty result, an empty benchmark no hits. Texts of any length are whole. Input
columns named n_words, hit_runs, hit_spans, items or n_hit give way to the
results; all other columns are passed through under any name.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tracelake.llm.common import map_texts, quoted, spread_join, without, written
from tracelake.llm.words import WORD_IN_TEXT, normal_words, raw_texts

WINDOW = 10
MAX_WINDOWS = 50_000
MAX_CHARS = 4_000_000
#: Bits of the bitmap, and of each part of it that one row holds.
BITS, PART = 1 << 27, 1 << 16
CUT = 100_000  # windows in a batch, about
RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def item_windows(items: DataFrame, texts: tuple[str, ...] = ("text",), window: int = WINDOW) -> DataFrame:
    """(win, item_id) of every test item, over all its texts, each pair once."""

    def run(batches):
        for batch in batches:
            wins, ids = [], []
            for name in texts:
                for raw, item in zip(raw_texts(batch, name), batch.column(0).to_pylist(), strict=True):
                    words = normal_words(raw)
                    for k in range(max(1, len(words) - window + 1) if words else 0):
                        wins.append(b" ".join(words[k : k + window]).decode())
                        ids.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(wins, pa.string()), pa.array(ids, pa.int64())], ["win", "item_id"])

    return items.select("item_id", *texts).mapInArrow(run, "win string, item_id bigint").distinct()


def automaton(rows):
    by_window = defaultdict(list)
    for win, item in rows:
        by_window[win].append(item)
    found = ahocorasick.Automaton()
    for win, ids in by_window.items():
        found.add_word(f" {win} ", (win.count(" ") + 1, tuple(ids)))
    if by_window:
        found.make_automaton()
    return found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals of words, ends exclusive, overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(raw: bytes, machine) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, hit intervals of words, items hit."""
    words = normal_words(raw)
    if not words or not len(machine):
        return len(words), [], set()
    normal = f" {b' '.join(words).decode()} "
    runs, ids, seen, at = [], set(), 0, 0
    for end, (length, items) in machine.iter(normal):
        seen, at = seen + normal.count(" ", at, end), end
        runs.append((seen - length, seen))
        ids.update(items)
    return len(words), merged(runs), ids


def spans_in_text(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The intervals of words as code points of the original text."""
    at = [m.span() for m in WORD_IN_TEXT.finditer(raw.decode())]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


RESULTS = StructType([
    StructField("n_words", LongType()),
    StructField("hit_runs", ArrayType(StructType([StructField("first", LongType()), StructField("last", LongType())]))),
    StructField("hit_spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
    StructField("items", ArrayType(LongType())),
    StructField("n_hit", LongType()),
])


def results(texts: list[bytes], counts: list[int], hits: list[list[tuple[int, int]]], items: list[list[int]]) -> list[pa.Array]:
    """The columns of RESULTS for texts with these word counts, hit intervals and items."""
    spans = [[{"start": a, "end": b} for a, b in spans_in_text(raw, hit)] if hit else [] for raw, hit in zip(texts, hits, strict=True)]
    return [
        pa.array(counts, pa.int64()),
        pa.array([[{"first": a, "last": b} for a, b in hit] for hit in hits], RUNS),
        pa.array(spans, SPANS),
        pa.array(items, pa.list_(pa.int64())),
        pa.array([sum(b - a for a, b in hit) for hit in hits], pa.int64()),
    ]


def by_automaton(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """docs with RESULTS, by one automaton of bounded size."""
    machine = docs.sparkSession.sparkContext.broadcast(automaton(windows.collect()))

    def find(texts):
        counts, hits, ids = zip(*(scan(raw, machine.value) for raw in texts), strict=True) if texts else ([], [], [])
        return results(texts, list(counts), list(hits), [sorted(x for x in got if x is not None) for got in ids])

    return map_texts(docs, RESULTS, lambda: find)


def bitmap(windows: DataFrame) -> np.ndarray:
    """BITS bits, those set that the hash of a window names; packed on the executors, so at most BITS / 8 bytes reach the driver."""

    def pack(batches):
        for batch in batches:
            packed = []
            for bits in batch.column(1).to_pylist():
                part = np.zeros(PART, bool)
                part[bits] = True
                packed.append(np.packbits(part).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["part", "bits"])

    bit = F.pmod(F.xxhash64("win"), F.lit(BITS))
    parts = windows.select(F.expr("pmod(xxhash64(win), %d) div %d" % (BITS, PART)).alias("part"), (bit % PART).alias("bit")).groupBy("part").agg(F.collect_set("bit").alias("bits"))
    out = np.zeros((BITS // PART, PART // 8), np.uint8)
    for part, bits in parts.mapInArrow(pack, "part bigint, bits binary").collect():
        out[part] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def by_join(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """docs with RESULTS, by a join of windows: for benchmarks of any size."""
    spark = docs.sparkSession
    keyed = written(docs.select(F.monotonically_increasing_id().alias("id"), "text", F.struct(*[quoted(c) for c in docs.columns]).alias("row")), "texts")
    words = F.size(F.split("win", " "))
    lengths = sorted(r[0] for r in windows.select(words.alias("n")).distinct().collect())  # one to WINDOW
    bits = spark.sparkContext.broadcast(bitmap(windows))

    def cut(batches):
        for batch in batches:
            ids, starts, wins = [], [], []
            for key, raw in zip(batch.column(0).to_pylist(), raw_texts(batch, 1), strict=True):
                told = normal_words(raw)
                for n in lengths:
                    for k in range(len(told) - n + 1):
                        ids.append(key)
                        starts.append(k)
                        wins.append(b" ".join(told[k : k + n]))
                    if len(ids) >= CUT:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(wins, pa.binary()).cast(pa.string())], ["id", "start", "win"])
                        ids, starts, wins = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(wins, pa.binary()).cast(pa.string())], ["id", "start", "win"])

    def may(batches):
        for batch in batches:
            at = batch.column(3).to_numpy()
            yield batch.filter(pa.array((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)).select([0, 1, 2])

    cuts = keyed.select("id", "text").mapInArrow(cut, "id bigint, start bigint, win string").withColumn("bit", F.pmod(F.xxhash64("win"), F.lit(BITS)))
    near = written(cuts.mapInArrow(may, "id bigint, start bigint, win string"), "near")
    known = near.groupBy("win").agg(F.count("*").alias("rows")).join(windows.select("win").distinct(), "win").withColumn("n", words)
    hits = written(spread_join(near, known, "win", "rows", near.count()), "hits")
    runs = hits.groupBy("id").agg(F.collect_list(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("n")).alias("last"))).alias("runs"))
    named = hits.select("id", "win").distinct().join(windows, "win").where("item_id IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    joined = keyed.join(runs, "id", "left").join(named, "id", "left").select("row", "text", "runs", "ids")
    row = joined.schema["row"]

    def finish(batches):
        for batch in batches:
            texts = raw_texts(batch, 1)
            found = [merged([(x["first"], x["last"]) for x in hit or ()]) for hit in batch.column(2).to_pylist()]
            columns = results(texts, [len(normal_words(raw)) for raw in texts], found, [x or [] for x in batch.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", *RESULTS.names])

    done = joined.mapInArrow(finish, StructType([row, *RESULTS.fields]))
    return done.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *RESULTS.names)


def decontaminate(docs: DataFrame, items: DataFrame, texts: tuple[str, ...] = ("text",), max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs with n_words, hit_runs (in words), hit_spans (in code points), items (hit, sorted) and n_hit."""
    windows = written(item_windows(items, texts), "windows")
    count, chars = windows.agg(F.count("*"), F.coalesce(F.sum(F.length("win")), F.lit(0))).first()
    scanned = by_automaton if count <= max_windows and chars <= MAX_CHARS else by_join
    return scanned(without(docs, *RESULTS.names), windows)
