"""Best-fit packing into bins of several permitted lengths.

Documents become pieces no longer than the largest permitted length. Pieces are
dealt to shards by a hash of their row number, about ``per_shard`` to each whatever
the rows hold, and every shard packs its own: longest first, each into the open bin
that it leaves fullest. Where none has room, the size opens whose cost per expected
token is least; how full bins are expected to get is a guess, so each shard packs
under several guesses and keeps the cheapest result. Finally each bin shrinks to the
smallest permitted length that holds its contents. Shards grow in number with the
input, not in size.

Lengths count UTF-8 bytes and one end mark, as a byte-level model does, unless a
length column is named; token_lengths makes one from a vocabulary file.

Defined results: a null text is empty and takes one unit. A null or negative
length counts as 0. A text of any length becomes as many pieces as it needs. Rows
that are equal are packed one by one; pieces of equal length go by doc_id (null
first), then by their place in the document. A null doc_id stays null in doc_ids and pieces.
An empty table gives no bins. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracelake.llm.common import map_texts, text_or_empty, without, written

SIZES = (1024, 2048, 4096, 8192)
PER_SHARD = 20_000
GUESSES = (0.0, 0.5, 0.8, 0.95, 1.0)
#: Cost of a bin: its length, a fixed part, and attention, which grows with the square.
FIXED, SQUARE = 64.0, 1 / 16384

BINS = pa.schema([
    ("bin_id", pa.string()),
    ("capacity", pa.int32()),
    ("used", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())),
    ("pieces", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("at", pa.int32())]))),
])


def cost(size: int) -> float:
    return size + FIXED + SQUARE * size * size


def pack(lengths: list[int], sizes: tuple[int, ...], guess: float) -> list[tuple[int, list[int]]]:
    """Bins as (used, indices of lengths), for lengths in falling order."""
    opening = {}
    rooms: list[tuple[int, int]] = []  # of open bins: room, bin
    bins: list[tuple[int, list[int]]] = []
    for k, n in enumerate(lengths):
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
            bins[b] = (bins[b][0] + n, bins[b][1])
            bins[b][1].append(k)
        else:
            if n not in opening:
                opening[n] = min((s for s in sizes if s >= n), key=lambda s: (cost(s) / max(1.0, n + guess * (s - n)), s))
            room, b = opening[n], len(bins)
            bins.append((n, [k]))
        if room > n:
            insort(rooms, (room - n, b))
    return bins


def shrunk(used: int, sizes: tuple[int, ...]) -> int:
    return next(s for s in sizes if s >= used)


def best_pack(lengths: list[int], sizes: tuple[int, ...]) -> list[tuple[int, list[int]]]:
    """The cheapest packing over all guesses, after shrinking."""
    return min((pack(lengths, sizes, g) for g in GUESSES), key=lambda bins: sum(cost(shrunk(used, sizes)) for used, _ in bins))


def token_lengths(docs: DataFrame, vocabulary: str, column: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text and one end mark, by a tokenizer file that the driver can open.

    The file's text travels with the tasks: its size is that of a vocabulary, whatever the corpus.
    """
    with open(vocabulary, encoding="utf-8") as file:
        told = docs.sparkSession.sparkContext.broadcast(file.read())

    def start():
        from tokenizers import Tokenizer

        coder = Tokenizer.from_str(told.value)
        coder.encode_special_tokens = True  # their strings are ordinary text here
        return lambda texts: [pa.array([len(x.ids) + 1 for x in coder.encode_batch([t.decode() for t in texts], add_special_tokens=False)], pa.int64())]

    return map_texts(without(docs, column), StructType([StructField(column, LongType())]), start)


def best_fit_packing(docs: DataFrame, sizes: tuple[int, ...] = SIZES, length: str | None = None, per_shard: int = PER_SHARD) -> DataFrame:
    """One row per bin: bin_id, capacity, used, doc_ids, and pieces (doc_id, start in the document, size, at: place in the bin)."""
    sizes = tuple(sorted(sizes))
    most = sizes[-1]
    own = F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)) if length else F.octet_length(text_or_empty()) + 1
    # The row number is stored with its row, so that a task that is run again deals alike.
    lengths = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), own.cast("bigint").alias("n"), F.monotonically_increasing_id().alias("row")), "lengths")
    count = lengths.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / most)))).first()[0] or 0
    shards = max(1, -(-int(count) // per_shard))
    pieces = lengths.select("doc_id", "n", "row", F.explode(F.expr(f"sequence(0L, greatest(0L, (n - 1) div {most}))")).alias("k")).select(
        F.pmod(F.xxhash64("row", "k"), F.lit(shards)).cast("int").alias("shard"),
        "doc_id",
        (F.col("k") * most).alias("start"),
        F.least(F.lit(most), F.expr(f"n - k * {most}")).cast("int").alias("size"),
    )
    ordered = pieces.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("size"), "doc_id", "start")

    def run(batches):
        def packed(shard, rows):
            out = []
            for b, (used, members) in enumerate(best_pack([r[2] for r in rows], sizes)):
                at, put = 0, []
                for k in members:
                    doc, start, size = rows[k]
                    put.append({"doc_id": doc, "start": start, "size": size, "at": at})
                    at += size
                out.append((f"{shard}-{b}", shrunk(used, sizes), used, [x["doc_id"] for x in put], put))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), BINS, strict=True)], schema=BINS)

        held, shard = [], None
        for batch in batches:
            for s, doc, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if held:
                        yield packed(shard, held)
                    shard, held = s, []
                held.append((doc, start, size))
        if held:
            yield packed(shard, held)

    return ordered.mapInArrow(run, "bin_id string, capacity int, used int, doc_ids array<bigint>, pieces array<struct<doc_id:bigint,start:bigint,size:int,at:int>>")
