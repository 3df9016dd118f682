"""Exact removal of repeated substrings, with a difference cover and suffix buckets.

Every start of a 200-byte string is a suffix; strings that occur twice are ties at
that depth. Only equality matters, so suffixes are ordered by a 96-bit fingerprint of
their first 200 bytes, two polynomials with unrelated bases and byte values, and not
alphabetically: the bytes of all suffixes would be many times the input. The high
bits name the suffix bucket.

Cover sample. Positions whose residue modulo V = 133 lies in a perfect difference set
of 12 are sampled, 9 % of all. For any two positions some offset below V leads both
into the sample. So suffixes that tie over 200 bytes have sampled suffixes that tie
over 200 - (V - 1) = 68 bytes within them. Ties of the sample at that depth are found first,
one bucket at a time; a suffix none of whose samples ties cannot tie, and is never
shuffled. A false tie of the sample only adds a suffix.

Suffix buckets. The suffixes left are dealt to buckets and each bucket is sorted by
itself, in one task's memory, at full depth. Buckets grow in number with the input. What
returns to a block of texts is a bit for each of its distinct suffixes.

Texts are packed once into compressed blocks, in a table bucketed by block, whose buckets
also grow in number with the input, so that the rounds (copies of whole texts, sample
ties, suffix buckets) join their answers without moving a text. Only the first of equal
texts takes part in the later rounds: in all of them every byte is repeated. A string
that a third of all texts hold is one entry per block.

Defined results: a null text is empty; texts under 200 bytes keep all. A text of any
length is whole, in a block of its own if it is long. Strings do not cross documents.
Equal rows are texts of their own and repeat each other. A null doc_id stays null. An
empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import scratch, spread_join, text_or_empty, written
from tracelake.llm.words import raw_texts

LENGTH = 200
#: A perfect difference set modulo 133; each residue but 0 is the difference of one pair.
PERIOD = 133
COVER = (1, 2, 4, 13, 21, 35, 39, 82, 89, 95, 105, 110)
BLOCK_BYTES = 2 << 20
#: Tasks that sort buckets, at most.
PARTS = 20_000
SLICE = 1 << 18
BUCKET_BYTES = 6 << 20
#: Bytes of text in a bucket of the table of blocks.
TABLE_BYTES = 64 << 20

#: Base and byte values of each half of a fingerprint.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BYTES = tuple(np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) for seed in (4, 5))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_POWERS = tuple((_powers(base, SLICE + LENGTH), _powers(pow(base, -1, 1 << 64), SLICE + LENGTH)) for base in _BASES)
_SAMPLED = np.isin(np.arange(PERIOD), COVER)


def fingerprints(data: np.ndarray, at: np.ndarray, length: int, half: int = 0) -> np.ndarray:
    """64-bit fingerprints of data[p : p + length] for the sorted positions of at; there are two, unrelated."""
    values, (power, inverse) = _BYTES[half], _POWERS[half]
    out = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(data) + SLICE, SLICE))
    for k, low in enumerate(range(0, len(data), SLICE)):
        p = at[cuts[k] : cuts[k + 1]] - low
        if not len(p):
            continue
        part = data[low : low + SLICE + length]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * power[: len(part)], out=sums[1:])
        h = (sums[p + length] - sums[p]) * inverse[p]
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        out[cuts[k] : cuts[k + 1]] = h ^ (h >> np.uint64(33))
    return out


class Block:
    """Texts of one packed row: their bytes end to end, and which of them still take part."""

    def __init__(self, data: bytes, sizes: bytes, copies: list | None):
        self.sizes = np.frombuffer(sizes, np.int64)
        self.data = np.frombuffer(zstandard.decompress(data, max_output_size=int(self.sizes.sum())), np.uint8) if self.sizes.sum() else np.zeros(0, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.copied = np.zeros(len(self.sizes), bool)  # equal to another text
        active = self.sizes >= LENGTH
        for x in copies or ():
            self.copied[x["at"]] = True
            active[x["at"]] &= x["first"]
        self.active = active

    def room(self, length: int) -> np.ndarray:
        """Positions from which length bytes of an active text follow."""
        ok = np.repeat(self.active, self.sizes)
        for e, n in zip(self.ends[self.active], self.sizes[self.active], strict=True):
            ok[max(e - n, e - length + 1) : e] = False
        return ok

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the cover sample, and their fingerprints, one half of them."""
        depth = LENGTH - PERIOD + 1
        ok = self.room(depth)
        at = np.flatnonzero(ok & np.resize(_SAMPLED, len(ok)))
        return at, fingerprints(self.data, at, depth)[:, None]

    def suffixes(self, sample_ties: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions that have a tied sample within the next PERIOD bytes, and their fingerprints at full depth, both halves.

        bits: how many high bits of the first half are left; all but in tests, which want it to collide.
        """
        near = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(near, np.maximum(sample_ties - PERIOD + 1, 0), 1)
        np.add.at(near, sample_ties + 1, -1)
        at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & self.room(LENGTH))
        first = fingerprints(self.data, at, LENGTH) & np.uint64((1 << 64) - (1 << (64 - bits)))
        return at, np.stack([first, fingerprints(self.data, at, LENGTH, 1)], axis=1)

    def covered(self, ties: np.ndarray) -> np.ndarray:
        """Bytes to remove: those of tied suffixes, and all of a copied text."""
        change = np.zeros(len(self.data) + 1, np.int32)
        change[ties] += 1
        change[ties + LENGTH] -= 1
        return (np.cumsum(change)[:-1] > 0) | np.repeat(self.copied & (self.sizes >= LENGTH), self.sizes)


def packed(docs: DataFrame, block_bytes: int) -> DataFrame:
    """block, ids, sizes, digests and data of texts taken as they come; files bucketed by block.

    Only a catalog table can be bucketed. It has its own path, so its name goes at once and the files stay.
    """

    def run(batches):
        task, no = TaskContext.get().partitionId(), 0
        ids, texts, total = [], [], 0

        def row():
            nonlocal no, ids, texts, total
            sizes = np.array([len(x) for x in texts], np.int64)
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in texts]
            out = [[(task << 33) + no], [ids], [sizes.tobytes()], [digests], [zstandard.compress(b"".join(texts), 3)]]
            no, ids, texts, total = no + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.binary()), strict=True)], ["block", "ids", "sizes", "digests", "data"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch), strict=True):
                ids.append(doc_id)
                texts.append(raw)
                total += len(raw)
                if total >= block_bytes:
                    yield row()
        if ids:
            yield row()

    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = texts.mapInArrow(run, "block bigint, ids array<bigint>, sizes binary, digests array<binary>, data binary")
    name = f"packed_{uuid.uuid4().hex}"
    # Spark bounds the buckets of a table; a bucket is read block by block, so it may be of any size.
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TABLE_BYTES), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    # A task writes one bucket, so there is one file to each.
    rows.repartition(buckets, "block").write.bucketBy(buckets, "block").sortBy("block").option("path", scratch(spark, "packed")).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def copies(blocks: DataFrame) -> DataFrame:
    """Per block, the texts that occur more than once: place in the block, and whether this is the first."""
    texts = written(blocks.select("block", F.posexplode("digests").alias("at", "digest")), "digests")
    place = F.struct("block", "at")
    first = texts.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    told = spread_join(texts, first, "digest", "n", texts.count()).select("block", F.struct("at", (place == F.col("first")).alias("first")).alias("copy"))
    return written(told.groupBy("block").agg(F.collect_list("copy").alias("copies")), "copies")


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key: its place among as many equal ranges of the high 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (rows of one or two halves) sorted and each once, the place of every key among them, and their counts."""
    order = np.lexsort(keys.T[::-1])
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place, np.diff(np.append(np.flatnonzero(new), len(keys)))


def ties(blocks: DataFrame, entries, width: int, buckets: int, *more: str) -> DataFrame:
    """(block, answers): which distinct keys of each block occur elsewhere or twice.

    entries gives the keys of a row of blocks. A key is told apart by its bucket and ``width`` bytes:
    the first half and 4 bytes of the second, 12, or 4 of the first where the answer only narrows a search.
    """

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, _, counts = _distinct(entries(row))
                some, starts = np.unique(_buckets(keys[:, 0], buckets), return_index=True)
                ends = np.append(starts, len(keys))[1:]
                low = np.ascontiguousarray(keys).view(np.uint8)[:, :width]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some.astype(np.int32), pa.int32()),
                        pa.array([row["block"]] * len(some), pa.int64()),
                        pa.array([low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                        pa.array([np.packbits(counts[a:b] > 1).tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    ["bucket", "block", "keys", "twice"],
                )

    def answer(batches):
        def read(keys):
            if width == 4:
                return np.frombuffer(keys, "<u4")[:, None]
            own = np.frombuffer(keys, [("first", "<u8"), ("second", "<u4")])
            return np.stack([own["first"], own["second"].astype(np.uint64)], axis=1)

        def sort_bucket(rows):
            parts = [read(r[2]) for r in rows]
            sizes = np.array([len(p) for p in parts])
            twice = np.concatenate([np.unpackbits(np.frombuffer(r[3], np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)]).astype(bool)
            _, place, counts = _distinct(np.concatenate(parts))
            tied = counts > 1
            tied[place[twice]] = True
            bits = [np.packbits(x).tobytes() for x in np.split(tied[place], np.cumsum(sizes)[:-1])]
            return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array(bits, pa.binary())], ["block", "bucket", "bits"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    yield sort_bucket(held)
                    held = []
                held.append(row)
        if held:
            yield sort_bucket(held)

    sent = blocks.select("block", "sizes", "data", *more).mapInArrow(send, "bucket int, block bigint, keys binary, twice binary")
    # Ranges of buckets are dealt to a bounded number of tasks; each sorts its buckets one at a time.
    parts = min(buckets, PARTS)
    near = F.expr(f"bucket * {parts}L div {buckets}") if parts < buckets else F.col("bucket")
    dealt = sent.repartition(parts, near).sortWithinPartitions("bucket", "block")
    told = dealt.mapInArrow(answer, "block bigint, bucket int, bits binary")
    return written(told.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers")), "ties")


def tied(positions: np.ndarray, keys: np.ndarray, answers: list | None, buckets: int) -> np.ndarray:
    """The positions whose keys were answered to be tied."""
    if not answers:
        return positions[:0]
    distinct, place, _ = _distinct(keys)
    some, starts = np.unique(_buckets(distinct[:, 0], buckets), return_index=True)
    bits = {x["bucket"]: x["bits"] for x in answers}
    flags = [np.unpackbits(np.frombuffer(bits[b], np.uint8), count=n) for b, n in zip(some.tolist(), np.diff(np.append(starts, len(distinct))).tolist(), strict=True)]
    return positions[np.concatenate(flags).astype(bool)[place]]


def suffix_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and spans (start, end) of what went, per row."""
    blocks = packed(docs, block_bytes)
    total = blocks.agg(F.sum(F.lit(block_bytes))).first()[0] or 0
    few = max(1, int(total * len(COVER) / PERIOD * 4) // bucket_bytes, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = max(few, int(total) // bucket_bytes)
    blocks = blocks.join(copies(blocks), "block", "left")

    def sample(row):
        return Block(row["data"], row["sizes"], row["copies"]).sample()[1]

    def suffixes(row):
        block = Block(row["data"], row["sizes"], row["copies"])
        return block.suffixes(tied(*block.sample(), row["ranks"], few), bits)[1]

    ranks = ties(blocks, sample, 4, few, "copies").withColumnRenamed("answers", "ranks")
    blocks = blocks.join(ranks, "block", "left")
    blocks = blocks.join(ties(blocks, suffixes, 12, many, "copies", "ranks"), "block", "left")

    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["data"], row["sizes"], row["copies"])
                gone = block.covered(tied(*block.suffixes(tied(*block.sample(), row["ranks"], few), bits), row["answers"], many))
                spans, kept = [], []
                for e, n in zip(block.ends, block.sizes, strict=True):
                    own = gone[e - n : e]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).view(np.int8)))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                    kept.append(block.data[e - n : e][~own].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(block.sizes, pa.int64()), pa.array([sum(x["end"] - x["start"] for x in s) for s in spans], pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, spans_type)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
                )

    return blocks.select("ids", "sizes", "data", "copies", "ranks", "answers").mapInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")
