"""N-gram Jaccard self-join: MinHash banding, then verification on full n-gram sets.

1. A text becomes the set of 64-bit hashes of its five-word shingles. Texts with
   equal sets are one class, and its least doc_id stands for it, so copies are
   never compared with each other.
2. Band and row counts follow from the target recall at the threshold. Rows of
   (band hash, representative) are shuffled, and hashes that one text alone has fall away.
3. Each representative's home is the band hash that it shares with most others, and small
   homes join a populous one they touch; texts of one home form a part, and homes beyond ``block`` members or ``block_bytes`` of n-grams are
   cut into several. Two parts meet where some band hash stands in both. So texts that
   share a band meet exactly once, and texts that share none hardly ever do,
   however long the chains are that link them.
4. Parts that meet are verified on the full sets, by matrix products over slices of the
   vocabulary: no task holds more than two parts, no pair becomes a row, and no
   partner is left out. Classes are the connected components of the verified links.

Defined results: a text of fewer than five words is one shingle; null and empty
texts have no shingles and are alone in their class. Texts of any length enter
whole. Rows with a null doc_id are returned with null class and text ids and no
links. Rows of one doc_id with equal text are one document; a doc_id should not
name different texts. Ties: the least doc_id stands for equal sets and for a class. An
empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import spread_join, written
from tracelake.llm.words import normal_words, raw_texts
from tracelake.operators.blocks import grouped
from tracelake.operators.graphs import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 400
BLOCK = 1024
BLOCK_BYTES = 32 << 20
STEP = 1 << 15  # words hashed at a time

_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_MULTIPLY = (_rng.integers(0, 1 << 32, MAX_HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, MAX_HASHES, dtype=np.uint64).astype(np.uint32)
_FOLD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, n at least."""
    if len(_powers[0]) < n:
        n = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    all_words = normal_words(raw)
    if not all_words:
        return np.zeros(0, np.uint64)
    out = []
    for k in range(0, max(1, len(all_words) - words + 1), STEP):
        part = all_words[k : k + STEP + words - 1]
        size = min(words, len(part))
        buf = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        power, inverse = _grown(len(buf))
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
        ends = np.flatnonzero(buf == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends) - size + 1]
        out.append((sums[ends[size - 1 :]] - sums[starts]) * inverse[starts])
    return np.unique(mixed(np.concatenate(out)))


def bands_for(threshold: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows for which a pair at the threshold is found with the target recall."""
    best = (most, 1)
    for rows in range(1, 13):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(low, (x[k : k + 1024, None] * _MULTIPLY[: bands * rows] + _ADD[: bands * rows]).min(axis=0), out=low)
    folded = (low.reshape(bands, rows).astype(np.uint64) * _FOLD[:rows]).sum(axis=1, dtype=np.uint64)
    return mixed(folded + np.arange(bands, dtype=np.uint64) * np.uint64(_BASE)).view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, set_key (null without shingles), the number of shingles and the hashes of all bands."""

    def run(batches):
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for raw in raw_texts(batch):
                grams = shingles(raw, words)
                keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                sizes.append(len(grams))
                hashes.append(band_hashes(grams, bands, rows) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "set_key", "n_grams", "bands"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, set_key binary, n_grams bigint, bands array<bigint>")


def shared_bands(reps: DataFrame) -> DataFrame:
    """(rep, h, size): the band hashes that a representative shares with others, and how many texts have them."""
    rows = reps.select("rep", F.explode("bands").alias("h"))
    several = written(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n")), "several")
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return spread_join(rows, several, "h", "n", total).select("rep", "h", "size")


def parts(shared: DataFrame, reps: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """(rep, part): texts of one home, at most about ``block`` of them and ``block_bytes`` of n-grams.

    A home of fewer than half a block joins the most populous home among the texts that have its band hash.
    """
    first = F.min_by("h", F.struct(-F.col("size"), "h")).alias("home")
    homes = written(shared.groupBy("rep").agg(first).join(reps.select("rep", "n_grams"), "rep"), "homes")
    homed = written(shared.select("rep", "h").join(homes.select("rep", "home"), "rep").select("h", "home"), "homed")
    weights = homed.groupBy("home").agg(F.count("*").alias("n")).withColumn("weight", F.col("n"))
    parents = spread_join(homed, weights, "home", "n", homed.count()).groupBy("h").agg(F.max_by("home", F.struct("weight", "home")).alias("parent")).withColumnRenamed("h", "home")
    sizes = homes.groupBy("home").agg(F.count("*").alias("n")).join(parents, "home")
    total = homes.count()
    joined = spread_join(homes, sizes.withColumn("size", F.col("n")), "home", "n", total)
    homes = written(joined.select("rep", "n_grams", F.when(F.col("size") < block / 2, F.col("parent")).otherwise(F.col("home")).alias("home")), "homes")
    cuts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_grams") * 8 / block_bytes)).cast("int")
    cut = homes.groupBy("home").agg(cuts.alias("cuts"), F.count("*").alias("n")).where("cuts > 1")
    told = spread_join(homes, cut, "home", "n", total, "left")
    return told.select("rep", F.when(F.col("cuts").isNull(), F.col("home")).otherwise(F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("cuts")))).alias("part"))


def meetings(shared: DataFrame, dealt: DataFrame) -> DataFrame:
    """(i, j), i <= j: parts in which one band hash stands; each with itself too."""
    places = written(shared.join(dealt, "rep").select("h", "part").distinct(), "places")
    several = places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    inner = places.join(several, "h")
    left, right = inner.select("h", F.col("part").alias("i")), inner.select("h", F.col("part").alias("j"))
    return left.join(right, "h").where("i < j").select("i", "j").union(places.select(F.col("part").alias("i"), F.col("part").alias("j"))).distinct()


def overlaps(sets: list[np.ndarray], slice_width: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, a slice of the vocabulary at a time."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    grams, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    column = np.cumsum(np.concatenate([[0], grams[1:] != grams[:-1]]))
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    out = np.zeros((n, n))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, slice_width):
        a, b = np.searchsorted(column, (low, low + slice_width))
        dense = np.zeros((n, slice_width), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        out += dense @ dense.T
    return out.astype(np.int64)


def verified(reps: list[int], parts: list[int], sets: list[np.ndarray], threshold: float, across: bool) -> tuple[list[int], list[int]]:
    """Per member: links, and the least member linked to it, directly or not; across: only pairs of different parts."""
    size = np.array([len(s) for s in sets])
    both = overlaps(sets)
    linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    if across:
        part = np.array(parts)
        linked &= part[:, None] != part[None, :]
    lead = np.array(reps, np.int64)
    while True:
        near = np.where(linked, lead[None, :], np.iinfo(np.int64).max).min(axis=1)
        now = np.minimum(lead, near)
        if (now == lead).all():
            break
        lead = now
    return linked.sum(axis=1).tolist(), lead.tolist()


def verify(docs: DataFrame, dealt: DataFrame, met: DataFrame, words: int, threshold: float) -> DataFrame:
    """(node, n_links, lead): one row per member and meeting of parts (i, j); dealt are (rep, part)."""
    # A sort-merge join at any size: it spills, and texts move alike whether dealt is small or not.
    dealt = dealt.hint("merge")
    texts = docs.join(dealt, docs["doc_id"] == dealt["rep"]).select("rep", "part", "text")

    def to_sets(batches):
        for batch in batches:
            grams = [shingles(raw, words).tobytes() for raw in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(grams, pa.binary())], ["part", "rep", "grams"])

    def pack(batches):
        """A part as one row: its members, the sizes of their sets, its vocabulary once, and the sets as places in that."""
        for (part,), group in grouped(batches, 1):
            unique = dict(zip(group["rep"].to_pylist(), group["grams"].to_pylist(), strict=True))  # rows of one document are one
            sets = [np.frombuffer(g, np.uint64) for g in unique.values()]
            vocabulary, places = np.unique(np.concatenate(sets), return_inverse=True)
            row = (
                part,
                np.array(list(unique), np.int64).tobytes(),
                np.array([len(x) for x in sets], np.int64).tobytes(),
                zstandard.compress(vocabulary.tobytes(), 1),
                zstandard.compress(places.astype(np.int32).tobytes(), 1),
            )
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), *[pa.binary()] * 4), strict=True)], ["part", *fields])

    fields = ["members", "sizes", "vocabulary", "places"]
    sets = texts.mapInArrow(to_sets, "part bigint, rep bigint, grams binary").repartition("part").sortWithinPartitions("part", "rep")
    packed = sets.mapInArrow(pack, "part bigint, members binary, sizes binary, vocabulary binary, places binary")
    goes = met.select(F.col("i").alias("part"), "i", "j").union(met.where("i <> j").select(F.col("j").alias("part"), "i", "j"))
    ordered = packed.join(goes, "part").select("i", "j", "part", *fields).repartition("i", "j").sortWithinPartitions("i", "j", "part")

    def check(batches):
        for (i, j), group in grouped(batches, 2):
            nodes, parts_of, sets = [], [], []
            for part, members, sizes, vocabulary, places in zip(*(group[c].to_pylist() for c in ("part", *fields)), strict=True):
                own = np.frombuffer(members, np.int64).tolist()
                grams = np.frombuffer(zstandard.decompress(vocabulary), np.uint64)[np.frombuffer(zstandard.decompress(places), np.int32)]
                nodes += own
                parts_of += [part] * len(own)
                sets += np.split(grams, np.cumsum(np.frombuffer(sizes, np.int64))[:-1])
            links, leads = verified(nodes, parts_of, sets, threshold, i != j) if len(nodes) > 1 else ([0], nodes)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (nodes, links, leads)], ["node", "n_links", "lead"])

    return ordered.mapInArrow(check, "node bigint, n_links bigint, lead bigint")


def ngram_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, class_id (least doc_id of all texts linked to it, directly or not), text_id (least doc_id with the same shingles), n_links (other texts at the threshold or above)."""
    bands, rows = bands_for(threshold, recall)
    signed = written(signatures(docs, words, bands, rows), "signatures")
    plain = signed.select("doc_id", "set_key")
    one = plain.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    shingled = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    reps = written(
        shingled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_grams").alias("n_grams"), F.min_by("bands", "doc_id").alias("bands"), F.count("*").alias("copies")), "reps"
    )
    shared = written(shared_bands(reps), "shared")
    dealt = written(parts(shared, reps, block, block_bytes), "parts")
    found = written(verify(docs.select("doc_id", "text"), dealt, meetings(shared, dealt), words, threshold), "links")
    labels = components(found.where("lead <> node").select(F.col("node").alias("a"), F.col("lead").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    told = (
        reps.select("set_key", "rep", "copies")
        .join(counts, F.col("rep") == counts["node"], "left")
        .drop("node")
        .join(labels, F.col("rep") == labels["node"], "left")
        .select("set_key", "copies", F.coalesce("label", "rep").alias("class_id"), F.col("rep").alias("text_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    joined = spread_join(one, written(told, "classes"), "set_key", "copies", one.count())
    alone = plain.where("doc_id IS NULL OR set_key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("text_id"), F.lit(0).cast("long").alias("n_links"))
    return joined.select(*alone.columns).unionByName(alone)
