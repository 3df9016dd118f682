"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence scores the logistic of a bias and
the sum of its words' weights; the document's score is the noisy-or over its
sentences, 1 - prod(1 - p). Only documents carry labels: training lowers the
cross-entropy of the noisy-or, and sentences learn their part of the blame.
The same sentence scores then locate what offends.

The fit uses a bounded sample of labelled rows: those with the lowest hash,
``max_docs`` rows and ``max_chars`` characters at most. A document that does not fit
into what is left of these bounds is passed over; if none fits, the shortest labelled
one is the sample. Words are hashed on the executors, so the driver gets numbers.
Weights near zero are dropped, and scoring is one pass without a shuffle.

Defined results: a null or empty text is one sentence without words, whose score
is the bias alone. Labels that are null are no labels; of several for a document
the highest counts; true and false are 1 and 0. Without labelled rows all weights
are 0 and every score is the prior given. Equal texts get equal scores. A text of
any length is scored whole: noisy-or grows with the number of sentences, so n
sentences without a telling word score 1 - (1 - p)^n with p the logistic of the bias.
Input columns named score, predicted or offending give way to the results; all
others are passed through under any name.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.llm.common import map_texts, without, written
from tracelake.llm.words import WORD_TABLE, raw_texts

FOLDS = 5
SENTENCE = re.compile(rb"[.!?\n]+")
DIMS = 1 << 18
MAX_DOCS = 8_000
MAX_CHARS = 60_000_000
PRIOR = 0.05
HASHES = 1 << 40
DECAY = 2e-6


def held_out(column: str = "doc_id"):
    """Rows that no fit may see: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def features(word: bytes) -> list[int]:
    """Slots of a word and of its first 4, 5 and 6 bytes, so that inflected forms share a stem."""
    return [zlib.crc32(x) % DIMS for x in {word, word[:4], word[:5], word[:6]}]


def sentences(raw: bytes) -> list[tuple[int, int]]:
    """Byte intervals of the sentences that hold more than marks; the whole text if none does."""
    out, at = [], 0
    for m in SENTENCE.finditer(raw):
        if raw[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if raw[at:].strip():
        out.append((at, len(raw)))
    return out or [(0, len(raw))]


def _bags(raw: bytes) -> list[list[int]]:
    return [[f for w in raw[a:b].translate(WORD_TABLE).split() for f in features(w)] for a, b in sentences(raw)]


def _screened(docs: DataFrame) -> np.ndarray:
    """Slots that occur in 3 bags or more, and in toxic ones more or less often than by chance (2 deviations)."""

    def run(batches):
        for batch in batches:
            count = np.zeros((2, DIMS), np.int64)
            for raw, toxic in zip(raw_texts(batch), batch.column(1).to_pylist(), strict=True):
                count[int(toxic > 0), np.unique(np.array([f for s in _bags(raw) for f in s], np.int64))] += 1
            used = np.flatnonzero(count.sum(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, count[0, used], count[1, used])], ["slot", "clean", "toxic"])

    counts = docs.select("text", "toxic").mapInArrow(run, "slot bigint, clean bigint, toxic bigint").groupBy("slot").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where("c + t > 2")
    bags, toxic = docs.agg(F.count("*"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0))).first()
    rate = (toxic or 0) / max(bags, 1)
    kept = counts.where((F.col("t") - F.lit(rate) * (F.col("c") + F.col("t"))) ** 2 >= 4 * F.lit(rate * (1 - rate)) * (F.col("c") + F.col("t")))
    return np.sort(np.array([r[0] for r in kept.select("slot").collect()], np.int64))  # DIMS at most


def _encoded(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """toxic, and per text its screened slots and how many of them each sentence has."""
    chosen = docs.sparkSession.sparkContext.broadcast(frozenset(slots.tolist()))

    def run(batches):
        for batch in batches:
            found, sizes = [], []
            for raw in raw_texts(batch):
                bags = [[f for f in s if f in chosen.value] for s in _bags(raw)]
                found.append(np.array([x for s in bags for x in s], np.int32).tobytes())
                sizes.append(np.array([len(s) for s in bags], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(found, pa.binary()), pa.array(sizes, pa.binary())], ["toxic", "slots", "sizes"])

    return docs.select("text", "toxic").mapInArrow(run, "toxic int, slots binary, sizes binary")


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, epochs: int = 100) -> tuple[dict[int, float], float]:
    """Weights by slot, and the bias, from documents outside the held-out fold."""
    told = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out())
    texts = docs.groupBy("doc_id", F.xxhash64("text")).agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))  # equal rows are one
    sizes = written(texts.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).join(told, "doc_id"), "sizes")
    # A share of the hash range holds about twice the sample, so what reaches the driver has a bound at any number of tasks.
    labelled = sizes.count()
    share = math.ceil(min(1.0, 2 * max_docs / max(labelled, 1)) * HASHES)
    h = F.pmod(F.xxhash64("doc_id"), F.lit(HASHES))
    rows = sizes.where(h < share).select(h.alias("h"), "doc_id", "n", "texts").collect()
    chosen, total, many = [], 0, 0
    for _, doc_id, n, k in sorted(map(tuple, rows)):
        if total + n <= max_chars and many + k <= max_docs:
            total, many = total + n, many + k
            chosen.append(doc_id)
    if not chosen:
        chosen = [r[0] for r in sizes.orderBy("texts", "n", "doc_id").limit(1).select("doc_id").collect()]
    if not chosen:
        return {}, float(np.log(PRIOR / (1 - PRIOR)))
    spark = docs.sparkSession
    keys = F.broadcast(spark.createDataFrame([(x,) for x in chosen], "doc_id bigint"))
    sample = written(docs.join(F.broadcast(told.join(keys, "doc_id")), "doc_id").dropDuplicates(["doc_id", "text"]), "sample")

    def descend(batches):
        rows = [b for b in batches if b.num_rows]
        weights, bias = _descend(pa.Table.from_batches(rows), epochs) if rows else ({}, 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([*weights, None], pa.int64()), pa.array([*weights.values(), bias], pa.float64())], ["slot", "w"])

    # The sample is bounded by max_docs and max_chars, so one task fits it; DIMS weights at most come back.
    found = _encoded(sample, _screened(sample)).repartition(1).mapInArrow(descend, "slot bigint, w double").collect()
    return {r.slot: r.w for r in found if r.slot is not None}, next(r.w for r in found if r.slot is None)


def loss(w: np.ndarray, b: float, y: np.ndarray, bag: np.ndarray, instance: np.ndarray, word: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Mean cross-entropy of the noisy-or, and its gradients by weights and bias.

    y: label of each bag; bag: that of each sentence; instance and word: sentence and weight of each word.
    """
    z = b + np.bincount(instance, w[word], len(bag))
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    clean = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))  # log of the chance that no sentence offends
    pos = np.maximum(-np.expm1(clean), 1e-9)
    # d loss / d z of a sentence: p for a clean bag, -(p / pos) * (1 - pos) for a toxic one
    g = p * np.where(y[bag] > 0, -(1 - pos[bag]) / pos[bag], 1.0) / len(y)
    value = -np.where(y > 0, np.log(pos), clean).mean()
    return value, np.bincount(word, g[instance], len(w)).astype(float), g.sum()


def _descend(rows: pa.Table, epochs: int) -> tuple[dict[int, float], float]:
    """Weights and bias by full-batch Adam on the cross-entropy of the noisy-or, with a weak pull of weights to zero."""
    y = rows["toxic"].to_numpy().astype(float)
    slots = [np.frombuffer(x, np.int32) for x in rows["slots"].to_pylist()]
    sizes = [np.frombuffer(x, np.int32) for x in rows["sizes"].to_pylist()]
    order = sorted(range(len(y)), key=lambda k: (slots[k].tobytes(), sizes[k].tobytes(), y[k]))  # rows come in any order
    y, slots, sizes = y[order], [slots[k] for k in order], [sizes[k] for k in order]
    word, per = np.concatenate(slots), np.concatenate(sizes)
    bag = np.repeat(np.arange(len(y)), [len(x) for x in sizes])
    used, word = np.unique(word, return_inverse=True)
    instance = np.repeat(np.arange(len(per)), per)
    w, b = np.zeros(len(used)), -5.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, epochs + 1):
        _, gw, gb = loss(w, b, y, bag, instance, word)
        gw += DECAY * w
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.2 if step <= epochs * 0.6 else 0.05
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return {int(s): float(x) for s, x in zip(used, w, strict=True) if abs(x) >= 0.05}, float(b)


class WordWeights(dict):
    """Weights of words as they are met; forgets all when it is full."""

    def __init__(self, slots: dict[int, float], most: int = 300_000):
        super().__init__()
        self.slots, self.most = slots, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = sum(self.slots.get(f, 0.0) for f in features(word))
        return found


def score_text(raw: bytes, weights: WordWeights, bias: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Noisy-or of a text, and its sentences with their scores."""
    parts = []
    log_clean = 0.0
    low = raw.translate(WORD_TABLE)
    for a, b in sentences(raw):
        z = bias + sum([weights[w] for w in low[a:b].split()])
        z = min(30.0, max(-30.0, z))
        log_clean -= math.log1p(math.exp(z))
        parts.append((a, b, 1 / (1 + math.exp(-z))))
    return -math.expm1(log_clean), parts


def toxicity(docs: DataFrame, labels: DataFrame, offending: float = 0.3, **fit_options) -> DataFrame:
    """docs with score, predicted (1 from 0.5) and offending: code points and score of the sentences at fault."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), **fit_options))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def start():
        slots, bias = model.value
        words = WordWeights(slots)

        def judge(texts):
            scores, found = [], []
            for raw in texts:
                s, parts = score_text(raw, words, bias)
                at = [x for x in parts if x[2] >= offending]
                place = lambda k, raw=raw: len(raw[:k].decode(errors="ignore"))
                found.append([{"start": place(a), "end": place(b), "score": p} for a, b, p in at])
                scores.append(s)
            return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(found, spans)]

        return judge

    results = StructType.fromDDL("score double, predicted int, offending array<struct<start:bigint,end:bigint,score:double>>")
    return map_texts(without(docs, *results.names), results, start)
