"""Personal data, Merkle manifest and hard negatives against brute-force versions."""

import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.texts import awkward, empty
from tracelake.llm import hard_negatives as H
from tracelake.llm import merkle as M
from tracelake.llm import pii as P
from tracelake.llm import queries

SF = "/root/testdata/sf0.001"

# Personal data

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for place, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            number = re.sub("[^0-9]", "", m.group())
            holds = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(number) <= 19 and luhn(number), "phone": 10 <= len(number) <= 15}
            if holds[kind]:
                out.append((m.start(), place, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def base_of(rows):
    return {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in rows}


def test_pii_query_equals_plain_search(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_pii(spark, SF).collect()
    assert len(got) == len(docs)
    assert sum(r.n_email + r.n_card for r in got) > 0
    for r in got:
        want = plain_spans(docs[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in RULES)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_pii_base_on_hard_texts(spark):
    texts = [
        "a@b.co_d@e.fr x@y.z.@d.e +a@b.c-d.e. .@x.yy @b.c a@b a@b..c",
        "1.2.3.4.5.6.7.8 001.02.3.0255 1.2.3.256 12.34.56.78x 999.1.1.1.1 0000000000000000000001.1.1.1",
        "4111 1111 1111 1111-4111111111111111 4111-1111-1111-1112 5 55 378282246310005  3782 822463 10005",
        "+1 (988) 555-2485 +49.30.1234567 +12 3 +1((((((( +1-800-555-0199-12345 ++15551234567 + 1555",
        "🎉é漢字 x@y.zz 🎉 10.0.0.1 +331 2345 6789🎉",
        "9" * 50_000,
        "a" * 50_000 + "@" + "b." * 20_000,
        "+1" + " (" * 30_000,
        "1.2.3.4 " * 3000 + "end x@y.org " * 700,
        "",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    began = time.time()
    got = base_of(P.pii(docs).collect())
    assert time.time() - began < 120
    for k, text in enumerate(texts):
        assert got[k] == plain_spans(text), k
    assert len(got[8]) == 3700


def test_pii_nulls_repeats_and_clashes(spark):
    got = P.pii(awkward(spark).withColumn("spans", F.lit(1)).withColumn("_w", F.lit(2))).collect()
    assert len(got) == 13
    assert P.pii(empty(spark)).count() == 0


def test_vote_chances_equal_a_plain_em(spark):
    r = np.random.default_rng(3)
    truth = r.random(4000) < 0.3
    table = {True: [0.05, 0.15, 0.8], False: [0.7, 0.2, 0.1]}
    votes = ["".join(str(r.choice(3, p=table[t])) for _ in range(P.VOTES)) for t in truth.tolist()]
    counts = {v: votes.count(v) for v in set(votes)}
    counted = spark.createDataFrame([(0, v, n) for v, n in counts.items()], "kind int, votes string, n bigint")
    got = {x.votes: x.chance / P.UNIT for x in P.vote_chances(counted).collect()}
    patterns = sorted(counts)
    v, n = np.array([[int(c) for c in p] for p in patterns]), np.array([counts[p] for p in patterns], float)
    q = 1 / (1 + np.exp(-(v - 1).sum(axis=1)))
    for _ in range(P.ROUNDS):
        share = {1: n * q, 0: n * (1 - q)}
        rate = {y: np.array([[(share[y][v[:, j] == c].sum() + P.FORE[y][c]) / (share[y].sum() + sum(P.FORE[y])) for c in range(3)] for j in range(P.VOTES)]) for y in (0, 1)}
        odds = math.log(share[1].sum() + 1) - math.log(share[0].sum() + 1) + sum(np.log(rate[1][j, v[:, j]]) - np.log(rate[0][j, v[:, j]]) for j in range(P.VOTES))
        q = 1 / (1 + np.exp(-odds))
    assert max(abs(got[p] - x) for p, x in zip(patterns, q.tolist(), strict=True)) < 2e-6
    right = sum((got[p] >= 0.5) == t for p, t in zip(votes, truth.tolist(), strict=True))
    assert right / len(votes) > 0.97  # reliabilities are found without labels


def test_pii_classifier_tells_other_kinds_apart(spark):
    r = np.random.default_rng(5)
    number = lambda k: "".join(map(str, r.integers(0, 10, k)))
    rows = []
    for k in range(150):
        rows.append((k, f"please call me, phone ({r.integers(200, 999)}) {r.integers(200, 999)}-{number(4)} after noon"))
        rows.append((1000 + k, f"see version {r.integers(100, 999)}.{r.integers(100, 999)}.{number(4)}_{number(2)} of the build"))
    got = {x.doc_id: x.spans for x in P.pii(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert sum(any(s.kind == "local_phone" for s in got[k]) for k in range(150)) >= 145
    assert sum(bool(got[1000 + k]) for k in range(150)) <= 5
    for k, text in rows[:4]:
        for s in got[k]:
            assert re.fullmatch(r"[0-9(). -]+", text[s.start : s.end])


def test_cumulated_over_parts(spark):
    for n in (1, 255, 256, 257, 1500):
        rows = spark.createDataFrame([(list(range(n)),)], "x array<int>").select(P.cumulated(F.col("x")).alias("s"))
        assert rows.first().s == list(itertools.accumulate(range(n)))


# Merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
            paths[i].append((run[: k % 8], run[k % 8 + 1 :]))
            at[i] = k // 8
        nodes = [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows):
    leaf = lambda r, text: digest("".join(map(frame, (r.doc_id, r.source, r.lang, r.n_chars, text))))
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        by_lang[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees.append(tree([leaf(r, r.text) for r in by_lang[lang]]))
    root, tops = tree([subroot for subroot, _ in trees])
    out = []
    for lang, (subroot, paths), top in zip(order, trees, tops, strict=True):
        for r, path in zip(by_lang[lang], paths, strict=True):
            node = leaf(r, r.text)
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None:
                node = leaf(r, re.sub("[A-Z]", lambda m: m.group().lower(), r.text))
            for before, behind in path + top:
                node = digest("".join(before) + node + "".join(behind))
            proof = "".join("".join(before) + "".join(behind) for before, behind in path + top)
            out.append((r.doc_id, leaf(r, r.text), subroot, root, digest(proof), node, node == root))
    return sorted(out, key=repr)


def made(spark, docs, path):
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, queries.op12_merkle_manifest(spark, str(path)).collect()), key=repr)


def test_manifest_query_equals_plain(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(map(tuple, queries.op12_merkle_manifest(spark, SF).collect()), key=repr)
    assert got == plain_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_awkward_rows(spark, tmp_path):
    docs = awkward(spark).withColumn("leaf", F.lit("x")).withColumn("place", F.lit(1)).withColumn("s0", F.lit(2))
    got = made(spark, docs, tmp_path)
    assert len(got) == 13
    assert got == plain_manifest(docs.collect())


def test_manifest_of_many_shapes(spark, tmp_path):
    # Runs of one child, a lone leaf, more languages than a node has children, a language with most rows, equal rows.
    rows = [(k, f"T{k}", "big", "s", k) for k in range(585)]
    rows += [(k, "Same", "nine", None, None) for k in range(9)] + [(1, "Twin", "twins", "s", 1)] * 70
    rows += [(k, "A", f"l{k:02}", "s", 1) for k in range(70)] + [(5, None, "Émile", "", 0), (None, "b", None, "s", 1), (6, "ÄB", "", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(6)
    assert made(spark, docs, tmp_path / "many") == plain_manifest(docs.collect())
    one = docs.where("lang = 'Émile'")
    assert made(spark, one, tmp_path / "one") == plain_manifest(one.collect())
    assert made(spark, docs.limit(0), tmp_path / "none") == []


# Hard negatives


def plain_negatives(rows, every=100):
    kept = {}
    for i, x, label in rows:
        if i is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        key = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(c)) for c in x])
        kept[i] = min(kept.get(i, key), key)
    out = []
    for a, (label, x) in kept.items():
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), b, other) for b, (other, y) in kept.items() if b != a and len(y) == len(x)]
        scored.sort()
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            near = [t for t in scored if t[2] != label and 30 * -s <= 100 * -t[0] <= 90 * -s][:10]
            out += [(a, p, k, t[1], -s, -t[0]) for k, t in enumerate(near, 1)]
    return sorted(out)


def vectors(seed, n, dim=20, scale=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    return [(int(i), (scale * (centres[i % 6] + 0.7 * r.normal(size=dim))).astype(np.float32).tolist(), int(r.integers(0, 10))) for i in range(n)]


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def test_negatives_query_equals_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(map(tuple, queries.op13_hard_negatives(spark, SF).collect()))
    assert got
    assert got == plain_negatives(rows)


def test_negatives_of_awkward_rows(spark):
    rows = vectors(1, 700)
    rows += [(None, [1.0] * 20, 1), (1001, None, 1), (1002, [1.0] * 20, None), (1003, [float("nan")] * 20, 2), (1004, [float("inf")] * 20, 2), (1005, [None] * 20, 2), (1006, [], 2)]
    rows += [rows[100], rows[200], (300, [0.5] * 20, 3), (1100, [0.0] * 20, 4), (1200, [-1.0] * 20, 4), (1201, [1.0] * 7, 4), (1300, [0.5] * 7, 4), (1302, [0.4] * 7, 5)]
    rows += [(2000 + k, [0.25] * 20, k % 3) for k in range(150)]  # ties
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("codes", F.lit(1)).withColumn("score", F.lit(2.0)).repartition(5)
    assert sorted(map(tuple, H.hard_negatives(docs).collect())) == plain_negatives(rows)
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_negatives_over_many_packs_groups_and_cuts(spark, monkeypatch):
    for name, value in (("PACK", 16), ("GROUP", 3), ("SIDE", 2), ("HELD", 50), ("CHUNKS", (4, 9))):
        monkeypatch.setattr(H, name, value)
    rows = vectors(2, 900)
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(7), chunk=150).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)


def test_negatives_of_large_components(spark):
    rows = vectors(3, 300, 12, 2e5)  # products beyond 2 ** 53 have to be exact
    assert sorted(map(tuple, H.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())) == plain_negatives(rows)


def test_bounds_hold_and_narrow():
    r = np.random.default_rng(4)
    a, b = (r.integers(-200, 200, (40, 33)) + np.repeat(r.integers(-300, 300, (40, 11)), 3, axis=1) for _ in range(2))
    exact, widths = a @ b.T, []
    for level in range(len(H.SEGMENTS)):
        low, high = H.bounds(H.summary_of(a), H.summary_of(b), level)
        assert (low <= exact).all()
        assert (exact <= high).all()
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True)
    assert widths[-1] < 0.6 * widths[0]


def test_bounds_leave_rows_out():
    r = np.random.default_rng(6)
    a = np.repeat(r.normal(size=(8, 16)), 4, axis=1) * 100
    b = np.repeat(r.normal(size=(500, 16)), 4, axis=1) * 100
    exact = a @ b.T
    need = np.sort(exact, axis=1)[:, -5]
    left, right = H.left_after_bounds(H.summary_of(a), H.summary_of(b), need, np.full(8, np.inf))
    assert left.tolist() == list(range(8))
    assert set(np.argsort(-exact, axis=1)[:, :5].ravel()) <= set(right.tolist())
    assert len(right) < 60
