"""License, secret, chat and benchmark operators against plain versions."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, connect
from tests.llm.texts import awkward, empty
from tracelake.llm import chat_format as C
from tracelake.llm import decontaminate as D
from tracelake.llm import license_scan as L
from tracelake.llm import queries
from tracelake.llm import secret_scan as X

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])


# Licenses


def test_licenses_against_plain_search(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_license_scan(spark, SF).collect():
        ws = plain_words(docs[r.doc_id])
        places = [(k, label) for phrase, label in L.BASE_PHRASES.items() for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split()]
        starts = [k for k, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert set(r.base_labels.split(",")) <= {"", *r.labels.split(",")}
        assert 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("SPDX-License-Identifier: MIT", ["mit"], 0.1),
        ("// SPDX-License-Identifier: MIT OR GPL-3.0-only\nrest", ["gpl-3", "mit"], 0.1),
        ("SPDX-License-Identifier: MIT AND GPL-3.0-only", ["gpl-3", "mit"], 0.7),
        ("SPDX-License-Identifier: MIT OR Apache-2.0 AND GPL-2.0-only", ["apache-2", "gpl-2", "mit"], 0.1),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only", ["apache-2", "gpl-2", "mit"], 0.7),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["gpl-2"], 0.35),
        ("SPDX-License-Identifier: (MIT OR", ["mit"], 0.1),
        ("SPDX-License-Identifier: AND", [], 0.0),
        ("SPDX-License-Identifier:", [], 0.0),
        ("Released Under the MIT License, Version 2", ["mit"], 0.1),
        ("the license expression used here is odd", [], 0.0),
        ("Our license expression: see LICENSE file", [], 0.0),
        ("License expression: MIT OR something", ["mit"], 0.1),
        ("SPDX-License-Identifier: MIT.", ["mit"], 0.1),
        ("SPDX-License-Identifier: LicenseRef-own AND Zlib", ["licenseref-own", "zlib"], 0.6),
        ("SPDX-License-Identifier: GPL-3.0+ WITH GCC-exception-3.1", ["gpl-3"], 0.35),
        ("SPDX-License-Identifier: GPL-3.0+ WITH all of it", ["gpl-3"], 0.7),
        ("SPDX-License-Identifier: CC-BY-NC-SA-3.0", ["cc-by-nc", "cc-by-nc-sa"], 0.9),
    ],
)
def test_expressions(text, labels, score):
    _, _, _, got, s = L.scan(text.encode())
    assert got == labels
    assert s == pytest.approx(score)


def test_postfix_order():
    assert L.postfix(["a", "or", "b", "and", "c", "with", "d"]) == ["a", "b", "c", "d", "with", "and", "or"]
    assert L.postfix(["(", "a", "or", "b", ")", "and", "c"]) == ["a", "b", "or", "c", "and"]
    assert L.postfix(["a", "b"]) == ["a"]


def test_license_edges(spark):
    got = L.license_scan(awkward(spark)).collect()
    assert len(got) == 13
    by = {r.doc_id: r for r in got if r.doc_id}
    assert by[7].n_words == 40_000
    for k in (4, 5, 6):
        assert (by[k].n_words, by[k].places, by[k].expressions, by[k]["labels"], by[k].score) == (0, [], [], [], 0.0)
    assert L.license_scan(empty(spark)).count() == 0


def test_license_ids_of_the_caller(spark):
    docs = spark.createDataFrame([(1, "SPDX-License-Identifier: Acme-1.0 OR MIT"), (2, "under the mit license\nunder the MIT License")], "doc_id bigint, text string")
    got = {r.doc_id: (r["labels"], [(p.word, p.base) for p in r.places]) for r in L.license_scan(docs, {"acme-1.0": "acme"}).collect()}
    assert got == {1: (["acme", "mit"], []), 2: (["mit"], [(0, True), (4, True)])}


# Secrets


BASE = (
    ("assign", re.compile("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")),
    ("access", re.compile("AKIA[A-Z0-9]+")),
    ("hex", re.compile("[0-9a-f]+")),
)


def plain_spans(text):
    out = []
    for k, (kind, rule) in enumerate(BASE):
        for m in rule.finditer(text or ""):
            if (kind == "assign" and len(m[2]) >= 8) or (kind == "access" and len(m[0]) >= 16) or (kind == "hex" and len(m[0]) >= 32):
                out.append((m.start(), k, m.end()))
    return [(BASE[k][0], a, b) for a, k, b in sorted(out)]


SECRETS = [
    'password = "abcdefgh" TOKEN:12345678 token=short',
    "AKIA" + "A" * 12 + " AKIAAKIA" + "B" * 8 + " AKIA1",
    "é" * 9 + "0123456789abcdef" * 2 + "g" + "f" * 31,
    "secret=passwd=abcdefgh12 api_key: 'x' apikey='yyyyyyyyy'",
    "ſecret=abcdefgh12 toKen=abcdefgh12",
    "token=" + "a" * 40,
    "",
]


def test_spans_of_a_text():
    for text in SECRETS:
        base = [s for s in X.scan(text.encode()) if s[0] in ("assign", "access", "hex")]
        assert base == plain_spans(text)
    assert ("private_key", 0, 27) in X.scan(b"-----BEGIN PRIVATE KEY-----\nabc")


def test_secrets_against_plain_search(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op3_secret_scan(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        spans = plain_spans(docs[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in spans) for x in ("assign", "access", "hex"))
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(",")) | {""}


def test_ledger_scans_unseen_pairs_only(spark):
    first = spark.createDataFrame([("a", "token=abcdefgh1"), ("b", "token=abcdefgh1"), ("c", None), ("a", "token=abcdefgh1")], "path string, text string")
    found, ledger = X.secret_scan(first, "path")
    assert sorted((r.path, len(r.spans)) for r in found.collect()) == [("a", 1), ("a", 1), ("b", 1), ("c", 0)]
    assert ledger.count() == 2
    later = first.union(spark.createDataFrame([("d", "token=abcdefgh1"), ("a", "secret=abcdefgh2")], first.schema))
    new = X.scan_unseen(later, ledger).collect()
    assert [r.rules for r in new] == [[f"{k}:1" for k in X.KINDS]]
    found, grown = X.secret_scan(later, "path", ledger)
    assert grown.count() == 3
    assert sorted((r.path, len(r.spans)) for r in found.collect()) == [("a", 1), ("a", 1), ("a", 1), ("b", 1), ("c", 0), ("d", 1)]
    # One rule in a new version: it alone is run, over every blob once.
    raised = X.VERSIONS | {"assign": 2}
    again = X.scan_unseen(later, grown, raised).collect()
    assert [r.rules for r in again] == [["assign:2"]] * 3
    found, most = X.secret_scan(later, "path", grown, raised)
    assert most.count() == 6
    assert sorted(len(r.spans) for r in found.collect()) == [0, 1, 1, 1, 1, 1]
    assert X.scan_unseen(later, most, raised).count() == 0


def test_findings_of_copied_blobs(spark):
    rows = [(k, "token=abcdefgh1" if k % 3 == 0 else f"text {k % 50} secret=abcdefgh{k % 50}" if k % 3 == 1 else None) for k in range(3000)]
    found, ledger = X.secret_scan(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert ledger.count() == len({t for _, t in rows})
    assert {r.doc_id: len(r.spans) for r in found.collect()} == {k: int(t is not None) for k, t in rows}


def test_secret_edges(spark):
    found, _ = X.secret_scan(awkward(spark).withColumns({"blob": F.lit(1), "spans": F.lit(2), "paths": F.lit(3)}))
    assert found.count() == 13
    assert found.where("size(spans) > 0").count() == 0
    found, ledger = X.secret_scan(empty(spark))
    assert found.count() == ledger.count() == 0


# Chat


HARD = ["", "plain", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_start|>", "<|im_end|", "<|im_start", "a<|im_end|><\\|im_end|>b", "\\", "\n", "<|im_<|im_end|>end|>"]


@pytest.mark.parametrize("text", HARD)
@pytest.mark.parametrize("role", ["user", "", "a\nb", "<|im_end|>", "\\n", "x\\"])
def test_turns_survive(role, text):
    rendered = C.render(role, text)
    assert [t[:2] for t in C.parse(rendered + C.render("user", "x"))] == [(role, text), ("user", "x")]


@pytest.mark.parametrize("text", [*HARD, "a<|im_end|>b", "x<|im_end|>\n", "<|im_start|>"])
@pytest.mark.parametrize("role", ["user", "<|im_end|>", "a<|im_start|>b\n"])
def test_marks_stand_once(role, text):
    rendered = C.render(role, text)
    assert rendered.count(C.START) == rendered.count(C.END) == 1
    assert [t[:2] for t in C.parse(rendered)] == [(role, text)]


@pytest.mark.parametrize("text", ["<|im_end|>", "a<|im_end|>b", "<|im_start|>", "<\\|im_end|>", "<\\\\|im_start|>x"])
def test_chat_sql_on_control_strings(spark, tmp_path, text):
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (2, 0, "assistant", None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert_same(queries.op2_chat_format(spark, str(tmp_path)), con, queries.ORACLES["op2_chat_format"])


def test_chat_ids_beyond_floats(spark):
    rows = [(2**53, 0, "user", "a"), (2**53 + 1, 0, "user", "b"), (None, 0, "user", "c"), (2**53 + 1, 2**53 + 1, "user", "d")]
    convs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1)
    got = {r.conv_id: r.n_turns for r in C.digests(C.format_chat(convs)).collect()}
    assert got == {2**53: 1, 2**53 + 1: 2, None: 1}
    assert sorted(r.turn for r in C.format_chat(convs).collect()) == [0, 0, 0, 2**53 + 1]


def test_plain_turns_stay_plain():
    assert C.render("user", "hi") == "<|im_start|>user\nhi<|im_end|>\n"


def test_parser_rejects_other_text():
    for bad in ("x", "<|im_start|>user\na<|im_end|>b<|im_end|>\n", "<|im_start|>user", "<|im_start|>user\n<|im_start|>x<|im_end|>\n"):
        with pytest.raises(ValueError):
            C.parse(bad)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", HARD[8]), (1, 0, None, None), (1, 2, "assistant", "é🎉"), (None, None, "user", "x"), (None, None, "user", "x"), (2, 0, "user", "q")]
    convs = spark.createDataFrame([(*r, 5) for r in rows], "conv_id bigint, turn bigint, role string, text string, start int")
    got = {r.conv_id: r for r in C.digests(C.format_chat(convs)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3
    assert got[1].turns_sha256 == sha(f"\n\nassistant\n{HARD[8]}\nassistant\né🎉\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(HARD[8]) + 2, sha(HARD[8] + "é🎉"))
    assert got[None].n_turns == 2
    assert got[2].loss_chars == 0
    assert C.digests(C.format_chat(convs.limit(0))).count() == 0


# Benchmark


def plain_hits(text, items):
    ws = plain_words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = plain_words(t)
        for k in range(max(1, len(iw) - 9) if iw else 0):
            w = iw[k : k + 10]
            for p in range(len(ws) - len(w) + 1):
                if ws[p : p + len(w)] == w:
                    hit.update(range(p, p + len(w)))
                    found.add(item)
    return len(ws), len(hit), sorted(found, key=lambda x: (x is None, x))


@pytest.mark.parametrize("most", [10_000, 7])
def test_decontaminate_both_ways(spark, most):
    items = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu."), (2, "short item"), (3, None), (4, "short ITEM!"), (None, "stray words")]
    texts = [(1, "x ALPHA beta gamma, delta epsilon zeta eta theta iota kappa lambda mu y short item short item"), (2, "beta gamma short-item é"), (3, None), (4, ""), (5, "stray words nothing")]
    docs = spark.createDataFrame([(i, t, 9, "k", 1, 2) for i, t in texts], "doc_id bigint, text string, n_hit int, other string, _n_words int, `row` int")
    found = D.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"), max_windows=most)
    assert found.columns == ["doc_id", "text", "other", "_n_words", "row", "n_words", "hit_runs", "hit_spans", "items", "n_hit"]
    got = {r.doc_id: r for r in found.collect()}
    for i, t in texts:
        n, hit, items_hit = plain_hits(t, items)
        assert (got[i]._n_words, got[i].row) == (1, 2)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"], got[i].other) == (n, hit, [x for x in items_hit if x is not None], "k")
    assert [texts[1][1][s.start : s.end] for s in got[2].hit_spans] == ["short-item"]


def test_decontaminate_whole_table_by_join(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    by_id = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(x) for x in r.hit_spans]) for r in df.collect())
    assert by_id(D.decontaminate(docs, items, max_windows=1)) == by_id(D.decontaminate(docs, items))
    assert D.decontaminate(awkward(spark), items, max_windows=1).count() == 13
    assert D.decontaminate(empty(spark), items, max_windows=1).count() == 0


def test_decontaminate_questions_and_answers(spark):
    items = spark.createDataFrame([(1, "what is it", "it is that")], "item_id bigint, question string, answer string")
    docs = spark.createDataFrame([(1, "so: What is it? no"), (2, "it is that"), (3, "it is")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_hit for r in D.decontaminate(docs, items, ("question", "answer")).collect()}
    assert got == {1: 3, 2: 3, 3: 0}


def test_decontaminate_edges(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert D.decontaminate(awkward(spark), items).where("n_hit > 0").count() == 0
    some = spark.createDataFrame([(1, "short text")], "item_id bigint, text string")
    assert [r.doc_id for r in D.decontaminate(awkward(spark), some).where("n_hit > 0").collect()] == [8]
    assert D.decontaminate(empty(spark), some).count() == 0
