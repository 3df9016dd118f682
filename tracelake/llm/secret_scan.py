"""Secret scans over historical versions, with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. A row of the
ledger says which rules, at which version, were run over a blob, and what they
found. A run scans each blob once, whatever the number of its paths, and only by
the rules that the ledger lacks for it at their present version; it adds what it did
to the ledger and joins findings back to every path. A change of one rule so
costs a scan by that rule alone.

Texts are brought together by their hash with equal ones combined before the shuffle, so
a blob that a third of all paths hold is one row per task. Where a ledger is given, only
texts with an unseen pair move at all. Findings of a blob with very many paths are
broadcast (their number and length have bounds), so its paths stay spread.

Defined results: null text is the empty blob. A null path is a path of its own.
Equal rows get equal findings, one row each. A text of any length is scanned whole. Of
rules that match at one place all count; spans sort by start, then in the order of
KINDS. An empty table gives an empty result. Extra columns are ignored, whatever their
names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import spread_join, text_or_empty, written
from tracelake.llm.words import raw_texts

#: Kinds in the order in which they sort at the same start.
KINDS = ("assign", "access", "hex", "private_key", "jwt", "github", "slack", "google")
#: Kind, pattern, bytes of which one is in any text that matches. The assignment rule drops short values afterwards.
RULES = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), ()),
    ("access", re.compile(r"AKIA[A-Z0-9]{12,}"), (b"AKIA",)),
    ("hex", re.compile(r"[0-9a-f]{32,}"), ()),
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), (b"-----BEGIN ",)),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), (b"eyJ",)),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), (b"xox",)),
    ("google", re.compile(r"AIza[0-9A-Za-z_-]{35}"), (b"AIza",)),
)
#: Version of each rule, raised whenever its pattern changes.
VERSIONS = dict.fromkeys(KINDS, 1)
MIN_VALUE = 8
KEY_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HEX = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
HEX_RUN = b"x" * 32

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPAN_DDL = "array<struct<kind:string,start:bigint,end:bigint>>"
#: One row per blob and run: the rules that were run, as kind:version, and their spans.
LEDGER = f"blob string, rules array<string>, spans {SPAN_DDL}"
#: Findings of a blob that are broadcast have at most this many spans.
SHORT = 1000


def scan(raw: bytes, kinds: tuple[str, ...] = KINDS) -> list[tuple[str, int, int]]:
    """Spans of the kinds asked for in a text, by start, then in the order of KINDS."""
    low = raw.translate(LOWER)
    may = [
        (kind, rule)
        for kind, rule, signs in RULES
        if kind in kinds and (any(x in low for x in KEY_WORDS) if kind == "assign" else HEX_RUN in raw.translate(HEX) if kind == "hex" else any(x in raw for x in signs))
    ]
    if not may:
        return []
    text = raw.decode()
    found = [(m.start(), KINDS.index(kind), m.end()) for kind, rule in may for m in rule.finditer(text) if kind != "assign" or len(m[2]) >= MIN_VALUE]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _scanned(blobs: DataFrame) -> DataFrame:
    """Ledger rows of blobs (blob, text, rules)."""

    def run(batches):
        for batch in batches:
            asked = batch.column(2).to_pylist()
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(x, tuple(r.split(":")[0] for r in rules))] for x, rules in zip(raw_texts(batch, 1), asked, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(spans, SPANS)], ["blob", "rules", "spans"])

    return blobs.select("blob", "text", "rules").mapInArrow(run, LEDGER)


def _current(versions: dict[str, int]):
    return F.array(*[F.lit(f"{kind}:{version}") for kind, version in versions.items()])


def scan_unseen(texts: DataFrame, ledger: DataFrame | None = None, versions: dict[str, int] | None = None) -> DataFrame:
    """Ledger rows for the (blob, rule version) pairs of texts that ledger lacks."""
    named = texts.select(text_or_empty().alias("text")).withColumn("blob", F.sha2("text", 256))
    current = _current(versions or VERSIONS)
    if ledger is None:
        asked = named.withColumn("rules", current)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).where(F.array_contains(current, F.col("rule"))).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = named.groupBy("blob").agg(F.count("*").alias("paths"))  # keys alone decide what to scan
        lacking = blobs.join(seen, "blob", "left").select("blob", "paths", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where("size(rules) > 0")
        lacking = written(lacking, "lacking")
        total = lacking.agg(F.coalesce(F.sum("paths"), F.lit(0))).first()[0]
        asked = spread_join(named, lacking, "blob", "paths", total)
    once = asked.groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("rules").alias("rules"))
    return _scanned(once)


def findings(ledger: DataFrame, versions: dict[str, int] | None = None) -> DataFrame:
    """blob and spans, by start, of all present rules, for blobs with any."""
    now = F.create_map(*[F.lit(x) for kind, version in (versions or VERSIONS).items() for x in (kind, f"{kind}:{version}")])
    spans = ledger.where(F.size("spans") > 0).select("blob", "rules", F.explode("spans").alias("span"))
    valid = spans.where(F.array_contains(F.col("rules"), now[F.col("span.kind")]))
    order = F.struct(F.col("span.start").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("span.kind")).alias("no"), F.col("span.end").alias("end"), F.col("span.kind").alias("kind"))
    listed = valid.groupBy("blob").agg(F.sort_array(F.collect_set(order)).alias("found"))  # a pair that was scanned twice counts once
    return listed.select("blob", F.expr("transform(found, x -> struct(x.kind AS kind, x.start AS start, x.end AS end))").alias("spans"))


def secret_scan(versions: DataFrame, path: str = "doc_id", ledger: DataFrame | None = None, rules: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, blob, spans) for every row of versions, and the ledger with what was scanned now."""
    new = written(scan_unseen(versions.select("text"), ledger, rules), "ledger")
    known = new if ledger is None else ledger.select(new.columns).unionByName(new)
    paths = written(versions.select(path, F.sha2(text_or_empty(), 256).alias("blob")), "paths")
    held = paths.groupBy("blob").agg(F.count("*").alias("paths"))
    hits = findings(known, rules).join(held, "blob").withColumn("paths", F.when(F.size("spans") <= SHORT, F.col("paths")).otherwise(0))
    hits = written(hits, "findings")
    return spread_join(paths, hits, "blob", "paths", paths.count(), "left").select(path, "blob", F.coalesce("spans", F.array().cast(SPAN_DDL)).alias("spans")), known
