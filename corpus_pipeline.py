"""A training corpus from documents: five stages, each written and read again by the next.

The stages stand in the order given, so near copies are sought among texts whose
repeated passages are gone. Defined results: null texts are kept by all stages and
take one unit of a bin. Rows without a doc_id take part in all stages but the near
copies, where they stay. Equal rows are one document, of which the near copies keep
one row. An empty table gives no bins. Columns beside doc_id and text are carried
along under any name; only n_chars follows the text that line dedup changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import quoted, table, written
from tracelake.llm.decontaminate import decontaminate
from tracelake.llm.line_dedup import line_dedup
from tracelake.llm.ngram_join import ngram_join
from tracelake.llm.packing import best_fit_packing
from tracelake.llm.toxicity import toxicity


def whole(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns in one struct, so that no column can clash with a result."""
    return docs.select("doc_id", "text", F.struct(*[quoted(c) for c in docs.columns]).alias("row"))


def opened(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, learned from the labels of those outside the held-out fold."""
    return opened(toxicity(whole(docs), table(spark, sf_dir, "labels")).where("predicted = 0"), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; documents that lose their last line go. n_chars, where there is one, follows the text."""
    rest = F.struct(*[quoted(c) for c in docs.columns if c.lower() != "text"])
    found = line_dedup(docs.select("doc_id", "text", rest.alias("row"))).where(r"n_removed = 0 OR text RLIKE '\\S'")
    told = {}
    for field in docs.schema:
        own = F.col("row").getField(field.name)
        if field.name.lower() == "text":
            own = F.col("text")
        elif field.name.lower() == "n_chars":
            own = F.when(F.col("n_removed") > 0, F.length("text").cast(field.dataType)).otherwise(own)
        told[field.name] = own.alias(field.name)
    return found.select(*told.values())


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least doc_id; of its equal rows, one. Rows without a doc_id stay."""
    others = ngram_join(docs).where("doc_id <> class_id").select("doc_id")
    left = docs.join(others, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])
    again = docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*[quoted(c) for c in docs.columns])


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return opened(decontaminate(whole(docs), table(spark, sf_dir, "benchmark")).where("n_hit = 0"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents left."""
    return best_fit_packing(docs)


STAGES = [("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("ngram_join", one_of_each), ("decontaminate", reject_contaminated), ("packing", pack)]

#: No SQL has the trained stages, the candidate search or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
