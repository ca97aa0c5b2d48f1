"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.

Edge cases, by stage: a null or empty text fails the quality rules, as it has no words.  Line dedup counts rows of one doc_id as
one document and a null doc_id as one below all others; a text may come out empty.  Of linked documents the join keeps the one of
the smallest doc_id, of equal rows one; texts without words stay, and so do different texts under one doc_id or none.
Decontamination takes each row for itself; empty texts stay.  Packing gives an empty text its end token and a repeated row a place of its
own.  A null in any other column is carried along, and so are further columns, whatever their names.  Texts of any length are processed whole, and
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import decontaminate, line_dedup, ngram_join, packing, quality
from tokenloom.llm.common import numbered, remove_dir, stored, table, work_dir
from tokenloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; ``n_chars``, where there is one, follows."""
    rows, name = numbered(docs)
    kept = line_dedup.dedup_lines(rows, doc_id=name["doc_id"], text=name["text"])
    columns = {c: F.col(n) for c, n in name.items()}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, F.length(name["text"]).cast(kind)).otherwise(F.col(name["n_chars"]))
    return kept.select(*[c.alias(n) for n, c in columns.items()])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The language model and the token counts are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{i}")
        if i:
            remove_dir(spark, f"{path}/{i - 1}")
    return docs
