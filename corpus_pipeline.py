"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; all but the last return the columns of documents. run() applies them to documents,
each stage's result written to the shared folder before the next begins.

Defined results: an empty table gives no pieces; null and empty texts fail the quality rules;
rows without a doc_id pass the line and join stages unchanged, as nothing can refer to them;
rows of one doc_id are one document to the line stage, and documents of their own to the join,
which keeps those whose texts don't link; further columns are handed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fastaxis.llm import decontaminate, line_dedup, ngram_join, packing, quality
from fastaxis.llm.common import documents, remove, written
from fastaxis.llm.registry import tokenizer_file

#: Near copies are those whose five-word shingles have a Jaccard similarity of 0.8 or more; op8's four words and 85 % are its SQL's.
WORDS, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    return quality.good_rows(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that two documents or more have, short ones too; those of which only white space is left go."""
    out = line_dedup.cleaned(docs, min_docs=2, support=3, short=True)
    row, changed = F.col("row"), F.col("n_dropped") > 0
    left = out.filter(~changed | row["text"].rlike(r"[^ \t\n\x0B\f\r]"))
    value = {c: row[c] for c in docs.columns}
    if "n_chars" in value:
        value["n_chars"] = F.when(changed, F.length(row["text"])).otherwise(row["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return left.select(*[v.alias(c) for c, v in value.items()])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (sets of WORDS-word shingles, PERCENT alike) the one with the smallest doc_id."""
    return ngram_join.one_of_each(docs, WORDS, PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full training sequences."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing_stage),
]
#: Estimated accuracies and the packing of tokens have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of all documents that the stages keep; of the stages' tables only the last one stays."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
