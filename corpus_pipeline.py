"""A training-corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from hitgraph.llm import decontaminate, jaccard, mixing, quality, tokens, util

#: run()'s rows depend on fitted trees and a tokenizer, which SQL cannot express; the tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go; the trees are fitted on a bounded sample of the labelled documents."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs, sf_dir):
    """Of each component at a similarity of 0.8 on five-word shingles the document of smallest doc_id stays."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark, docs, sf_dir):
    """All documents, put in the order of the schedule: the files' order is the order to train in."""
    return mixing.in_order(docs)


def token_output(spark, docs, sf_dir):
    """Ids of the documents in the files' order, written as coded blocks and read back."""
    path = util.shared_dir(spark)
    place = None
    if "_metadata" not in docs.columns and docs.inputFiles():
        place = [docs["_metadata.file_name"], docs["_metadata.row_index"]]
    tokens.write(docs, path, tokens.default_tokenizer(), order=place)
    return tokens.read(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = util.persist(docs)
    return docs
