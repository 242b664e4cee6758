"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it
kept; all but the last return the columns of documents, the last one the digests of the
encoded texts.  No SQL is given: BPE has no form in it.  The stages are tested one by one
and together against plain versions.
"""

import public_tokenizers

from glyphloom.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules


def quality(spark, docs, sf_dir):
    """Drops documents that fail a base rule or reach a cutoff chosen on the labels."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark, docs, sf_dir):
    """Drops lines that are on more than a twentieth of a source's documents; n_chars follows."""
    return line_dedup.drop_boilerplate(docs, length_col="n_chars")


def near_duplicates(spark, docs, sf_dir):
    """Keeps the document with the least doc_id of each group of linked ones."""
    return jaccard_join.keep_one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Drops documents that hold a copied stretch of a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark, docs, sf_dir):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the remaining documents."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", encoding),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
