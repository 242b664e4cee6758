"""The queries opN_<name>: each operator over its whole table, reduced to its digest columns."""

import public_tokenizers

from . import bpe, decontaminate, jaccard_join, line_dedup, quality_classifier, quality_rules, source_audit, sql, token_files, toxicity, url_filter, whitening
from .substring_dedup import remove_repeated_sequences
from .suffix_dedup import remove_repeated_strings


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    return remove_repeated_strings(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op2_substring_dedup(spark, sf_dir):
    return remove_repeated_sequences(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op3_ngram_jaccard(spark, sf_dir):
    return jaccard_join.linked_groups(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark, sf_dir):
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_url_filter(spark, sf_dir):
    return url_filter.filter_urls(_table(spark, sf_dir, "pages")).drop("score")


def op6_quality_rules(spark, sf_dir):
    kept = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return kept.drop("n_lines", "n_capitals", "n_shouts")


def op7_quality_classifier(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, _table(spark, sf_dir, "labels")))


def op8_decontamination(spark, sf_dir):
    return decontaminate.find_copies(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.line_digests(_table(spark, sf_dir, "documents"))


def op10_token_files(spark, sf_dir):
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark, sf_dir):
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("evidence")


def op13_source_audit(spark, sf_dir):
    return source_audit.audit(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_url_filter": op5_url_filter,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_files": op10_token_files,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_source_audit": op13_source_audit,
}

ORACLE_SQL = {
    "op5_url_filter": sql.url_filter(),
    "op6_quality_rules": sql.quality_rules(),
    "op9_line_dedup": sql.line_dedup(),
    "op13_source_audit": sql.source_audit(),
}
