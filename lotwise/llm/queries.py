"""Registered queries of this subpackage and their oracle SQL (where SQL can state them)."""

from __future__ import annotations

import public_tokenizers

from lotwise.llm import bpe, collocations, filter_audit, langid, licenses, lines, lm_score, mixing, pq, quality, superminhash, token_counts, toxicity
from lotwise.llm.common import table


def op1_line_dedup(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"))


def op2_vector_duplicates(spark, sf_dir):
    return pq.link_vectors(table(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark, sf_dir):
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark, sf_dir):
    return superminhash.group_documents(table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_mix_sources(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark, sf_dir):
    return bpe.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_lm_score(spark, sf_dir):
    return lm_score.score_corpus(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries():
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_vector_duplicates": op2_vector_duplicates,
        "op3_quality_rules": op3_quality_rules,
        "op4_language_id": op4_language_id,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_token_counts": op6_token_counts,
        "op7_mix_sources": op7_mix_sources,
        "op8_toxicity": op8_toxicity,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_license_scan": op10_license_scan,
        "op11_collocations": op11_collocations,
        "op12_lm_score": op12_lm_score,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql():
    return {
        "op7_mix_sources": mixing.SQL,
        "op10_license_scan": licenses.sql(),
        "op11_collocations": collocations.SQL,
        "op13_filter_audit": filter_audit.SQL,
    }
