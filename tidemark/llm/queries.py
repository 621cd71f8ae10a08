"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontamination, line_dedup, near_dedup, quality_classifier, quality_rules, secrets, substring_dedup, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_warc": warc.op9_warc,
    "op10_secret_scan": secrets.op10_secret_scan,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op2_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_decontamination": decontamination.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
}
