"""The queries of the llm operators: each applies one to its whole table."""

from __future__ import annotations

from nearspan.llm.brown_lm import score_texts
from nearspan.llm.common import table
from nearspan.llm.decontaminate import find_leaks
from nearspan.llm.html_extract import extract_html
from nearspan.llm.jaccard_join import jaccard_join, jaccard_sql
from nearspan.llm.license_scan import license_scan, license_sql
from nearspan.llm.lloyd import delta_lloyd, lloyd_sql
from nearspan.llm.pieces import digest_pieces
from nearspan.llm.pii import find_pii
from nearspan.llm.quality_model import score_quality
from nearspan.llm.quality_rules import quality_rules
from nearspan.llm.secret_scan import scan_secrets
from nearspan.llm.toxicity import score_toxicity
from nearspan.llm.whitening import whiten

QUERIES = {
    "op1_html_extract": lambda spark, sf_dir: extract_html(table(spark, sf_dir, "pages")),
    "op2_decontaminate": lambda spark, sf_dir: find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op3_license_scan": lambda spark, sf_dir: license_scan(table(spark, sf_dir, "documents")),
    "op4_quality_model": lambda spark, sf_dir: score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op5_jaccard_join": lambda spark, sf_dir: jaccard_join(table(spark, sf_dir, "documents")),
    "op6_pieces": lambda spark, sf_dir: digest_pieces(table(spark, sf_dir, "documents")),
    "op7_pii": lambda spark, sf_dir: find_pii(table(spark, sf_dir, "documents")),
    "op8_toxicity": lambda spark, sf_dir: score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_secret_scan": lambda spark, sf_dir: scan_secrets(table(spark, sf_dir, "documents")),
    "op10_quality_rules": lambda spark, sf_dir: quality_rules(table(spark, sf_dir, "documents")),
    "op11_brown_lm": lambda spark, sf_dir: score_texts(table(spark, sf_dir, "documents")),
    "op12_whitening": lambda spark, sf_dir: whiten(table(spark, sf_dir, "embeddings")),
    "op13_delta_lloyd": lambda spark, sf_dir: delta_lloyd(table(spark, sf_dir, "embeddings")),
}

ORACLE_SQL: dict[str, str] = {"op3_license_scan": license_sql(), "op5_jaccard_join": jaccard_sql(), "op13_delta_lloyd": lloyd_sql()}
