"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from loomgraph.llm import byte_bpe, html_extraction, lm_scoring, nearest_neighbours, packing, quality_classifier, quality_rules, simhash, toxicity, warc

QUERIES = {
    "op1_html_extraction": html_extraction.query,
    "op2_lm_scoring": lm_scoring.query,
    "op3_quality_rules": quality_rules.query,
    "op4_nearest_neighbours": nearest_neighbours.query,
    "op5_warc": warc.query,
    "op6_byte_bpe": byte_bpe.query,
    "op7_quality_classifier": quality_classifier.query,
    "op8_toxicity": toxicity.query,
    "op9_simhash": simhash.query,
    "op10_packing": packing.query,
}
ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.oracle(),
    "op5_warc": warc.ORACLE,
}
