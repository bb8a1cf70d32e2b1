"""Registry of the training-data queries and of their DuckDB equivalents."""

from __future__ import annotations

from .decontaminate import OP3_SQL, op3_decontamination
from .filter_audit import OP12_SQL, op12_filter_audit
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .html_text import op7_html_text
from .lattice import op13_lattice_dedup
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import OP9_SQL, op9_source_mix
from .quality_classifier import op4_quality_classifier
from .quality_rules import op1_quality_rules
from .simhash import op10_simhash_pivots
from .span_dedup import op2_span_dedup
from .tokens import op5_token_archive
from .warc import OP8_SQL, op8_warc_archive

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_span_dedup": op2_span_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_archive": op5_token_archive,
    "op6_line_dedup": op6_line_dedup,
    "op7_html_text": op7_html_text,
    "op8_warc_archive": op8_warc_archive,
    "op9_source_mix": op9_source_mix,
    "op10_simhash_pivots": op10_simhash_pivots,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_lattice_dedup": op13_lattice_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op6_line_dedup": OP6_SQL,
    "op8_warc_archive": OP8_SQL,
    "op9_source_mix": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
