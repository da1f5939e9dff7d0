"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioq.llm.hmm import op4_hmm_scores
from folioq.llm.html_extract import op1_html_text
from folioq.llm.licenses import op10_license_scan
from folioq.llm.media import op6_media_columns
from folioq.llm.mixing import op5_source_mix
from folioq.llm.piece_codec import op2_piece_codec
from folioq.llm.quality import op9_quality_rules
from folioq.llm.simhash import op7_simhash_groups
from folioq.llm.token_count import op3_token_counts
from folioq.llm.warc import SQL8, op8_warc_records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_piece_codec": op2_piece_codec,
    "op3_token_counts": op3_token_counts,
    "op4_hmm_scores": op4_hmm_scores,
    "op5_source_mix": op5_source_mix,
    "op6_media_columns": op6_media_columns,
    "op7_simhash_groups": op7_simhash_groups,
    "op8_warc_records": op8_warc_records,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {"op8_warc_records": SQL8}
