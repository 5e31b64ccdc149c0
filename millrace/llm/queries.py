"""Queries of this subpackage by name, and the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from millrace.llm import licenses
from millrace.llm.bpe import op1_bpe_codec
from millrace.llm.decontaminate import op3_decontamination
from millrace.llm.jpeg import op9_media_columns
from millrace.llm.licenses import op8_license_scan
from millrace.llm.line_dedup import op6_line_dedup
from millrace.llm.simhash import op10_simhash
from millrace.llm.token_counts import op5_token_counts
from millrace.llm.toxicity import op4_toxicity
from millrace.llm.url_filter import op2_url_filter
from millrace.llm.warc import OP7_SQL, op7_warc

_ALL = (op1_bpe_codec, op2_url_filter, op3_decontamination, op4_toxicity, op5_token_counts, op6_line_dedup, op7_warc, op8_license_scan, op9_media_columns, op10_simhash)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op7_warc": OP7_SQL, "op8_license_scan": licenses.sql()}
