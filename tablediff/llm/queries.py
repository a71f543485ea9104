"""The queries of this subpackage and their SQL, for the registry."""

from __future__ import annotations

from .align import op12_align_tokenizers
from .brown import op13_brown_score
from .decontaminate import op5_decontamination
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .html_extract import op7_html_extraction
from .language_id import op9_language_id
from .resample import OP11_SQL, op11_resample
from .secrets import op4_secret_scan
from .sentence_piece import op10_sentencepiece
from .simhash import op6_simhash_near_dedup
from .token_count import op1_token_counts
from .toxicity import op2_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_exact_dedup, op4_secret_scan, op5_decontamination, op6_simhash_near_dedup, op7_html_extraction, op8_warc, op9_language_id, op10_sentencepiece, op11_resample, op12_align_tokenizers, op13_brown_score)}
ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op8_warc": OP8_SQL, "op11_resample": OP11_SQL}
