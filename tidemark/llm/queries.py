"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .ann import op7_ann
from .chat import OP9_SQL, op9_chat
from .decontaminate import OP10_SQL, op10_decontamination
from .language import op6_language
from .license import OP1_SQL, op1_license
from .lm_score import op4_lm_score
from .pieces import op5_sentencepiece
from .quality import op2_quality
from .simhash import op8_simhash
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_license": op1_license,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_lm_score": op4_lm_score,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_language": op6_language,
    "op7_ann": op7_ann,
    "op8_simhash": op8_simhash,
    "op9_chat": op9_chat,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL = {"op1_license": OP1_SQL, "op3_warc": OP3_SQL, "op9_chat": OP9_SQL, "op10_decontamination": OP10_SQL}
