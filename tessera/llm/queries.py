"""The registered queries of this subpackage, and SQL where it can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import audit, chat, negatives, warc
from tessera.llm.audio import op4_audio
from tessera.llm.audit import op11_audit
from tessera.llm.chat import op9_chat
from tessera.llm.decontaminate import op8_decontaminate
from tessera.llm.language import op10_language
from tessera.llm.lines import op5_lines
from tessera.llm.lm import op2_lm
from tessera.llm.negatives import op12_negatives
from tessera.llm.pfor import op3_token_ids
from tessera.llm.pieces import op6_pieces
from tessera.llm.secrets import op7_secrets
from tessera.llm.simhash import op1_simhash
from tessera.llm.warc import op13_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_lm": op2_lm,
        "op3_token_ids": op3_token_ids,
        "op4_audio": op4_audio,
        "op5_lines": op5_lines,
        "op6_pieces": op6_pieces,
        "op7_secrets": op7_secrets,
        "op8_decontaminate": op8_decontaminate,
        "op9_chat": op9_chat,
        "op10_language": op10_language,
        "op11_audit": op11_audit,
        "op12_negatives": op12_negatives,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_chat": chat.SQL, "op11_audit": audit.SQL, "op12_negatives": negatives.SQL, "op13_warc": warc.SQL}
