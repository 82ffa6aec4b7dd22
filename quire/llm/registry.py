"""The subpackage's queries and their SQL."""

from __future__ import annotations

from quire.llm import bpe, chat, decontaminate, jaccard, licenses, quality_model, quality_rules, secrets, toxicity, warc
from quire.llm.common import Query


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_warc": warc.op2_warc,
        "op3_chat_format": chat.op3_chat_format,
        "op4_jaccard_join": jaccard.op4_jaccard_join,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality_model": quality_model.op6_quality_model,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_license_scan": licenses.op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.ORACLE,
        "op3_chat_format": chat.ORACLE,
        "op4_jaccard_join": jaccard.ORACLE,
        "op7_quality_rules": quality_rules.oracle(),
        "op9_decontaminate": decontaminate.ORACLE,
        "op10_license_scan": licenses.oracle(),
    }
