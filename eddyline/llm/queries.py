"""The registered queries of these operators, and DuckDB SQL where SQL can state their result."""

from __future__ import annotations

from eddyline.llm import chat, secrets, warc
from eddyline.llm.avi import op6_media
from eddyline.llm.chat import op5_chat
from eddyline.llm.decontaminate import op8_decontaminate
from eddyline.llm.langid import op4_language
from eddyline.llm.ordering import op7_training_order
from eddyline.llm.packing import op3_packing
from eddyline.llm.secrets import op10_secrets
from eddyline.llm.simhash import op9_simhash
from eddyline.llm.warc import op1_warc
from eddyline.llm.wordpiece import op2_token_counts

QUERIES = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_language": op4_language,
    "op5_chat": op5_chat,
    "op6_media": op6_media,
    "op7_training_order": op7_training_order,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash": op9_simhash,
    "op10_secrets": op10_secrets,
}

ORACLES: dict[str, str] = {"op1_warc": warc.ORACLE, "op5_chat": chat.ORACLE, "op10_secrets": secrets.ORACLE}
