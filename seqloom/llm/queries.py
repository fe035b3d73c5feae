"""The queries of this package and their SQL."""

from __future__ import annotations

from seqloom.llm import chat, decontaminate, html, language, lm, media, neardup, sentencepieces, tokencount, toxicity

QUERIES = {
    "op1_media_webp": media.op1_media_webp,
    "op2_token_counts": tokencount.op2_token_counts,
    "op3_lm_scores": lm.op3_lm_scores,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_html_text": html.op5_html_text,
    "op6_chat_collapse": chat.op6_chat_collapse,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_language": language.op8_language,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_sentencepiece": sentencepieces.op10_sentencepiece,
}

ORACLES: dict[str, str] = {
    "op6_chat_collapse": chat.OP6_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
}
