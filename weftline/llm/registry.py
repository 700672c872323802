"""The queries of this subpackage and, where SQL can express them, their oracles."""

from . import chat, decontaminate, fingerprint, language, lines, mixing, secrets, simhash, tokens, urls

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_language_id": language.query,
    "op3_source_mix": mixing.query,
    "op4_line_dedup": lines.query,
    "op5_url_filter": urls.query,
    "op6_fingerprint": fingerprint.query,
    "op7_simhash": simhash.query,
    "op8_decontaminate": decontaminate.query,
    "op9_chat_format": chat.query,
    "op10_token_output": tokens.query,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": lines.SQL,
    "op5_url_filter": urls.SQL,
    "op9_chat_format": chat.SQL,
}
