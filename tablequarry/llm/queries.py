"""The corpus queries, by name: a Spark function and, where SQL can say it, its DuckDB twin."""

from . import bpe_text, chat, decontaminate, licenses, packed, partenum, quality, repetition, search, secrets, spelling, suffixes, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_suffix_repeats": suffixes.query,
    "op3_toxicity": toxicity.query,
    "op4_byte_bpe": bpe_text.query,
    "op5_repetition": repetition.query,
    "op6_packed_ids": packed.query,
    "op7_jaccard_classes": partenum.query,
    "op8_chat_format": chat.query,
    "op9_license_scan": licenses.query,
    "op10_quality": quality.query,
    "op11_secret_scan": secrets.query,
    "op12_ranked_search": search.query,
    "op13_spelling_variants": spelling.query,
}

SQL = {
    "op8_chat_format": chat.SQL,
    "op9_license_scan": licenses.SQL,
    "op11_secret_scan": secrets.SQL,
    "op12_ranked_search": search.SQL,
    "op13_spelling_variants": spelling.SQL,
}
