"""Registered queries of the subpackage and the SQL of those that SQL can express."""

from . import cover_tree, decontaminate, html_text, langid, merkle, mixing, ngram_join, pii, preferences, substring_dedup, \
    token_align, tokens, url_rules

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_language_id": langid.op5_language_id,
    "op6_embedding_dedup": cover_tree.op6_embedding_dedup,
    "op7_url_filter": url_rules.op7_url_filter,
    "op8_preferences": preferences.op8_preferences,
    "op9_html_text": html_text.op9_html_text,
    "op10_pii": pii.op10_pii,
    "op11_merkle": merkle.op11_merkle,
    "op12_token_alignment": token_align.op12_token_alignment,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}

SQL = {"op6_embedding_dedup": cover_tree.SQL, "op7_url_filter": url_rules.SQL, "op8_preferences": preferences.SQL,
       "op11_merkle": merkle.SQL, "op13_substring_dedup": substring_dedup.SQL}
