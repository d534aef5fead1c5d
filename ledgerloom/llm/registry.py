"""The queries of this subpackage and their SQL."""

from . import divergence, embeddings, html_text, media, mixing, ngram_join, pieces, pii, prefix_trie, quality, substrings, suffixes, urls

QUERIES = {
    "op1_url_filters": urls.op1_url_filters,
    "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
    "op3_mixing": mixing.op3_mixing,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_pii": pii.op5_pii,
    "op6_html_extraction": html_text.op6_html_extraction,
    "op7_suffix_array": suffixes.op7_suffix_array,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_media_columns": media.op10_media_columns,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_embedding_dedup": embeddings.op12_embedding_dedup,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLES = {"op1_url_filters": urls.OP1_SQL, "op3_mixing": mixing.OP3_SQL, "op8_substring_dedup": substrings.OP8_SQL, "op11_source_divergence": divergence.OP11_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
