"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import convrepair, embdedup, htmlmain, langid, lshsearch, mixing, ngramjoin, simhash, spiece, suffix, tokenalign, toxicity, urlfilter


def queries():
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op10_sentencepiece": spiece.op10_sentencepiece,
        "op3_embedding_near_dedup": embdedup.op3_embedding_near_dedup,
        "op4_suffix_array_dedup": suffix.op4_suffix_array_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_html_extraction": htmlmain.op6_html_extraction,
        "op7_simhash": simhash.op7_simhash,
        "op8_ngram_jaccard": ngramjoin.op8_ngram_jaccard,
        "op9_url_filters": urlfilter.op9_url_filters,
        "op11_token_alignment": tokenalign.op11_token_alignment,
        "op12_conversation_repair": convrepair.op12_conversation_repair,
        "op13_nearest_neighbours": lshsearch.op13_nearest_neighbours,
    }


def oracle_sql():
    return {"op9_url_filters": urlfilter.OP9_SQL}
