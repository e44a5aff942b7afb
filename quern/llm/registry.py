"""Queries of the training-data operators, and the SQL of those that can be put so."""

from __future__ import annotations

from quern.llm import (
    best_fit_packing,
    chat_format,
    chosen_path_join,
    conversation_repair,
    decontamination,
    html_extraction,
    language_id,
    lm_trie,
    multi_index_hashing,
    oracles,
    quality_crf,
    sentencepiece_tokenizers,
    spherical_filters,
    token_alignment,
)

QUERIES = {
    "op1_best_fit_packing": best_fit_packing.query,
    "op2_ngram_jaccard_join": chosen_path_join.query,
    "op3_lm_scoring": lm_trie.query,
    "op4_html_extraction": html_extraction.query,
    "op5_quality_crf": quality_crf.query,
    "op6_multi_index_hashing": multi_index_hashing.query,
    "op7_language_id": language_id.query,
    "op8_chat_formatting": chat_format.query,
    "op9_embedding_near_dedup": spherical_filters.query,
    "op10_sentencepiece": sentencepiece_tokenizers.query,
    "op11_token_alignment": token_alignment.query,
    "op12_decontamination": decontamination.query,
    "op13_conversation_repair": conversation_repair.query,
}
ORACLES: dict[str, str] = {
    "op11_token_alignment": token_alignment.query,
    "op12_decontamination": decontamination.query,
    "op12_decontamination": oracles.DECONTAMINATION,
    "op13_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op8_chat_formatting": r"""WITH said AS (
    SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations
    UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)
), escaped AS (
    SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS x,
        regexp_replace(replace(r, '\', '\\'), '(<)(/?s>)|(\[)(/?(?:INST|OUT|ROLE)\])|(<)(</?SYS>>)', '\1\3\5\\\2\4\6', 'g') AS er,
        regexp_replace(replace(x, '\', '\\'), '(<)(/?s>)|(\[)(/?(?:INST|OUT|ROLE)\])|(<)(</?SYS>>)', '\1\3\5\\\2\4\6', 'g') AS ex
    FROM said
), formatted AS (
    SELECT *, CASE r WHEN 'user' THEN '<s>[INST] ' || ex || ' [/INST]' WHEN 'assistant' THEN '<s>[OUT] ' || ex || ' [/OUT]</s>'
        WHEN 'system' THEN '<s><<SYS>> ' || ex || ' <</SYS>>' ELSE '<s>[ROLE] ' || er || ' [/ROLE]' || ex || '</s>' END AS f
    FROM escaped
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
    CAST(coalesce(sum(length(x)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(f)) AS BIGINT) AS formatted_chars
FROM formatted GROUP BY conv_id""",
}
