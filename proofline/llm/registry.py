"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import divergence, resampling
from .chat import op2_chat
from .digests import op5_digests
from .divergence import op11_divergence
from .languages import op7_languages
from .mixing import op6_mixing
from .neighbours import op3_neighbours
from .packed_ids import op8_packed_ids
from .packing import op9_packing
from .pages import op4_main_text
from .personal import op13_personal
from .resampling import op12_resampling
from .simhash import op1_simhash
from .toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_simhash, op2_chat, op3_neighbours, op4_main_text, op5_digests, op6_mixing, op7_languages, op8_packed_ids, op9_packing, op10_toxicity, op11_divergence, op12_resampling, op13_personal)}

ORACLES = {
    "op11_divergence": divergence.ORACLE,
    "op12_resampling": resampling.ORACLE,
    "op2_chat": r"""
        WITH said AS (
            SELECT *, '### ' || role || chr(10) || regexp_replace(text, '\\*(?:###|</turn>)', '\\\0', 'g') AS formatted FROM (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok') AS t)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(14 + length(role) + length(text) + len(regexp_extract_all(text, '###|</turn>'))) AS BIGINT) AS formatted_chars
        FROM said GROUP BY conv_id""",
}
