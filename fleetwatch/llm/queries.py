"""The dealt operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from fleetwatch.llm.conversation_repair import op13_conversation_repair
from fleetwatch.llm.decontamination import op3_decontamination
from fleetwatch.llm.id_files import op6_token_files
from fleetwatch.llm.minhash_dedup import op2_minhash_dedup
from fleetwatch.llm.prefix_trie import op11_prefix_trie
from fleetwatch.llm.quality import op7_quality
from fleetwatch.llm.secret_scan import op9_secret_scan
from fleetwatch.llm.sentencepiece_codec import op4_sentencepiece
from fleetwatch.llm.source_mix import op12_source_mix
from fleetwatch.llm.spot_signatures import op5_spot_signatures
from fleetwatch.llm.substring_dedup import op8_substring_dedup
from fleetwatch.llm.suffix_dedup import op10_suffix_array_dedup
from fleetwatch.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_spot_signatures": op5_spot_signatures,
    "op6_token_files": op6_token_files,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_source_mix": op12_source_mix,
    "op13_conversation_repair": op13_conversation_repair,
}

OP8 = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, p, md5(array_to_string(words[p:p + 19], ' ')) AS key
    FROM docs, unnest(range(1, len(words) - 18)) AS t(p)
), repeated AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY key ORDER BY doc_id, p) AS nth FROM windows) WHERE nth > 1
), covered AS (
    SELECT doc_id, list(DISTINCT p + i) AS places FROM repeated, range(20) AS t(i) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, len(coalesce(places, []))::BIGINT AS n_removed,
    sha256(coalesce(array_to_string(list_filter(words, lambda w, i: NOT list_contains(coalesce(places, []), i)), ' '), '')) AS kept_sha256
FROM docs LEFT JOIN covered USING (doc_id)
"""

OP10 = """
WITH docs AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents
), strings AS (
    SELECT doc_id, p, md5(substr(bytes, 2 * p + 1, 400)) AS key FROM docs, unnest(range(0, len(bytes) // 2 - 199)) AS t(p)
), repeated AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY key) AS n FROM strings) WHERE n > 1
), runs AS (
    SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM (
        SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
            SELECT doc_id, p, (p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -201) + 200)::INT AS fresh FROM repeated))
    GROUP BY doc_id, run
), kept AS (  -- the gaps before each run, and after the last
    SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs
    UNION ALL SELECT doc_id, max(b), 1000000000 FROM runs GROUP BY doc_id
), sums AS (
    SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
), texts AS (
    SELECT doc_id, string_agg(substr(bytes, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS rest FROM kept JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (len(bytes) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(rest, bytes))) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN texts USING (doc_id)
"""

# unsigned crc32 of a text; its table of 256 values is made by the rule. DuckDB has no such function
_CRC = """
crc_table AS (
    SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS crc
)"""


def _crc(text: str) -> str:
    letters = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)"
    return f"xor(list_reduce({letters}, lambda c, o: xor(c >> 8, crc[(xor(c, o) & 255) + 1]), 4294967295), 4294967295)"


OP11 = f"""
WITH {_CRC}, own AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS idx FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc("conv_id::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own), crc_table
), rebuilt AS (
    SELECT c.conv_id, 0 AS piece, idx, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND idx <= h
    UNION ALL SELECT c.conv_id, 1, idx, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND idx > h
), seqs AS (
    SELECT conv_id, coalesce(turns, []) AS turns FROM convs
    LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY piece, idx) AS turns FROM rebuilt GROUP BY conv_id) USING (conv_id)
), prefixes AS (
    SELECT conv_id, d, turns[:d] AS path, d = len(turns) AS ends FROM seqs, unnest(range(len(turns) + 1)) AS t(d)
), nodes AS (
    SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
        CASE WHEN d > 0 THEN (count(*) - 1) * octet_length(encode(path[d].text)) ELSE 0 END AS saving
    FROM prefixes GROUP BY path, d
), children AS (
    SELECT path[:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), marked AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)
), subtrees AS (
    SELECT path[:k] AS path, sum((n_children = 0)::INT) AS n_leaves, sum(saving) AS saved_tokens FROM marked, unnest(range(d + 1)) AS t(k) GROUP BY 1
)
SELECT m.conv_id::BIGINT AS conv_id, m.d::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
    n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM marked m JOIN subtrees s ON s.path = m.path LEFT JOIN nodes p ON m.d > 0 AND p.d = m.d - 1 AND p.path = m.path[:m.d - 1]
"""

# The costs after each row, by state (nothing, system, user, assistant), as (cost, audit, lines): the least of them is the cheapest and ASCII-least one
OP13 = f"""
WITH RECURSIVE {_CRC}, coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS code FROM conversations, crc_table
), damaged AS (
    SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
        CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM coded, unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) WHERE code <> 0
), placed AS (
    SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
    FROM damaged
), judged AS (
    SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS joint
    FROM placed
), counts AS (
    SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE joint NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
), best AS (
    SELECT conv_id, n AS i, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS n0, {{'c': 4::BIGINT, 'a': 'II', 'l': ['user:', 'assistant:']}} AS s0,
        {{'c': 2::BIGINT, 'a': 'I', 'l': ['assistant:']}} AS u0, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS a0
    FROM counts
    UNION ALL
    SELECT conv_id, i, list_min([n1, {{'c': u2.c + 2, 'a': 'I' || u2.a, 'l': list_prepend('user:', u2.l)}}]), list_min([s1, {{'c': u2.c + 2, 'a': 'I' || u2.a, 'l': list_prepend('user:', u2.l)}}]), u2, a2
    FROM (
        SELECT *, list_min([u1, {{'c': a1.c + 2, 'a': 'I' || a1.a, 'l': list_prepend('assistant:', a1.l)}}]) AS u2,
            list_min([a1, {{'c': u1.c + 2, 'a': 'I' || u1.a, 'l': list_prepend('user:', u1.l)}}]) AS a2
        FROM (
            SELECT b.conv_id, b.i - 1 AS i, {", ".join(
                f"list_min(list_filter([{{'c': {q}0.c + 3, 'a': 'D' || {q}0.a, 'l': {q}0.l}}, "
                f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {{'c': {to}0.c + 2 + (fault = 'truncated')::BIGINT, 'a': 'R' || {to}0.a, 'l': list_prepend('{role}:' || text, {to}0.l)}} END"
                + "".join(
                    f", CASE WHEN fault NOT IN ('blank', 'duplicate') AND initial = '{k}' THEN {{'c': {k}0.c + (fault = 'truncated')::BIGINT, 'a': 'K' || {k}0.a, 'l': list_prepend(role || ':' || text, {k}0.l)}} END"
                    for k in kept)
                + f"], lambda x: x IS NOT NULL)) AS {q}1"
                for q, to, role, kept in (("n", "u", "user", "su"), ("s", "u", "user", "u"), ("u", "a", "assistant", "a"), ("a", "u", "user", "u")))}
            FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i
        )
    )
), ids AS (
    SELECT DISTINCT conv_id FROM conversations
)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(n0.c, 0)::BIGINT AS cost, coalesce(n0.a, '') AS audit, sha256(coalesce(array_to_string(n0.l, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id AND b.i = 0
"""

ORACLES = {
    "op8_substring_dedup": OP8,
    "op10_suffix_array_dedup": OP10,
    "op11_prefix_trie": OP11,
    "op13_conversation_repair": OP13,
}
