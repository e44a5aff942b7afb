"""DuckDB SQL for the operators whose results SQL can state."""

from __future__ import annotations


def _plus(way: str, cost: str | int, edit: str) -> str:
    """A way (six digits of cost, then the edits) with one more edit."""
    return f"lpad(CAST(CAST(left({way}, 6) AS BIGINT) + {cost} AS VARCHAR), 6, '0') || substr({way}, 7) || {edit}"


def _turn(role: str) -> str:
    return f"CASE WHEN initial = '{role}' THEN 'K' ELSE 'R' END"


_ROLE_COST = "CASE WHEN initial = '{}' THEN 0 ELSE 3 END + late"
_FROM = {"u": ("e", "s", "a"), "a": ("u",)}
_STEP = {r: ", ".join([_plus(r, 4, "'D'"), *(f"CASE WHEN NOT gone THEN {_plus(f, _ROLE_COST.format(r), _turn(r))} END" for f in of)]) for r, of in _FROM.items()}

CONVERSATION_REPAIR = rf"""WITH RECURSIVE said AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), codes AS (
    SELECT k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(k) + 1), lambda i: [CAST(ascii(substr(k, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS hurt
    FROM (SELECT DISTINCT k FROM said)
), rows_after AS (
    SELECT conv_id, turn, CASE WHEN hurt = 4 THEN 'user' ELSE role END AS role, CASE hurt WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE hurt WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM said JOIN codes USING (k)
), placed AS (
    SELECT *, left(role, 1) AS initial, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before
    FROM rows_after WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
    FROM placed
), steps AS (
    SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM judged
), ways AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000' AS e, CAST(NULL AS VARCHAR) AS s, '000004I' AS u, '000008II' AS a FROM conversations
    UNION ALL
    SELECT conv_id, i, e, s, u, least(a, {_plus("u", 4, "'I'")}) FROM (
        SELECT conv_id, i, e, s, least(u, {", ".join(_plus(f, 4, "'I'") for f in "esa")}) AS u, a FROM (
            SELECT w.conv_id, w.i + 1 AS i, {_plus("e", 4, "'D'")} AS e, least({_plus("s", 4, "'D'")}, CASE WHEN NOT gone AND initial = 's' THEN {_plus("e", "late", "'K'")} END) AS s,
                least({_STEP["u"]}) AS u, least({_STEP["a"]}) AS a
            FROM ways w JOIN steps r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = w.i + 1))
), best AS (
    SELECT conv_id, arg_max(least(e, a), i) AS way FROM ways GROUP BY conv_id
), audits AS (
    SELECT conv_id, CAST(left(way, 6) AS BIGINT) AS cost, substr(way, 7) AS audit FROM best
), letters AS (
    SELECT conv_id, j, substr(audit, j, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM audits)
), counted AS (
    SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) - sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS behind
    FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING)
), repaired AS (
    SELECT c.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN behind % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha
    FROM counted c LEFT JOIN placed p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.i = p.i WHERE edit <> 'D' GROUP BY c.conv_id
), figures AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id
)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
    coalesce(sha, sha256('')) AS repaired_sha256
FROM audits a LEFT JOIN figures f ON a.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN repaired r ON a.conv_id IS NOT DISTINCT FROM r.conv_id"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents
), t AS (
    SELECT item_id, {_WORDS} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM t WHERE len(w) > 0)
), places AS (
    SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (
    SELECT r, k, i, item_id FROM places JOIN windows USING (k, win)
), words AS (
    SELECT r, count(DISTINCT i + o) AS n_hit FROM (SELECT r, i, unnest(range(k)) AS o FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r
), items AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""
