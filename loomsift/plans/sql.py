"""SQL for DuckDB: the canonical records and rules as common table expressions, for comparison."""

from __future__ import annotations

import string

from loomsift.functions import secrets
from loomsift.functions.pii import DIGITS, EXCHANGE_555, MAIL, PAYMENT, PHONE, PLACEHOLDERS, RESERVED
from loomsift.functions.text import GARBLED, STRIP_PATTERN
from loomsift.operators.records import SPEAKERS
from loomsift.schema import ROLES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {quoted(STRIP_PATTERN)}, '', 'g')"


MSG = "STRUCT(role VARCHAR, content VARCHAR)[]"
_SPEAKER = "CASE " + " ".join(f"WHEN t.\"from\" = {quoted(k)} THEN {quoted(v)}" for k, v in SPEAKERS.items()) + ' ELSE t."from" END'
_PREFIX = "greatest(0, least(coalesce(nullif(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] IS NOT DISTINCT FROM b[i]), false), 0) - 1, least(len(a), len(b))), len(a) - 1, len(b) - 1))"
_SHAPE = "'[{\"role\":\"VARCHAR\",\"content\":\"VARCHAR\"}]'"

# The SQL engine's patterns have no look-around. So each character that is no part of a word is written twice: one copy
# then serves as the right edge of a match, the other as the left edge of the next, and the edges can be matched outright.
_W = r"[\p{L}\p{N}_]"
_EDGE = r"[^\p{L}\p{N}_]"
_START, _STOP = f"(?:^|{_EDGE})", f"(?:$|{_EDGE})"
_SEP = r"(?:  |\.\.|--)"
_NAME = "[A-Za-z0-9_]"
_MARK = r"(?:\.\.|%%|\+\+|--)"
_DOMAIN = r"@@(?:[A-Za-z0-9]|--)+(?:\.\.(?:[A-Za-z0-9]|--)+)*\.\.[A-Za-z]{2,}"
_TWICE = {
    "email": rf"(?:{_START}({_NAME}(?:{_NAME}|{_MARK})*{_DOMAIN})|{_W}({_MARK}(?:{_NAME}|{_MARK})*{_DOMAIN})){_STOP}",
    "intl": rf"(?:^|[^\p{{L}}\p{{N}}_+])(\+\+[0-9]{{1,3}}(?:{_SEP}?(?:\(\()?[0-9]{{1,4}}(?:\)\))?){{1,5}}){_STOP}",
    "us": rf"{_START}((?:\(\()?[2-9][0-9]{{2}}(?:\)\))?{_SEP}[2-9][0-9]{{2}}{_SEP}[0-9]{{4}}){_STOP}",
    "card": rf"{_START}((?:[0-9](?:  |--)?){{12,18}}[0-9]){_STOP}",
}


def _once(x: str) -> str:
    """A value whose marks stand twice, with each of them once."""
    for c in ".%+-@ ()":
        x = f"replace({x}, {quoted(c + c)}, {quoted(c)})"
    return x


def _length(x: str) -> str:
    """Length of a doubled text as it was."""
    return f"(length({x}) + length(regexp_replace({x}, '{_EDGE}', '', 'g'))) // 2"


def _hits(kind: str, pattern: str) -> str:
    """Rows (id, what, s, e, v) of one pattern over ``doubled``: places counted in the text as it was."""
    groups = f"coalesce(nullif(regexp_extract(whole, {quoted(pattern)}, 1), ''), regexp_extract(whole, {quoted(pattern)}, 2))" if kind == "email" else f"regexp_extract(whole, {quoted(pattern)}, 1)"
    return f"""SELECT id, '{kind}' AS what, {_length("lead")} AS s, {_length("lead || g")} AS e, {_once("g")} AS v, twice FROM (
    SELECT id, twice, g, array_to_string(list_transform(range(1, n + 1), lambda k: gaps[k] || CASE WHEN k < n THEN every[k] ELSE '' END), '') || left(whole, strpos(whole, g) - 1) AS lead FROM (
      SELECT id, twice, n, gaps, every, every[n] AS whole, {groups.replace("whole", "every[n]")} AS g FROM (
        SELECT id, twice, unnest(range(1, len(every) + 1)) AS n, regexp_split_to_array(twice, {quoted(pattern)}) AS gaps, every FROM (
          SELECT id, twice, regexp_extract_all(twice, {quoted(pattern)}, 0) AS every FROM doubled WHERE {"contains(twice, '@@')" if kind == "email" else "numbers"}) WHERE len(every) > 0)))"""


_NUMBER = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) ELSE (CAST(d[i] AS INT) * 2) // 10 + (CAST(d[i] AS INT) * 2) % 10 END)) % 10 = 0"
PERSONAL = f"""
named AS (SELECT row_number() OVER (ORDER BY file, line_no, side, idx) AS id, * FROM slot WHERE contains(content, '@') OR regexp_matches(content, {quoted(DIGITS)})),
doubled AS (SELECT id, regexp_replace(content, '({_EDGE})', '\\1\\1', 'g') AS twice, regexp_matches(content, {quoted(DIGITS)}) AS numbers FROM named),
claimed AS ({" UNION ALL ".join(_hits(k, p) for k, p in _TWICE.items())}),
valid AS (
  SELECT c.id, s, e, v, CASE what WHEN 'email' THEN {quoted(MAIL)} WHEN 'card' THEN {quoted(PAYMENT)} ELSE {quoted(PHONE)} END AS kind, {_NUMBER} AS d, what, left(content, s) AS ahead, substr(content, e + 1) AS behind
  FROM claimed c JOIN named n ON c.id = n.id),
personal AS (
  SELECT id, s, e, v, kind FROM valid WHERE CASE what
    WHEN 'email' THEN NOT regexp_matches(lower(split_part(v, '@', 2)), {quoted(RESERVED)})
    WHEN 'us' THEN substr(d, 4, 3) <> '{EXCHANGE_555}'
    WHEN 'intl' THEN length(d) BETWEEN 8 AND 15 AND NOT regexp_full_match(v, '\\+[0-9]+\\.[0-9]+') AND NOT (length(d) = 11 AND d[1] = '1' AND substr(d, 5, 3) = '{EXCHANGE_555}')
      AND NOT (regexp_matches(ahead, '[0-9)]\\s*$') AND regexp_matches(behind, '^\\s*(?:[=<>*/]|[+-]\\s*[0-9])'))
    ELSE length(d) BETWEEN 13 AND 19 AND d[1] IN ('3', '4', '5', '6') AND len(list_distinct(string_split(d, ''))) > 2 AND {_LUHN} END),
kept AS (
  SELECT id, unnest(list_reduce(list_transform(every, lambda x: [x]), lambda a, x: CASE WHEN x[1].s < a[len(a)].e THEN a ELSE list_concat(a, x) END), recursive := false) AS x
  FROM (SELECT id, list({{'s': s, 'e': e, 'kind': kind, 'v': v}} ORDER BY s, e DESC) AS every FROM personal GROUP BY id)),
r_pii AS (SELECT file, line_no, idx, x.kind AS kind FROM kept k JOIN named n ON k.id = n.id)"""
_PLACE = "CASE x.kind " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in PLACEHOLDERS.items()) + " END"
#: Texts with their personal data replaced: what stands between the kept places, and the placeholders.
REDACTED = f"""redacted AS (
  SELECT n.file, n.line_no, n.side, n.idx, n.content, array_to_string(list(substr(content, since + 1, x.s - since) || {_PLACE} ORDER BY x.s), '') || substr(max(content), CAST(max(x.e) AS BIGINT) + 1) AS redacted
  FROM (SELECT id, x, coalesce(lag(x.e) OVER (PARTITION BY id ORDER BY x.s), 0) AS since FROM kept) k JOIN named n ON k.id = n.id GROUP BY ALL)"""

_RUN = "|".join(f"(?i:{c}){{12,}}" for c in string.ascii_lowercase + string.digits)  # twelve of one character
_SAMPLE = secrets.PLACEHOLDER_SEGMENT.replace(r"(.)\1{11,}", rf"{_RUN}|-{{12,}}|_{{12,}}|/{{12,}}|\+{{12,}}")
_LOOKS = {"OpenAI API key": r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}"}
_ONLY = {"OpenAI API key": "NOT starts_with(v, 'sk-ant-') AND regexp_matches(v, '^sk-[A-Za-z_-]*[0-9]')"}
SECRETS = f"""
hinted AS (SELECT * FROM slot WHERE regexp_matches(content, {quoted(secrets.HINT)})),
r_secrets AS (SELECT file, line_no, idx, kind FROM ({" UNION ALL ".join(f"SELECT file, line_no, idx, {quoted(k)} AS kind, unnest(regexp_extract_all(content, {quoted(_LOOKS.get(k, p))})) AS v FROM hinted" for k, p in secrets.KINDS)})
  WHERE NOT regexp_matches(v, {quoted(_SAMPLE)}) AND CASE kind {" ".join(f"WHEN {quoted(k)} THEN {w}" for k, w in _ONLY.items())} ELSE true END)"""

RECORDS = f"""
rec AS (
  SELECT 'clean' AS file, line_no, 'openai-chat' AS source_format, split, CAST(list_transform(messages, lambda m: {{'role': m.role, 'content': m.content}}) AS {MSG}) AS messages, CAST(NULL AS {MSG}) AS rejected, CAST(NULL AS INT) AS prompt_len FROM clean
  UNION ALL
  SELECT 'sharegpt_clean', line_no, 'sharegpt', NULL, CAST(list_transform(conversations, lambda t: {{'role': {_SPEAKER}, 'content': t.value}}) AS {MSG}), NULL, NULL FROM sharegpt_clean
  UNION ALL
  SELECT 'alpaca_clean', line_no, 'alpaca', split,
    CASE WHEN instruction IS NOT NULL AND output IS NOT NULL THEN CAST(
      list_concat(list_concat(CASE WHEN system <> '' THEN [{{'role': 'system', 'content': system}}] ELSE [] END,
        flatten(list_transform(coalesce(history, []), lambda h: [{{'role': 'user', 'content': h[1]}}, {{'role': 'assistant', 'content': h[2]}}]))),
        [{{'role': 'user', 'content': CASE WHEN input <> '' THEN instruction || chr(10) || chr(10) || input ELSE instruction END}}, {{'role': 'assistant', 'content': output}}]) AS {MSG}) END, NULL, NULL
  FROM alpaca_clean
  UNION ALL
  SELECT 'preference_clean', line_no, 'preference', NULL, CASE WHEN chosen IS NOT NULL AND rejected IS NOT NULL THEN CAST([{{'role': 'user', 'content': prompt}}, {{'role': 'assistant', 'content': chosen}}] AS {MSG}) END,
    CASE WHEN chosen IS NOT NULL AND rejected IS NOT NULL THEN CAST([{{'role': 'assistant', 'content': rejected}}] AS {MSG}) END, CASE WHEN chosen IS NOT NULL AND rejected IS NOT NULL THEN 1 END
  FROM preference_clean WHERE prompt IS NOT NULL
  UNION ALL
  SELECT 'preference_clean', line_no, 'preference', NULL, CASE WHEN n IS NOT NULL THEN a END, CASE WHEN n IS NOT NULL THEN b[n + 1:] END, n
  FROM (SELECT line_no, a, b, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CAST({_PREFIX} AS INT) END AS n
        FROM (SELECT line_no, CAST(from_json(chosen, {_SHAPE}) AS {MSG}) AS a, CAST(from_json(rejected, {_SHAPE}) AS {MSG}) AS b FROM preference_clean WHERE prompt IS NULL))
),
slot AS (
  SELECT file, line_no, side, i - 1 AS idx, m.role AS role, m.content AS content FROM (
    SELECT file, line_no, '' AS side, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM rec
    UNION ALL
    SELECT file, line_no, 'rejected', unnest(rejected), generate_subscripts(rejected, 1) FROM rec)
),
side AS (
  SELECT file, line_no, '' AS side, messages AS turns FROM rec WHERE messages IS NOT NULL
  UNION ALL
  SELECT file, line_no, 'rejected', list_concat(messages[1:prompt_len], rejected) FROM rec WHERE rejected IS NOT NULL
),
turn AS (SELECT file, line_no, side, i - 1 AS idx, m.role AS role, m.content AS content, n FROM (SELECT file, line_no, side, unnest(turns) AS m, generate_subscripts(turns, 1) AS i, len(turns) AS n FROM side)),
spoken AS (SELECT *, lag(role) OVER (PARTITION BY file, line_no, side ORDER BY idx) AS before FROM turn WHERE role <> 'system'),
tokens AS (SELECT file, line_no, max(t) AS tokens FROM (
  SELECT file, line_no, side, CAST(sum(CAST(ceil(length('<' || coalesce(role, '') || '>' || chr(10) || coalesce(content, '')) / 4.0) AS BIGINT) + 4) AS BIGINT) AS t FROM turn GROUP BY ALL) GROUP BY ALL),
keyed AS (
  SELECT file, line_no, split, messages, rejected, prompt_len,
    array_to_string(list_transform(coalesce(messages, []), lambda m: coalesce(m.role, chr(4)) || chr(1) || coalesce({strip("m.content")}, chr(4)) || chr(2)), '')
    || CASE WHEN rejected IS NOT NULL THEN chr(3) || prompt_len || chr(3) || array_to_string(list_transform(rejected, lambda m: coalesce(m.role, chr(4)) || chr(1) || coalesce({strip("m.content")}, chr(4)) || chr(2)), '') ELSE '' END AS full_key
  FROM rec),
prompted AS (
  SELECT *, CASE WHEN messages IS NOT NULL AND cut > 0 THEN array_to_string(list_transform(messages[1:cut], lambda m: coalesce(m.role, chr(4)) || chr(1) || coalesce({strip("m.content")}, chr(4)) || chr(2)), '') END AS prompt_key
  FROM (SELECT *, coalesce(prompt_len, coalesce(list_max(list_transform(range(1, len(messages) + 1), lambda i: CASE WHEN messages[i].role IS DISTINCT FROM 'assistant' THEN i ELSE 0 END)), 0)) AS cut FROM keyed)),
first AS (SELECT file, full_key, min(line_no) AS first_line, count(*) AS n FROM keyed GROUP BY ALL),
r_schema AS (
  SELECT file, line_no, NULL AS idx, 'no messages' AS kind FROM rec WHERE messages IS NULL OR len(messages) = 0
  UNION ALL SELECT file, line_no, idx, 'invalid role' FROM slot WHERE role IS NULL OR role NOT IN ({", ".join(map(quoted, ROLES))})
  UNION ALL SELECT file, line_no, idx, 'no content' FROM slot WHERE content IS NULL),
r_roles AS (
  SELECT file, line_no, idx, CASE WHEN idx = 0 OR (idx = 1 AND (SELECT count(*) FROM turn t WHERE t.file = s.file AND t.line_no = s.line_no AND t.side = s.side AND t.idx = 0 AND t.role = 'system') > 0) THEN 'first role' ELSE 'alternation' END AS kind
  FROM spoken s WHERE role <> CASE WHEN before IS NULL THEN 'user' WHEN before = 'user' THEN 'assistant' ELSE 'user' END
  UNION ALL SELECT file, line_no, idx, 'late system' FROM turn WHERE role = 'system' AND idx > 0
  UNION ALL SELECT file, line_no, idx, 'ends on other' FROM turn WHERE idx = n - 1 AND role <> 'assistant'),
r_empty AS (SELECT file, line_no, idx, 'empty' AS kind FROM slot WHERE {strip("content")} = ''),
r_long AS (SELECT file, line_no, NULL AS idx, 'too long' AS kind FROM tokens WHERE tokens > 4096),
r_duplicates AS (SELECT k.file, k.line_no, NULL AS idx, 'duplicate' AS kind FROM keyed k JOIN first f ON k.file = f.file AND k.full_key = f.full_key WHERE k.line_no > f.first_line),
r_encoding AS (
  SELECT file, line_no, idx, 'byte order mark' AS kind FROM slot WHERE contains(content, chr(65279))
  UNION ALL SELECT file, line_no, idx, 'garbled' FROM slot WHERE {" OR ".join(f"contains(content, {quoted(bad)})" for bad, _ in GARBLED)}),
r_preference AS (
  SELECT file, line_no, NULL AS idx, 'identical sides' AS kind FROM rec WHERE rejected IS NOT NULL AND len(messages) > prompt_len
    AND list_transform(messages[prompt_len + 1:], lambda m: {{'role': m.role, 'content': {strip("m.content")}}}) = list_transform(rejected, lambda m: {{'role': m.role, 'content': {strip("m.content")}}})),
{PERSONAL},
{SECRETS},
finding AS (
  SELECT *, 'schema' AS rule_id, 'error' AS severity, 1 AS rule_order FROM r_schema UNION ALL SELECT *, 'roles', 'error', 2 FROM r_roles UNION ALL SELECT *, 'empty-content', 'error', 3 FROM r_empty
  UNION ALL SELECT *, 'context-window', 'warning', 4 FROM r_long UNION ALL SELECT *, 'duplicates', 'error', 5 FROM r_duplicates UNION ALL SELECT *, 'encoding', 'warning', 6 FROM r_encoding UNION ALL SELECT *, 'preference', 'error', 7 FROM r_preference
  UNION ALL SELECT *, 'secrets', 'error', 8 FROM r_secrets UNION ALL SELECT *, 'pii', 'warning', 9 FROM r_pii)
"""


def over_records(query: str, *more: str) -> str:
    """A query over the tables above and ``more`` of its own."""
    return f"WITH {', '.join((RECORDS.strip(), *more))}\n{query}"


def repaired(x: str) -> str:
    out = f"replace({x}, chr(65279), '')"
    for bad, good in GARBLED:
        out = f"replace({out}, {quoted(bad)}, {quoted(good)})"
    return out
