"""SQL of the training-data queries that SQL can express, for DuckDB."""

from __future__ import annotations

from .chat import CLOSE, OPEN, ROLE_END
from .license_rules import parsed
from .licenses import compiled
from .quality_rules import DELTA, RISK, RULES, STRATA

_CONTROL = r"'[<\[]\\*(?:/?s>|/?INST\])'"
_escaped = lambda c: f"length({c}) + len(regexp_extract_all({c}, {_CONTROL}))"

CHAT = f"""WITH r AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]', NULL), (-1, 1, 'assistant', '</s>[INST] ok [/INST]', NULL))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + ROLE_END + CLOSE)} + {_escaped('role')} + {_escaped('text')}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id, alone"""

#: What each layout makes of a role ``r`` and a text ``t``, in the order of the mappings; hashes of the sorted paths are in it as text.
_SAYS = (
    (("role", "text"), "r || chr(10) || t || chr(10)", 1),
    (("content", "role"), "r || chr(10) || t || chr(10)", 1),
    (("messages[].content", "messages[].role"), "repeat(r || chr(10) || t || chr(10), 2)", 2),
    (("messages[].role", "messages[].text"), "repeat(r || chr(10) || t || chr(10), 2)", 2),
    (("conversations[].from", "conversations[].value"), "repeat(CASE r WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE r END || chr(10) || t || chr(10), 2)", 2),
    (("completion", "prompt"), "'user' || chr(10) || t || chr(10) || 'assistant' || chr(10) || t || chr(10)", 2),
    (("prompt", "response"), "'user' || chr(10) || t || chr(10) || 'assistant' || chr(10) || t || chr(10)", 2),
    (("instruction", "output"), "'user' || chr(10) || t || chr(10) || 'assistant' || chr(10) || t || chr(10)", 2),
    (("input", "instruction", "output"), "'user' || chr(10) || t || CASE WHEN t = '' THEN '' ELSE chr(10) || chr(10) || t END || chr(10) || 'assistant' || chr(10) || t || chr(10)", 2),
    (("answer", "question"), "'user' || chr(10) || t || chr(10) || 'assistant' || chr(10) || t || chr(10)", 2),
    (("question", "response", "system_prompt"), "'system' || chr(10) || t || chr(10) || 'user' || chr(10) || t || chr(10) || 'assistant' || chr(10) || t || chr(10)", 3),
)
_case = lambda place: " ".join(f"WHEN {i} THEN {place(x)}" for i, x in enumerate(_SAYS))
LAYOUTS = f"""WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS r, coalesce(text, '') AS t, (CAST(conv_id AS BIGINT) + CAST(turn AS BIGINT)) % {len(_SAYS) + 1} AS k FROM conversations)
SELECT conv_id, turn, sha256(CASE k {_case(lambda x: "'" + "' || chr(10) || '".join(x[0]) + "'")} ELSE 'other' END) AS layout,
  CASE k {_case(lambda x: str(x[2]))} END AS n_turns, sha256(CASE k {_case(lambda x: x[1])} END) AS turns_sha256
FROM c"""


def quality() -> str:
    """Counts, the cutoffs of every stratum from the exact binomial distribution, and the verdicts."""
    part = RISK / len(RULES)
    level = DELTA / (len(RULES) * (len(STRATA) + 1))
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
    tests = " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST({c} AS DOUBLE) AS cut, stratum, count(*) AS n, count(*) FILTER ({r} > {c}) AS k FROM good GROUP BY stratum" for r, cs in RULES.items() for c in cs)
    rejects = ", ".join(f"CASE WHEN {r} > (SELECT cut FROM cuts c WHERE c.rule = '{r}' AND c.stratum = s.stratum) THEN '{r}' END" for r in RULES)
    strata = ", ".join(f"'{x}'" for x in STRATA)
    return rf"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, list_value(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
rep AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(list_value(i, i + 1, i + 2)) AS place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
m AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS n_upper FROM t LEFT JOIN rep USING (doc_id)),
s AS (SELECT *, {share('n_symbols', 'word_chars')} AS symbol_share, {share('n_dup_lines', 'n_lines')} AS dup_line_share, {share('n_repeat_words', 'n_words')} AS repeat_share, {share('n_upper', 'word_chars')} AS upper_share, {share('word_chars', 'n_words')} AS long_words, CASE WHEN lang IN ({strata}) THEN lang ELSE 'other' END AS stratum, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
good AS (SELECT * FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tests AS ({tests}),
bounds AS (SELECT rule, cut, stratum, k <= {part} * n AND (SELECT sum(exp(lgamma(n + 1) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END - CASE WHEN j < n THEN lgamma(n - j + 1) ELSE 0 END + j * ln({part}) + (n - j) * ln(1 - {part}))) FROM (SELECT unnest(range(0, k + 1)) AS j)) <= {level} AS ok FROM tests),
cuts AS (SELECT rule, stratum, min(cut) AS cut FROM bounds WHERE ok GROUP BY 1, 2),
v AS (SELECT *, concat_ws(',', {rejects}) AS rejected_by FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM v"""


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR = rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
r AS (SELECT x AS doc_id, x AS reach FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x),
c AS (SELECT doc_id, min(reach) AS least FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def licenses() -> str:
    """The same ordered rules as a table, met with numbered words; a detection goes if one before it holds it."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({i}, {quoted(label)}, {p}, [{', '.join(map(quoted, gates))}], {quoted(compiled(pattern))}, {str(base).lower()})" for i, (label, p, gates, pattern, base) in enumerate(parsed()))
    return rf"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
rules(ord, label, p, gates, regex, base) AS (VALUES {rules}),
m AS (SELECT doc_id, ord, label, p, base, unnest(regexp_extract_all(array_to_string(list_transform(w, lambda x, i: ' ' || x || ':' || (i - 1) || ' '), ''), regex)) AS hit FROM t JOIN rules ON list_has_all(w, gates)),
d AS (SELECT *, CAST(regexp_extract(hit, ':([0-9]+)', 1) AS BIGINT) AS a, CAST(regexp_extract(hit, ':([0-9]+) $', 1) AS BIGINT) AS b FROM m),
k AS (SELECT * FROM d WHERE base OR NOT EXISTS (SELECT 1 FROM d e WHERE e.doc_id = d.doc_id AND e.a <= d.a AND e.b >= d.b AND e.p >= d.p AND (e.a < d.a OR e.b > d.b OR e.p > d.p OR e.ord < d.ord))),
g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(p) / 3.0 AS score FROM k GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM t LEFT JOIN g USING (doc_id)"""
