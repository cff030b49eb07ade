"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quality_rules import RULES

#: Parameters of the mixing queries: sources are nearly even, so their budget is what cuts; of languages, the entropy and then the limit on repeats binds.
MIXING = {
    "op6_mixing": {"source": "source", "budget": 1.5, "target_entropy": 0.95, "max_repeats": 4.0},
    "mixing_languages_by_entropy": {"source": "lang", "budget": 1.0, "target_entropy": 0.95, "max_repeats": 4.0},
    "mixing_languages_by_repeats": {"source": "lang", "budget": 1.0, "target_entropy": 0.99, "max_repeats": 1.4},
}

_TOKENS = r"REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+')"
_LOW = "TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOW_TOKENS = rf"REGEXP_EXTRACT_ALL({_LOW}, '[^\x20\x09-\x0D]+')"
_LOW_WORDS = r"REGEXP_EXTRACT_ALL(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = """WITH d AS (SELECT doc_id, HEX(ENCODE(COALESCE(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, LENGTH(h) // 2 AS n FROM d),
 w AS (SELECT doc_id, UNNEST(RANGE(0, n - 199)) AS i, h FROM n WHERE n >= 200), k AS (SELECT doc_id, i, MD5(SUBSTR(h, CAST(2 * i + 1 AS BIGINT), 400)) AS m FROM w),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY m) AS c FROM k) x WHERE c > 1), e AS (SELECT doc_id, i, LAG(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r),
 s AS (SELECT doc_id, i, SUM(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM e), runs AS (SELECT doc_id, MIN(i) AS a, MAX(i) + 200 AS b FROM s GROUP BY doc_id, g),
 cut AS (SELECT runs.doc_id, a, b, SUBSTR(h, CAST(2 * COALESCE(LAG(b) OVER (PARTITION BY runs.doc_id ORDER BY a), 0) + 1 AS BIGINT), CAST(2 * (a - COALESCE(LAG(b) OVER (PARTITION BY runs.doc_id ORDER BY a), 0)) AS BIGINT)) AS piece FROM runs JOIN n ON n.doc_id = runs.doc_id),
 per AS (SELECT doc_id, SUM(b - a) AS n_removed, COUNT(*) AS n_spans, STRING_AGG(piece, '' ORDER BY a) AS front, MAX(b) AS last FROM cut GROUP BY doc_id)
SELECT n.doc_id, n AS n_bytes, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans, SHA256(UNHEX(COALESCE(front || SUBSTR(h, CAST(2 * last + 1 AS BIGINT)), h))) AS kept_sha256 FROM n LEFT JOIN per ON per.doc_id = n.doc_id"""

OP4 = rf"""WITH w AS (SELECT doc_id, COALESCE(text, '') AS text, {_TOKENS} AS words FROM documents),
 g AS (SELECT doc_id, UNNEST(RANGE(1, LEN(words) - 6)) AS i, words FROM w WHERE LEN(words) >= 8), k AS (SELECT doc_id, i, ARRAY_TO_STRING(words[i : i + 7], ' ') AS gram FROM g),
 twice AS (SELECT doc_id, i FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, gram) AS c FROM k) x WHERE c > 1), hit AS (SELECT doc_id, COUNT(DISTINCT i + j) AS n FROM twice, (SELECT UNNEST(RANGE(0, 8)) AS j) o GROUP BY doc_id),
 l AS (SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) - COUNT(DISTINCT line) AS n_dup FROM (SELECT doc_id, UNNEST(STRING_SPLIT(text, chr(10))) AS line FROM w) y WHERE REGEXP_MATCHES(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
 m AS (SELECT w.doc_id, LEN(words) AS n_words, LENGTH(REGEXP_REPLACE(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, LENGTH(REGEXP_REPLACE(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, COALESCE(n_dup, 0) AS n_dup_lines, COALESCE(n_lines, 0) AS n_lines, COALESCE(hit.n, 0) AS n_repeat_words,
 LENGTH(REGEXP_REPLACE(text, '[^A-Z]', '', 'g')) AS n_upper, LENGTH(REGEXP_REPLACE(text, '[^!]', '', 'g')) AS n_exclaim FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN hit ON hit.doc_id = w.doc_id),
 b AS (SELECT *, CAST(n_words < 20 AS INT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS INT) + 4 * CAST(10 * n_symbols > n_words AS INT) + 8 * CAST(n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines AS INT) + 16 * CAST(10 * n_upper > 4 * word_chars AS INT) + 32 * CAST(10 * n_exclaim > n_words AS INT) + 64 * CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS INT) AS f FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (f & 3) <> 0 AS base_failed, f = 0 AS kept, CAST(f AS BIGINT) AS failed FROM b"""

OP5 = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_LOW_TOKENS} AS words FROM documents), g AS (SELECT doc_id, UNNEST(RANGE(1, GREATEST(LEN(words) - 4, 1) + 1)) AS i, words FROM w WHERE LEN(words) > 0),
 s AS (SELECT DISTINCT doc_id, ARRAY_TO_STRING(words[i : i + 4], ' ') AS shingle FROM g), n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2), e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
 reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y)
SELECT w.doc_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_shingles, COALESCE(m.c, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT x, MIN(y) AS c FROM reach GROUP BY x) m ON m.x = w.doc_id"""

OP7 = rf"""WITH b AS (SELECT item_id, {_LOW_WORDS} AS words FROM benchmark), bw AS (SELECT DISTINCT item_id, LEAST(LEN(words), 10) AS size, ARRAY_TO_STRING(words[i : i + LEAST(LEN(words), 10) - 1], ' ') AS gram FROM (SELECT *, UNNEST(RANGE(1, LEN(words) - LEAST(LEN(words), 10) + 2)) AS i FROM b WHERE LEN(words) > 0) x),
 d AS (SELECT doc_id, {_LOW_WORDS} AS words FROM documents), dw AS (SELECT doc_id, size, i, ARRAY_TO_STRING(words[i : i + size - 1], ' ') AS gram FROM (SELECT d.doc_id, words, size, UNNEST(RANGE(1, LEN(words) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) z WHERE LEN(words) >= size) x),
 h AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON bw.size = dw.size AND bw.gram = dw.gram), c AS (SELECT doc_id, COUNT(DISTINCT i + j) AS n_hit FROM h, (SELECT UNNEST(RANGE(0, 10)) AS j) o WHERE j < size GROUP BY doc_id),
 t AS (SELECT doc_id, COUNT(*) AS n_items, STRING_AGG(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) x GROUP BY doc_id)
SELECT d.doc_id, CAST(LEN(words) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, SHA256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""



def mixing_sql(source: str = "source", budget: float = 1.0, target_entropy: float = 0.95, max_repeats: float = 4.0) -> str:
    """Bisects the exponent for the entropy, then for the limit on repeats if that binds; then the blocks."""
    w = "POWER(p / top, {a}) / SUM(POWER(p / top, {a})) OVER ()"
    mid = w.format(a="((lo + hi) / 2)")
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, COALESCE({source}, '') AS source, LEN(REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
 s AS (SELECT *, MAX(p) OVER () AS top, CAST(FLOOR(all_tokens * {budget}) AS BIGINT) AS spend FROM (SELECT source, SUM(n_tokens) AS n, SUM(SUM(n_tokens)) OVER () AS all_tokens, SUM(n_tokens) / SUM(SUM(n_tokens)) OVER () AS p FROM d WHERE n_tokens > 0 GROUP BY source) z),
 bis(k, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT k + 1, CASE WHEN h >= {target_entropy} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN h >= {target_entropy} THEN hi ELSE (lo + hi) / 2 END FROM bis, LATERAL (SELECT -SUM(w * LN(w)) / LN(COUNT(*)) AS h FROM (SELECT {mid} AS w FROM s) q) z WHERE k < 60),
 rep(k, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT k + 1, CASE WHEN m > {max_repeats} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN m > {max_repeats} THEN hi ELSE (lo + hi) / 2 END FROM rep, LATERAL (SELECT MAX(w * spend / n) AS m FROM (SELECT n, spend, {mid} AS w FROM s) q) z WHERE k < 60),
 e AS (SELECT CASE WHEN (SELECT -SUM(p * LN(p)) / LN(COUNT(*)) FROM s) >= {target_entropy} THEN 1.0 ELSE (SELECT lo FROM bis WHERE k = 60) END AS e),
 a AS (SELECT CASE WHEN (SELECT MAX(w * spend / n) FROM (SELECT n, spend, {w.format(a="e")} AS w FROM s, e) q) > {max_repeats} THEN GREATEST(e, (SELECT lo FROM rep WHERE k = 60)) ELSE e END AS a FROM e),
 w AS (SELECT source, n, spend, {w.format(a="a")} AS weight FROM s, a), v AS (SELECT source, n, weight, CAST(ROUND_EVEN(weight * spend, 0) AS BIGINT) AS part FROM w),
 b AS (SELECT source, n, weight, part, UNNEST(RANGE(0, CAST(CEIL(part / n) AS BIGINT))) AS block FROM v),
 r AS (SELECT doc_id, d.source, n_tokens, block, weight, LEAST(n, part - block * n) AS quota, SUM(n_tokens) OVER (PARTITION BY d.source, block ORDER BY MD5('mix|' || block || '|' || doc_id), doc_id, n_tokens) - n_tokens AS offset_ FROM d JOIN b ON b.source = d.source WHERE n_tokens > 0)
SELECT doc_id, source, n_tokens, CAST(block AS INTEGER) AS block, CAST(offset_ AS BIGINT) AS "offset", ROUND(weight, 9) AS weight FROM r WHERE offset_ < quota"""


LICENSE_PATHS = r"""WITH d AS (SELECT doc_id, text, COALESCE(source, '') || '/' || CAST(doc_id // 10000 AS VARCHAR) || '/' || CAST(doc_id // 1000 AS VARCHAR) AS dir, CASE WHEN CONTAINS(text, 'Apache License') THEN 'Apache-2.0' WHEN CONTAINS(text, 'MIT License') THEN 'MIT' END AS own FROM documents),
 s AS (SELECT dir, MIN(own) AS said FROM d WHERE own IS NOT NULL AND LENGTH(text) < 1000 GROUP BY dir), dirs AS (SELECT DISTINCT dir AS own_dir, STRING_SPLIT(dir, '/') AS parts FROM d),
 a AS (SELECT own_dir, n AS depth, ARRAY_TO_STRING(parts[1 : n], '/') AS dir FROM (SELECT own_dir, parts, UNNEST(RANGE(1, LEN(parts) + 1)) AS n FROM dirs) x),
 m AS (SELECT own_dir, a.dir, depth, said, ROW_NUMBER() OVER (PARTITION BY own_dir ORDER BY depth DESC) AS r FROM a JOIN s ON s.dir = a.dir)
SELECT doc_id, d.dir || '/' || doc_id || '.txt' AS path, COALESCE(own, said) AS license, CASE WHEN own IS NULL THEN m.dir END AS inherited_from, CASE WHEN own IS NULL THEN depth END AS depth FROM d LEFT JOIN m ON m.own_dir = d.dir AND r = 1"""

_BITS = ", ".join(f"({2**i}, '{name}')" for i, name in enumerate(RULES))
ABLATIONS = f"""WITH f AS (SELECT failed FROM ({OP4}) x)
SELECT rule, CAST(SUM(CASE WHEN failed & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(SUM(CASE WHEN failed = bit THEN 1 ELSE 0 END) AS BIGINT) AS n_only, CAST(SUM(CASE WHEN failed & ({2 ** len(RULES) - 1} - bit) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept_without
 FROM f, (VALUES {_BITS}) AS r(bit, rule) GROUP BY rule"""

ORACLE_SQL = {"op3_suffix_dedup": OP3, "op4_quality_rules": OP4, "quality_rule_ablations": ABLATIONS, "op5_ngram_join": OP5, "op6_mixing": mixing_sql(**MIXING["op6_mixing"]), "mixing_languages_by_entropy": mixing_sql(**MIXING["mixing_languages_by_entropy"]), "mixing_languages_by_repeats": mixing_sql(**MIXING["mixing_languages_by_repeats"]), "op7_decontamination": OP7, "license_inheritance": LICENSE_PATHS}


def _after(state: str, letter: str, cost: str, line: str | None) -> str:
    """A state with one more edit, and one more repaired row if there is one; null stays null."""
    body = f"{state}.body" if line is None else f"CASE WHEN {state}.body IS NULL THEN {line} ELSE {state}.body || chr(10) || {line} END"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'body': {body}}} END"


def _least(*choices: str) -> str:
    return f"list_min([{', '.join(choices)}])"


def _repair_sql() -> str:
    """Checksums bit by bit, then a recursion over the rows of each conversation with the best edits by state."""
    keep, user, assistant = "r.role || ':' || r.text", "'user:' || r.text", "'assistant:' || r.text"
    extra = "CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END"
    may = lambda initial, state: f"CASE WHEN r.may AND r.initial = '{initial}' THEN {_after(state, 'K', extra, keep)} END"
    turned = lambda state, line: f"CASE WHEN r.may THEN {_after(state, 'R', f'3 + {extra}', line)} END"
    gone = lambda state: _after(state, "D", "4", None)
    after_row = {
        "z": gone("z"), "s": _least(gone("s"), may("s", "z")), "a": _least(gone("a"), may("a", "u"), turned("u", assistant)),
        "u": _least(gone("u"), *(may("u", q) for q in "zsa"), *(turned(q, user) for q in "zsa")),
    }
    kind = "STRUCT(cost BIGINT, audit VARCHAR, body VARCHAR)"
    return f"""WITH RECURSIVE crc_table AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)) x),
named AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text, COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
drawn AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda ch: CAST(unicode(ch) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 20 AS draw FROM named, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, UNNEST(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE draw <> 0),
placed AS (SELECT *, left(role, 1) AS initial, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, COALESCE(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), FALSE) AS wrong FROM placed),
faults AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM seen),
r AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS may FROM faults),
totals AS (SELECT conv_id, count(*) AS n, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (wrong) AS illegal FROM r GROUP BY conv_id),
steps AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST({{'cost': 0, 'audit': '', 'body': NULL}} AS {kind}) AS z, CAST(NULL AS {kind}) AS s, CAST({{'cost': 3, 'audit': 'I', 'body': 'user:'}} AS {kind}) AS u, CAST({{'cost': 6, 'audit': 'II', 'body': 'user:' || chr(10) || 'assistant:'}} AS {kind}) AS a FROM totals
UNION ALL SELECT conv_id, i, z, s, u, {_least('a', _after('u', 'I', '3', "'assistant:'"))} AS a FROM (SELECT conv_id, i, z, s, a, {_least('u', *(_after(q, 'I', '3', "'user:'") for q in 'zsa'))} AS u FROM (SELECT p.conv_id AS conv_id, r.i AS i, {', '.join(f'{text} AS new_{q}' for q, text in after_row.items())} FROM steps p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1) x(conv_id, i, z, s, a, u)) y),
ends AS (SELECT steps.conv_id AS conv_id, list_min([z, a]) AS best FROM steps JOIN totals ON totals.conv_id IS NOT DISTINCT FROM steps.conv_id AND totals.n = steps.i)
SELECT c.conv_id AS conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, COALESCE(best.cost, 0) AS cost, COALESCE(best.audit, '') AS audit, sha256(COALESCE(best.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE_SQL["op11_conversation_repair"] = _repair_sql()
