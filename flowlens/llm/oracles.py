"""DuckDB SQL over the same tables, for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES: dict[str, str] = {}

ORACLES["op1_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
        FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(p) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
        FROM d CROSS JOIN lens, unnest(range(1, len(w) - n + 2)) AS t(p) WHERE len(w) >= n),
hit AS (SELECT DISTINCT rid, p, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
words AS (SELECT rid, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) AS u(q) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN ids USING (rid)
"""


# The contract's base patterns, written out: a fault in the operator's own rules must not pass both.
_BASE_SECRETS = {
    "assign": ("""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
               """|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": ("(AKIA[A-Z0-9]+)", 20),
    "hex": ("([0-9a-f]+)", 24),
}


def _secrets_sql() -> str:
    from flowlens.llm.secrets import BASE_KINDS, RULES

    parts = []
    rules = _BASE_SECRETS | {r.kind: (r.pattern, r.least) for r in RULES if r.kind not in _BASE_SECRETS}
    for k, (kind, (secret, least)) in enumerate(rules.items()):
        pattern = f"(?s)(.*?)({secret})".replace("'", "''")
        got = ", ".join(f"regexp_extract_all(t, '{pattern}', {i}) AS x{i}" for i in (1, 2, 3))
        parts.append(f"SELECT rid, '{kind}' AS kind, {k} AS k, {least} AS least, {got} FROM d")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
x AS (SELECT rid, kind, k, least, unnest(x1) AS gap, unnest(x2) AS hit, unnest(x3) AS held,
             generate_subscripts(x1, 1) AS i FROM m),
p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, k ORDER BY i) AS e FROM x),
f AS (SELECT rid, kind, k, e - length(hit) AS s, kind || ':' || CAST(e - length(hit) AS BIGINT) || ':' || CAST(e AS BIGINT) AS span
      FROM p WHERE length(held) >= least),
g AS (SELECT rid, {counts},
             string_agg(span, ',' ORDER BY s, k) FILTER (k < {len(BASE_KINDS)}) AS base,
             string_agg(span, ',' ORDER BY s, k) AS spans FROM f GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE_KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


ORACLES["op4_secret_ledger"] = _secrets_sql()

ORACLES["op9_ngram_join"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[p:p + 4], ' ') AS g
      FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(p) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE c.n / (x.n + y.n - c.n) >= 0.8),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
least AS (SELECT a, min(doc_id) AS m FROM reach JOIN d ON d.rid = reach.b GROUP BY a),
links AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT doc_id, least(doc_id, m) AS class_id, coalesce(links.n, 0) AS n_links
FROM d LEFT JOIN least ON least.a = rid LEFT JOIN links ON links.a = rid
"""

ORACLES["op7_chat_snapshots"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list(turn || chr(1) || role || chr(2) || text ORDER BY turn, role, text) AS l,
             string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10), ''
                        ORDER BY turn, role, text) AS rendered FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT array_to_string(l[1:k], chr(3)) AS s FROM c, unnest(range(1, n)) AS u(k)),
w AS (SELECT min(conv_id) AS conv_id, array_to_string(l, chr(3)) AS s FROM c GROUP BY 2)
SELECT conv_id, CAST(0 AS BIGINT) AS chunk, n AS turns, n AS conversation_turns, rendered
FROM c JOIN w USING (conv_id) WHERE s NOT IN (SELECT s FROM p)
"""

ORACLES["op10_spherical_cells"] = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT rid, vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND list_dot_product(e, e) > 0),
k AS (SELECT a.rid AS a, b.rid AS b FROM g a JOIN g b
      ON a.rid <> b.rid AND list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.9),
reach(a, b) AS (SELECT a, b FROM k UNION SELECT reach.a, k.b FROM reach JOIN k ON reach.b = k.a),
low AS (SELECT a, min(vec_id) AS m FROM reach JOIN v ON v.rid = reach.b GROUP BY a),
n AS (SELECT a, count(*) AS n FROM k GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, m) AS component_id, vec_id = least(vec_id, m) AS kept
FROM v LEFT JOIN low ON low.a = rid LEFT JOIN n ON n.a = rid
"""


def _repair_sql() -> str:
    # one row's ways from a state (0 start, 1 system, 2 user, 3 assistant): up to
    # two insertions, then D, K or R; symbols are initial * 2 + truncated, 8 must go
    follow = {0: 2, 1: 2, 2: 3, 3: 2}
    ways = []
    for q in range(4):
        at, before = q, ""
        for n in range(3):
            for symbol in range(9):
                cut = symbol % 2
                ways.append((q, symbol, at, 2 * n + 3, before + "D"))
                if symbol < 8:
                    ways.append((q, symbol, follow[at], 2 * n + 2 + cut, before + "R"))
                    kept = {0: 1 if at == 0 else None, 1: 2 if at != 2 else None, 2: 3 if at == 2 else None}.get(symbol // 2)
                    if kept:
                        ways.append((q, symbol, kept, 2 * n + cut, before + "K"))
            at, before = follow[at], before + "I"
    values = ", ".join(f"({q}, {s}, {to}, {c}, '{e}')" for q, s, to, c, e in ways)
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
           string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
           lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
           lambda c, e: CASE WHEN xor(c, e) % 2 = 1 THEN xor(xor(c, e) // 2, 3988292384) ELSE xor(c, e) // 2 END)) % 20 AS m
  FROM conversations),
r AS (
  SELECT conv_id, turn, CASE m WHEN 4 THEN 'user' ELSE role END AS role,
         CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, unnest(range(CASE m WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS u(copy)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         rtrim(text, {space}) AS t FROM r),
f AS (
  SELECT *, t = '' AS blank, t <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
         position(left(role, 1) IN 'sua') - 1 AS c FROM o),
s AS (
  SELECT *, NOT blank AND NOT dup AND right(t, 1) NOT IN ('.', '!', '?') AS cut,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN c ELSE 3 END AS initial FROM f),
y AS (
  SELECT *, CASE WHEN blank OR dup THEN 8 ELSE 2 * initial + CAST(cut AS INT) END AS symbol,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) * 10 + initial AS pair FROM s),
way(q, symbol, q2, cost, edits) AS (VALUES {values}),
c AS (
  SELECT conv_id, count(*) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
         count(*) FILTER (cut) AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN (1, 12, 21)) AS illegal,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM y GROUP BY conv_id),
p(conv_id, i, q, best) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} FROM c
  UNION ALL
  SELECT p.conv_id, p.i + 1, way.q2, min({{'cost': p.best.cost + way.cost, 'audit': p.best.audit || way.edits}})
  FROM p JOIN y ON p.conv_id IS NOT DISTINCT FROM y.conv_id AND y.i = p.i + 1 JOIN way ON way.q = p.q AND way.symbol = y.symbol
  GROUP BY p.conv_id, p.i, way.q2),
e AS (
  SELECT p.conv_id, min({{'cost': best.cost + CASE q WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END,
                        'audit': best.audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS best
  FROM p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n GROUP BY p.conv_id),
l AS (
  SELECT conv_id, j, best.audit[j] AS edit, length(replace(best.audit[1:j], 'I', '')) AS i,
         length(replace(best.audit[1:j], 'D', '')) AS place
  FROM e, unnest(range(1, length(best.audit) + 1)) AS u(j)),
w AS (
  SELECT l.*, y.role AS old, y.text, y.initial,
         max(CASE WHEN place = 1 AND edit = 'K' AND y.initial = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS shift
  FROM l LEFT JOIN y ON l.conv_id IS NOT DISTINCT FROM y.conv_id AND l.i = y.i AND l.edit IN ('K', 'R') WHERE edit <> 'D'),
g AS (
  SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN old ELSE CASE (place - shift) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
                             || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS whole
  FROM w GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(e.best.cost, 0) AS cost,
       coalesce(e.best.audit, '') AS audit, sha256(coalesce(g.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id
"""


ORACLES["op11_run_length_repair"] = _repair_sql()


def _licenses_sql() -> str:
    from flowlens.llm.license_scan import SLACK, TEMPLATES

    phrases, whole = [], []
    for t, template in enumerate(TEMPLATES):
        whole.append(f"({t}, '{template.label}', {str(template.base).lower()}, {len(template.keys)})")
        for k, (at, words) in enumerate(template.placed()):
            phrases.append(f"({t}, {k}, {at}, {len(words)}, '{' '.join(words)}')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
template(t, label, base, n_keys) AS (VALUES {', '.join(whole)}),
phrase(t, k, place, n, words) AS (VALUES {', '.join(phrases)}),
lens AS (SELECT DISTINCT n FROM phrase),
pos AS (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
        FROM d CROSS JOIN lens, unnest(range(1, len(w) - n + 2)) AS u(p) WHERE len(w) >= n),
hit AS (SELECT rid, t, k, p - 1 AS start, p - 1 - place AS begins FROM pos JOIN phrase ON pos.n = phrase.n AND g = words),
held AS (SELECT a.rid, a.t, a.begins, count(DISTINCT b.k) AS n
         FROM (SELECT DISTINCT rid, t, begins FROM hit) a
         JOIN hit b ON a.rid = b.rid AND a.t = b.t AND b.begins BETWEEN a.begins AND a.begins + {SLACK} GROUP BY 1, 2, 3),
found AS (SELECT rid, max(n / n_keys) AS score,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (n = n_keys) AS labels
          FROM held JOIN template USING (t) GROUP BY rid),
basic AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
          FROM hit JOIN template USING (t) WHERE base GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN found USING (rid) LEFT JOIN basic USING (rid)
"""


ORACLES["op12_rare_token_licenses"] = _licenses_sql()

ORACLES["op13_accumulator_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
i AS (SELECT row_number() OVER () AS iid, item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT iid, t, count(*) AS times FROM (SELECT iid, unnest(w) AS t FROM i) GROUP BY 1, 2),
p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY 1, 2),
v AS (SELECT t, CAST(floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM p, c WHERE t IN (SELECT t FROM q) GROUP BY t, c.n),
m AS (SELECT rid, doc_id, 25 + (75 * len(w) * c.n) // c.l AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT iid, rid, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN v USING (t) JOIN p USING (t) JOIN m USING (rid) GROUP BY iid, rid),
r AS (SELECT iid, doc_id, score, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank
      FROM s JOIN d USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (iid) WHERE rank <= 10
"""
