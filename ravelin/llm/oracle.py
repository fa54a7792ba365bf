"""DuckDB SQL for the corpus queries that SQL can express.

The others (token ids, kernels, chunk hashes, whole texts by byte) are tested against brute force in tests/llm.
"""

from ravelin.llm.conversation import BROKEN_OFF, DELETE, INSERT, KEEP, REROLE
from ravelin.llm.divergence import LEAST_DOCS, PRIOR, SCALE, TOP
from ravelin.llm.quality_lines import LEAST_LEFT, MIN_DOCS, MOST, SHARE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

_TOPK = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_NEAR = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles AS a JOIN shingles AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)
), pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS root FROM sizes UNION SELECT pairs.b, reach.root FROM reach JOIN pairs ON pairs.a = reach.doc_id
), least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""

_LINES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, '=' || source AS source FROM documents),
lines AS (
  SELECT doc_id, coalesce(source, '') AS host, md5(t) AS text_key, unnest(string_split(t, chr(10))) AS line FROM d
), good AS (
  SELECT doc_id, host, text_key, line, regexp_extract_all(translate(line, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM lines
), keyed AS (SELECT *, array_to_string(w, ' ') AS k, len(w) AS n FROM good WHERE len(w) > 0),
docs_of AS (SELECT coalesce(source, '') AS host, count(DISTINCT md5(t)) AS host_docs FROM d GROUP BY 1),
often AS (
  SELECT host, k FROM keyed JOIN docs_of USING (host) GROUP BY host, k, host_docs
  HAVING count(DISTINCT text_key) > {MIN_DOCS} AND host_docs > {MIN_DOCS} AND count(DISTINCT text_key) > least({SHARE} * host_docs, {MOST})
), removed AS (SELECT doc_id, sum(n)::BIGINT AS n_removed_words FROM keyed JOIN often USING (host, k) GROUP BY doc_id),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM keyed GROUP BY doc_id),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w FROM d),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM windows),
covered AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS o) WHERE c > 1 GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= {LEAST_LEFT} * n_words AS kept
FROM base
"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

_AUDIT = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS w FROM documents
), words AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
counted AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
whole AS (SELECT lang, term, sum(c) AS c FROM counted GROUP BY lang, term),
sizes AS (SELECT lang, count(*) AS v, sum(c) AS n FROM whole GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(n, 0) AS n, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) AS g LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counted GROUP BY lang, source) USING (lang, source)
    LEFT JOIN (SELECT lang, v FROM sizes) USING (lang)
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + ({SCALE}::HUGEINT * (coalesce(c, 0) + {PRIOR})) // (n + {PRIOR} * v) AS p
  FROM groups AS g JOIN kept AS k USING (lang) LEFT JOIN counted AS x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM grid AS a JOIN grid AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair AS x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT g.lang, g.source, 'term' AS part, g.term AS item, (p - (1 + ({SCALE}::HUGEINT * (w.c + {PRIOR})) // (s.n + {PRIOR} * s.v)))::BIGINT AS value
  FROM grid AS g JOIN whole AS w USING (lang, term) JOIN sizes AS s ON s.lang = g.lang WHERE g.c > 0
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms WHERE value > 0)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""


def _repair() -> str:
    """Edits from the last row back: of each state the least cost and, of those as cheap, the least letters, as one string."""

    def add(cost: str, letters: str, rest: str) -> str:
        return f"lpad((substr({rest}, 1, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || '{letters}' || substr({rest}, 11)"

    onward = (2, 2, 3, 2)  # states: 0 start, 1 system, 2 user, 3 assistant
    kept = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    row, put = [], []
    for x in range(4):
        keep = " ".join(f"WHEN c = '{c}' THEN {add(f'({KEEP} + {BROKEN_OFF} * t)', 'K', f'w{to}')}" for c, to in kept[x].items())
        other = f"CASE WHEN NOT gone THEN CASE {keep} END END, CASE WHEN NOT gone THEN {add(f'({REROLE} + {BROKEN_OFF} * t)', 'R', f'w{onward[x]}')} END"
        row.append(f"least({add(str(DELETE), 'D', f'w{x}')}, {other}) AS h{x}")
        put.append(f"least(h{x}, {add(str(INSERT), 'I', f'h{onward[x]}')}, {add(str(2 * INSERT), 'II', f'h{onward[onward[x]]}')}) AS w{x}")
    white = " || ".join(f"chr({b})" for b in (32, 9, 10, 11, 12, 13))
    return f"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), dealt AS (
  SELECT keyed.*, xor(list_reduce([4294967295]::BIGINT[] || list_transform(string_split(k, ''), lambda b: ascii(b)::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM keyed, tab
), harmed AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS again FROM dealt WHERE h <> 0
), placed AS (
  SELECT *, coalesce(conv_id::VARCHAR, '') AS cid, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i, count(*) OVER (PARTITION BY conv_id) AS size,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS nth, trim(text, {white}) AS inside FROM harmed
), faults AS (
  SELECT *, CASE WHEN inside = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(inside, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS past FROM placed
), back AS (
  SELECT DISTINCT cid, size + 1 AS i, '0000000000' AS w0, '{2 * INSERT:010d}II' AS w1, '{INSERT:010d}I' AS w2, '0000000000' AS w3 FROM faults
  UNION ALL
  SELECT cid, i, {", ".join(put)} FROM (
    SELECT cid, i, {", ".join(row)} FROM (
      SELECT f.cid, f.i, left(f.role, 1) AS c, (f.fault = 3)::INTEGER AS t, f.fault IN (1, 2) AS gone, w0, w1, w2, w3 FROM back JOIN faults AS f ON f.cid = back.cid AND f.i = back.i - 1))
), best AS (SELECT cid, substr(w0, 1, 10)::BIGINT AS cost, substr(w0, 11) AS audit FROM back WHERE i = 1),
repaired AS (
  SELECT cid, 0 AS k, 1::BIGINT AS i, 0 AS state, NULL::VARCHAR AS line, audit FROM best
  UNION ALL
  SELECT r.cid, r.k + 1, r.i + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE WHEN e = 'D' THEN state WHEN e = 'K' THEN CASE left(f.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END WHEN state = 2 THEN 3 ELSE 2 END,
    CASE WHEN e = 'K' THEN f.role || ':' || f.text WHEN e IN ('I', 'R') THEN CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN f.text ELSE '' END END, audit
  FROM (SELECT *, substr(audit, k + 1, 1) AS e FROM repaired WHERE k < length(audit)) AS r LEFT JOIN faults AS f ON f.cid = r.cid AND f.i = r.i
), texts AS (SELECT cid, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE line IS NOT NULL) AS whole FROM repaired GROUP BY cid),
counts AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (past IS NOT NULL AND left(past, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY cid
), every AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS cid FROM conversations)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM every LEFT JOIN counts USING (cid) LEFT JOIN best USING (cid) LEFT JOIN texts USING (cid)
"""


ORACLE: dict[str, str] = {"op3_topk": _TOPK, "op7_minhash": _NEAR, "op9_line_frequency": _LINES, "op12_source_divergence": _AUDIT, "op13_conversation_repair": _repair()}
