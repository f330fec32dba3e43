"""The same results in DuckDB, written from the definitions."""

from __future__ import annotations

from inkveil.llm import mixing

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
RUNS = """list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
ds AS (SELECT r, doc_id, unnest({RUNS}) AS run FROM d WHERE len(w) >= 5),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
bs AS (SELECT item_id, {RUNS} AS runs FROM b WHERE len(w) >= 5),
bu AS (SELECT item_id, len(runs) AS item_runs, unnest(runs) AS run FROM bs)
SELECT doc_id, item_id, count(*) AS shared, item_runs
FROM ds JOIN bu USING (run) GROUP BY r, doc_id, item_id, item_runs
HAVING count(*) * 10 >= item_runs * 8
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *,
    length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t'))
    + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'),
                     ':', '\c')) + length('### : </turn>') + 1 AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
    lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prior
  FROM t
), m AS (
  SELECT *, (prior, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'),
    ('user', 'assistant'), ('assistant', 'user')) AS fits FROM f
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), ''))
      AS loss_sha256,
    sum(size)::BIGINT AS formatted_chars,
    coalesce(min(pos) FILTER (NOT fits),
             CASE WHEN arg_max(role, pos) <> 'assistant' THEN count(*) END) AS broke_at
  FROM m GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
  broke_at IS NULL AS valid, broke_at FROM g
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
t AS (
  SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_sort({RUNS})
    WHEN len(w) >= 1 THEN [array_to_string(w, ' ')] END AS runs FROM d
), m AS (
  SELECT runs, min(r) AS member, min(doc_id) AS first_id, count(*) AS copies, len(runs) AS n
  FROM t WHERE runs IS NOT NULL GROUP BY runs
), u AS MATERIALIZED (SELECT member, n, unnest(runs) AS run FROM m),
e AS MATERIALIZED (
  SELECT x.member AS a, y.member AS b FROM u x JOIN u y USING (run)
  WHERE x.member <> y.member GROUP BY x.member, y.member, x.n, y.n
  HAVING 10 * count(*) >= 8 * (x.n + y.n - count(*))
), reach AS (
  SELECT member AS a, member AS b FROM m UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), class AS (
  SELECT reach.a AS member, min(m.first_id) AS class_id FROM reach JOIN m ON m.member = reach.b
  GROUP BY reach.a
), degree AS (SELECT a AS member, count(*) AS n_links FROM e GROUP BY a)
SELECT t.doc_id, coalesce(class_id, t.doc_id) AS class_id, coalesce(n_links, 0) AS n_links,
  coalesce(copies, 1) AS n_copies
FROM t LEFT JOIN m USING (runs) LEFT JOIN class USING (member) LEFT JOIN degree USING (member)
"""

OP10 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({WORDS}), 0) AS size,
    md5(concat(coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    {list(mixing.WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source
), l AS (
  SELECT *, {mixing.MOST_PASSES} * source_size AS cap,
    sum(source_size) OVER () - coalesce(sum({mixing.MOST_PASSES} * source_size) OVER o, 0) AS words,
    sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights
  FROM s WINDOW o AS (ORDER BY {mixing.MOST_PASSES} * source_size / weight, rank
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, words * weight >= cap * weights AS capped FROM l),
f AS (SELECT words AS free_words, weights AS free_weights FROM c WHERE NOT capped
  ORDER BY cap / weight, rank LIMIT 1),
g AS (
  SELECT source, source_size,
    CASE WHEN capped THEN cap::DOUBLE
    ELSE (weight * free_words)::DOUBLE / free_weights::DOUBLE END AS target
  FROM c LEFT JOIN f ON true
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2 AS middle
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (size * ((middle < target)::INT + (source_size + middle < target)::INT
    + (source_size * 2 + middle < target)::INT))::BIGINT AS taken
FROM p
"""


OP1 = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS plain,
    list_transform(string_split(regexp_replace(regexp_replace(text, '\S*[0-9]\S*', '<*>', 'g'),
      '[ \t\r\f\x0B]+', ' ', 'g'), chr(10)), lambda x: trim(x)) AS masked FROM documents
), l AS MATERIALIZED (
  SELECT r, unnest(list_filter(list_distinct(masked), lambda x: x <> '')) AS line FROM d
), n AS MATERIALIZED (
  SELECT line, count(*) AS docs, string_split(line, ' ') AS tokens,
    len(string_split(line, ' ')) || ' ' || array_to_string(string_split(line, ' ')[1:3], ' ') AS leaf,
    CASE WHEN len(string_split(line, ' ')) >= 50 THEN 2 ELSE 3 END AS least
  FROM l GROUP BY line
), start AS MATERIALIZED (
  SELECT line, docs, tokens, leaf FROM n WHERE leaf IN
    (SELECT leaf FROM n GROUP BY leaf, least HAVING count(*) > 1 AND sum(docs) >= least)
), walk(line, docs, tokens, grp, shared) AS (
  SELECT line, docs, tokens, leaf, NULL::VARCHAR FROM start
  UNION ALL (
    WITH cur AS (SELECT line, docs, tokens, grp FROM walk WHERE shared IS NULL),
    tok AS (
      SELECT grp, pos, token, sum(docs) AS docs, count(*) AS lines
      FROM (SELECT grp, docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM cur) GROUP BY ALL
    ), place AS (
      SELECT grp, pos, max((docs, token)) AS top, max(docs) FILTER (lines > 1) AS recurs, count(*) AS kinds
      FROM tok GROUP BY ALL
    ), vote AS (
      SELECT p.grp, list(CASE WHEN p.top[1] * 2 >= s.total THEN p.top[2] END ORDER BY p.pos) AS template,
        arg_max(p.pos, (recurs, -p.pos)) FILTER (kinds > 1 AND recurs IS NOT NULL) AS split
      FROM place p JOIN (SELECT grp, sum(docs) AS total FROM cur GROUP BY grp) s USING (grp) GROUP BY p.grp
    ), judged AS (
      SELECT cur.*, split, coalesce(len(list_filter(list_zip(tokens, template), lambda x: x[1] = x[2])), 0) * 10
        >= len(tokens) * 7 AS is_like FROM cur JOIN vote USING (grp)
    )
    SELECT line, j.docs, tokens, CASE WHEN is_like THEN j.grp
        ELSE j.grp || '|' || split || '=' || CASE WHEN t.lines > 1 THEN t.token ELSE ' ' END END,
      CASE WHEN is_like THEN j.grp END
    FROM judged j LEFT JOIN tok t ON t.grp = j.grp AND t.pos = j.split AND t.token = j.tokens[j.split]
    WHERE is_like OR split IS NOT NULL
  )
), members AS MATERIALIZED (SELECT line, shared FROM walk WHERE shared IS NOT NULL),
many AS (
  SELECT shared FROM l JOIN members USING (line) JOIN n USING (line) GROUP BY shared, least
  HAVING count(DISTINCT r) >= least
), gone AS MATERIALIZED (
  SELECT line FROM members SEMI JOIN many USING (shared) UNION SELECT line FROM n WHERE docs >= least
), hit AS (
  SELECT l.r, list(line) AS lines FROM l SEMI JOIN gone USING (line) GROUP BY l.r
), pairs AS (
  SELECT d.doc_id, d.text, list_zip(d.plain, d.masked) AS pairs, coalesce(hit.lines, []) AS lines
  FROM d LEFT JOIN hit USING (r)
)
SELECT doc_id, coalesce(len(list_filter(pairs, lambda x: x[2] <> '')), 0) AS n_lines,
  coalesce(len(list_filter(pairs, lambda x: x[2] <> '' AND list_contains(lines, x[2]))), 0) AS n_dropped,
  CASE WHEN text IS NOT NULL THEN array_to_string(list_transform(
    list_filter(pairs, lambda x: x[2] = '' OR NOT list_contains(lines, x[2])), lambda x: x[1]), chr(10)) END
    AS text
FROM pairs
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {
        "op1_line_templates": OP1,
        "op4_maxscore": OP4,
        "op7_containment": OP7,
        "op8_chat_machine": OP8,
        "op9_jaccard_join": OP9,
        "op10_curriculum": OP10,
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
