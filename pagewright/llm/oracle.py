"""DuckDB SQL for those queries of this subpackage that SQL can express, by brute force."""

from __future__ import annotations

from pagewright.llm import mixing

_DOT = "list_reduce(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE), lambda a, b: a + b)"  # summed in order
_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

EMBEDDING_NEAR_DEDUP = f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding AS v, sqrt({_DOT.format('embedding', 'embedding')}) AS n FROM embeddings WHERE {_USABLE}),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND {_DOT.format('a.v', 'b.v')} / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS root, vec_id AS node FROM embeddings UNION SELECT r.root, l.b FROM reach r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.node = vec_id"""

NEAREST = f"""
WITH e AS (SELECT vec_id, embedding AS v FROM embeddings WHERE {_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT.format('q.v', 'c.v')} AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

REPEATS = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS nth FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM r WHERE nth > 1),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = x.doc_id AND c.i = x.i) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

_SPANS = "array_to_string(list_transform(list_filter(range(1, len({0}) + 1), lambda i: {0}[i].role = 'assistant'), lambda i: (coalesce(list_sum(list_transform({0}[1:i - 1], lambda t: length({1}))), 0)::BIGINT + length({0}[i].role) + 5) || ':' || (coalesce(list_sum(list_transform({0}[1:i], lambda t: length({1}))), 0)::BIGINT)), ',')"
_ONE = "('<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10))"
_RENDER = "coalesce(array_to_string(list_transform({0}, lambda t: " + _ONE + "), ''), '')"

PREFERENCES = f"""
WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS t FROM conversations GROUP BY conv_id),
m AS (SELECT conv_id, t, t[1] AS opening, coalesce(list_sum(list_transform(list_filter(t, lambda x: x.role = 'assistant'), lambda x: length(x.text))), 0)::BIGINT AS said FROM c),
o AS (SELECT *, lag(conv_id) OVER w AS p_id, lag(t) OVER w AS p_t, lag(said) OVER w AS p_said FROM m WINDOW w AS (PARTITION BY opening ORDER BY conv_id)),
a AS (SELECT conv_id, t, list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')) AS last FROM c),
n AS (SELECT conv_id, t[1:last] AS t, t[last] AS answer FROM a WHERE last IS NOT NULL),
s AS (SELECT *, coalesce(lead(conv_id) OVER w, lag(conv_id) OVER w) AS o_id, coalesce(lead(answer) OVER w, lag(answer) OVER w) AS o_answer FROM n WINDOW w AS (ORDER BY conv_id)),
pairs AS (SELECT 'opening' AS kind, CASE WHEN p_said >= said THEN p_id ELSE conv_id END AS chosen_id, CASE WHEN p_said >= said THEN conv_id ELSE p_id END AS rejected_id, CASE WHEN p_said >= said THEN p_t ELSE t END AS x, CASE WHEN p_said >= said THEN t ELSE p_t END AS y FROM o WHERE p_id IS NOT NULL
    UNION ALL SELECT 'swap', conv_id, o_id, t, list_append(t[1:len(t) - 1], o_answer) FROM s WHERE o_id IS NOT NULL),
k AS (SELECT *, len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i])) AS n FROM pairs)
SELECT kind, chosen_id, rejected_id, n::INT AS prompt_turns, {_RENDER.format('x[1:n]')} AS prompt, {_RENDER.format('x[n + 1:]')} AS chosen, {_SPANS.format('x[n + 1:]', _ONE)} AS chosen_loss,
    {_RENDER.format('y[n + 1:]')} AS rejected, {_SPANS.format('y[n + 1:]', _ONE)} AS rejected_loss FROM k"""

SQL = {"op6_chat_preferences": PREFERENCES, "op1_embedding_near_dedup": EMBEDDING_NEAR_DEDUP, "op7_mixing": mixing.oracle(), "op8_nearest_neighbours": NEAREST, "op10_substring_dedup": REPEATS}
