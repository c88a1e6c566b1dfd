"""The SQL, in DuckDB's dialect, that must give the same rows as each query. Views come as common table expressions, by name."""

from __future__ import annotations

import re

from pagewright import lexicons as L
from pagewright.lexicons import SYNTHETIC as LEX
from pagewright.lexicons import UNIT
from pagewright.plans.queries import HIGH, LOW, TOTAL


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(terms) -> str:
    return "[" + ", ".join(map(quoted, terms)) + "]" if terms else "[]::VARCHAR[]"


def holds(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {quoted(t)})" for t in terms) + ")" if terms else "false"


NL = "chr(10)"
STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
COLLAPSE = lambda c: STRIP(rf"regexp_replace({c}, '\s+', ' ', 'g')")
DOT = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
FOUND = lambda c, terms: f"list_filter({listed(terms)}, lambda k: contains(lower({c}), k))"
PARTS = lambda c: f"list_transform(range(0, 8), lambda j: {c}[j * 8 + 1 : j * 8 + 8])"
BEST = "page_score DESC, ocr_text_clean_len DESC, doc_id, page_idx"

CTE: dict[str, str] = {}
CTE["v_pages"] = f"SELECT source AS doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS page_idx, doc_id AS src_id, text AS ocr_text, len(string_split(text, {NL}))::INT AS num_boxes FROM documents"
CTE["v_clean"] = "SELECT doc_id, page_idx, src_id, num_boxes, ocr_text AS ocr_text_clean, length(ocr_text)::INT AS ocr_text_clean_len FROM v_pages"
CTE["v_turns"] = "SELECT conv_id AS doc_id, turn::INT AS page_idx, text, role FROM conversations"
CTE["v_queries"] = "SELECT item_id AS query_id, text AS query_en, (['fact', 'layout', 'semantic', 'navigation'])[item_id % 4 + 1] AS query_type FROM benchmark"
CTE["v_qvec"] = "SELECT q.query_id, e.embedding AS query_vector FROM v_queries q JOIN embeddings e ON e.vec_id = q.query_id"
CTE["v_emb"] = "SELECT vec_id AS src_id, embedding FROM embeddings"
CTE["v_gold"] = "SELECT q.query_id, q.query_en, q.query_type, p.doc_id AS gold_doc_id, p.page_idx AS gold_page_idx FROM v_queries q JOIN (SELECT query_id, min(d.doc_id) AS src_id FROM documents d JOIN v_queries q ON contains(d.text, q.query_en) GROUP BY 1) f USING (query_id) JOIN v_pages p USING (src_id)"
CTE["v_tgold"] = "SELECT doc_id AS query_id, text AS query_en, role AS query_type, doc_id AS gold_doc_id, page_idx AS gold_page_idx FROM v_turns WHERE page_idx = 1"
CTE["v_lines0"] = f"SELECT doc_id, page_idx, unnest(string_split(ocr_text, {NL})) AS raw, generate_subscripts(string_split(ocr_text, {NL}), 1) - 1 AS pos FROM v_pages"
CTE["v_lines"] = rf"SELECT doc_id, page_idx, pos, line, lower(line) AS k FROM (SELECT *, {COLLAPSE('raw')} AS line FROM v_lines0) WHERE NOT (length(line) <= 1 OR regexp_full_match(line, '[^\p{{L}}\p{{N}}_]+') OR regexp_full_match(line, '[-–—]?[0-9]+[-–—]?'))"
CTE["v_df"] = "SELECT doc_id, k, count(DISTINCT page_idx) AS n_pages FROM v_lines GROUP BY ALL"
CTE["v_boiler"] = "SELECT doc_id, k FROM v_df JOIN (SELECT doc_id, count(*) AS doc_pages FROM v_pages GROUP BY 1) USING (doc_id) WHERE n_pages >= 8 AND n_pages / doc_pages >= 0.08"
CTE["v_kept"] = f"SELECT doc_id, page_idx, string_agg(line, {NL} ORDER BY pos) AS ocr_text_clean FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx, k ORDER BY pos) AS nth FROM v_lines) l WHERE nth = 1 AND k NOT IN ({', '.join(map(quoted, L.HEADER_LINES))}) AND NOT EXISTS (SELECT 1 FROM v_boiler b WHERE b.doc_id = l.doc_id AND b.k = l.k) GROUP BY ALL"
CTE["v_cleaned"] = "SELECT p.doc_id, p.page_idx, coalesce(c.ocr_text_clean, '') AS ocr_text_clean, length(p.ocr_text) AS ocr_text_len, length(coalesce(c.ocr_text_clean, '')) AS ocr_text_clean_len FROM v_pages p LEFT JOIN v_kept c USING (doc_id, page_idx)"
CTE["v_index"] = "SELECT printf('%s:%04d', p.doc_id, p.page_idx) AS page_id, p.doc_id, p.page_idx, 'm' AS origin, 'o' AS origin_ocr, 'd' AS origin_doc, count(*) OVER (PARTITION BY p.doc_id) AS page_count, length(ocr_text) > 0 AS has_ocr_text, length(ocr_text) > 0 AS has_clean_text, contains(ocr_text, '***') OR contains(ocr_text, '%%%') AS has_ocr_error FROM v_pages p"

_COUNT = lambda pattern, opts="": f"len(regexp_extract_all(ocr_text_clean, {quoted(opts + pattern)}))"
CTE["v_feat"] = rf"""SELECT *, {_COUNT(rf'\b{UNIT}\b', '(?i)')} AS units, {_COUNT(r'\b\d+(\.\d+)?\b')} AS numbers, {_COUNT('[•·▪◦]')} AS bullets,
    len(list_filter(list_filter(list_transform(string_split(ocr_text_clean, {NL}), lambda x: {STRIP('x')}), lambda x: x <> '')[1:8], lambda x: length(x) BETWEEN 6 AND 60 AND regexp_full_match(x, '[A-Z0-9\s\-&()/]+'))) AS titles,
    {FOUND('ocr_text_clean', LEX.high)} AS high, {FOUND('ocr_text_clean', LEX.low)} AS low, {holds('ocr_text_clean', LEX.legal)} AS is_strong_low_value, contains(lower(ocr_text_clean), {quoted(LEX.certificate)}) AND ocr_text_clean_len < 1200 AS cert,
    CASE WHEN {holds('ocr_text_clean', LEX.layout)} THEN 'layout' WHEN {holds('ocr_text_clean', LEX.fact)} THEN 'fact' WHEN {holds('ocr_text_clean', LEX.semantic)} THEN 'semantic' WHEN {holds('ocr_text_clean', LEX.navigation)} THEN 'navigation' ELSE 'generic' END AS page_type FROM v_clean"""
CTE["v_scored"] = """SELECT *, round(CASE WHEN ocr_text_clean_len < 50 THEN -5.0 WHEN ocr_text_clean_len < 120 THEN -1.0 WHEN ocr_text_clean_len <= 3500 THEN 3.0 ELSE 1.0 END::DOUBLE + CASE WHEN num_boxes >= 20 THEN 3.0 WHEN num_boxes >= 8 THEN 2.0 ELSE 0.0 END::DOUBLE
    + least(units, 6)::DOUBLE * 0.6::DOUBLE + least(numbers, 20)::DOUBLE * 0.08::DOUBLE + least(bullets, 8)::DOUBLE * 0.25::DOUBLE + least(len(high), 8)::DOUBLE * 1.2::DOUBLE - least(len(low), 6)::DOUBLE * 1.5::DOUBLE + least(titles, 3)::DOUBLE * 0.4::DOUBLE - CASE WHEN is_strong_low_value THEN 4.0 ELSE 0.0 END::DOUBLE - CASE WHEN cert THEN 2.0 ELSE 0.0 END::DOUBLE, 6) AS page_score,
    concat_ws(';', CASE WHEN ocr_text_clean_len < 50 THEN 'too_short' WHEN ocr_text_clean_len < 120 THEN 'short' WHEN ocr_text_clean_len <= 3500 THEN 'good_length' ELSE 'very_long' END, CASE WHEN num_boxes >= 8 THEN 'dense_boxes' END, CASE WHEN num_boxes >= 20 THEN 'very_dense_boxes' END,
    CASE WHEN units > 0 THEN 'unit_hits=' || units END, CASE WHEN numbers >= 5 THEN 'number_hits=' || numbers END, CASE WHEN bullets > 0 THEN 'bullet_hits=' || bullets END, CASE WHEN len(high) > 0 THEN 'high_value=' || array_to_string(high[1:4], ',') END, CASE WHEN len(low) > 0 THEN 'low_value=' || array_to_string(low[1:4], ',') END,
    CASE WHEN titles > 0 THEN 'upper_titles=' || titles END, CASE WHEN is_strong_low_value THEN 'legal_page' END, CASE WHEN cert THEN 'certificate_page' END) AS score_reasons FROM v_feat"""
CTE["v_quota"] = f"SELECT doc_id, greatest({LOW}, least({HIGH}, round_even({TOTAL}.0::DOUBLE * n / sum(n) OVER (), 0)::BIGINT))::BIGINT AS selected_quota FROM (SELECT doc_id, count(*) AS n FROM v_clean WHERE ocr_text_clean_len > 0 GROUP BY 1)"
CTE["v_sub"] = f"SELECT s.*, q.selected_quota, page_type = 'navigation' AS nav, row_number() OVER (PARTITION BY doc_id, page_type = 'navigation' ORDER BY {BEST}) AS in_kind, greatest(2, ceil(q.selected_quota * 0.1)) AS cap FROM v_scored s JOIN v_quota q USING (doc_id) WHERE NOT is_strong_low_value"
CTE["v_turn"] = "SELECT *, CASE WHEN nav AND in_kind <= cap THEN 1 WHEN NOT nav AND in_kind <= greatest(selected_quota - count(*) FILTER (nav AND in_kind <= cap) OVER (PARTITION BY doc_id), 0) THEN 0 ELSE 2 END AS turn FROM v_sub"
CTE["v_top"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, {BEST}) AS place FROM v_turn) WHERE place <= selected_quota"
_SEL = "src_id, doc_id, page_idx, page_score, page_type, ocr_text_clean_len"
CTE["v_selected"] = f"SELECT * FROM (SELECT {_SEL}, selected_quota, 0 AS late FROM v_top UNION ALL SELECT {_SEL}, NULL, 1 FROM v_scored s WHERE NOT EXISTS (SELECT 1 FROM v_top t WHERE t.src_id = s.src_id)) ORDER BY late, {BEST} LIMIT {TOTAL}"


def _template(name: str, lang: int) -> str:
    """A template text as a SQL expression of kw, kw_zh, unit and heading."""
    of, rest, parts = {"k": "kw", "z": "kw_zh", "n": "unit", "h": "substr(heading, 1, 40)"}, L.TEMPLATES[name][lang], []
    while "{" in rest:
        head, _, rest = rest.partition("{")
        parts += [quoted(head), of[rest[0]]]
        rest = rest[2:]
    return COLLAPSE("(" + " || ".join([*parts, quoted(rest)]) + ")")


def _made(name: str) -> str:
    return "{'zh': " + _template(name, 0) + ", 'en': " + _template(name, 1) + ", 'source': " + quoted(name) + "}"


def _family(kind: str, conds: dict[str, str], keep: int) -> str:
    some = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {_made(n)} END" for n, c in conds.items()) + "], lambda x: x IS NOT NULL)"
    if kind != "generic":
        some = f"CASE WHEN NOT ({' OR '.join(f'coalesce({c}, false)' for c in conds.values())}) THEN [{_made(kind + '_fallback')}, {_made(kind + '_fallback2')}] ELSE {some} END"
    return f"({some})[1:{keep}]"


_T = "ocr_text_clean"
_FAMILIES = {
    "fact": _family("fact", {"fact_keyword": "kw IS NOT NULL", "fact_page_lookup": "kw IS NOT NULL", "fact_number_unit": "unit IS NOT NULL", "fact_heading": "heading <> ''"}, 3),
    "layout": _family("layout", {"layout_workspace": holds(_T, LEX.workspace), "layout_dimensions": holds(_T, LEX.dimensions), "layout_schematic": holds(_T, LEX.schematic), "layout_7dof": holds(_T, LEX.seven_dof), "layout_heading": "heading <> ''"}, 3),
    "semantic": _family("semantic", {"semantic_keyword": "kw IS NOT NULL", "semantic_topic": "kw IS NOT NULL", "semantic_heading": "heading <> ''"}, 2),
    "navigation": _family("navigation", {"navigation_emstop": holds(_T, LEX.emergency), "navigation_contents": holds(_T, LEX.contents), "navigation_heading": "heading <> ''"}, 2),
    "generic": _family("generic", {"generic_heading": "heading <> ''", "generic_topic": "true"}, 2),
}
CTE["v_head"] = f"""SELECT *, CASE page_type WHEN 'fact' THEN ({FOUND(_T, LEX.fact_keywords)})[1] WHEN 'semantic' THEN ({FOUND(_T, LEX.semantic_keywords)})[1] END AS kw, nullif(regexp_extract(ocr_text_clean, {quoted(rf'(?i)\b{UNIT}\b')}), '') AS unit,
    coalesce(list_filter(list_filter(list_transform(string_split(ocr_text_clean, {NL}), lambda x: {COLLAPSE('x')}), lambda x: length(x) >= 3)[1:12], lambda x: length(x) BETWEEN 4 AND 80)[1], '') AS heading FROM v_scored"""
CTE["v_kw"] = "SELECT *, CASE kw " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in LEX.keyword_zh.items()) + " ELSE kw END AS kw_zh FROM v_head"
CTE["v_made"] = "SELECT *, CASE page_type " + " ".join(f"WHEN {quoted(k)} THEN {f}" for k, f in _FAMILIES.items()) + " END AS made FROM v_kw"
CTE["v_each"] = "SELECT doc_id, page_idx, page_type, heading AS anchor_heading, ocr_text_clean_len, page_score, unnest(made) AS q, generate_subscripts(made, 1) AS ord FROM v_made"
CTE["v_num"] = "SELECT *, printf('auto_%05d', row_number() OVER (ORDER BY doc_id, page_idx, ord)) AS query_id, row_number() OVER (PARTITION BY doc_id, page_idx, q.zh, q.en ORDER BY ord) AS nth FROM v_each"
CTE["v_gen"] = "SELECT query_id, doc_id, page_idx, page_type, q.zh AS query_zh, q.en AS query_en, q.source AS query_source, anchor_heading, ocr_text_clean_len, page_score FROM v_num WHERE nth = 1"

CTE["v_tok"] = "SELECT doc_id AS src_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents WHERE length(text) > 0"
CTE["v_tf"] = "SELECT src_id, dl, term, count(*) AS tf FROM (SELECT src_id, len(t) AS dl, unnest(t) AS term FROM v_tok) GROUP BY ALL"
CTE["v_idf"] = "SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM (SELECT term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM v_tf GROUP BY 1), (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM v_tok))"
_BM25 = "SELECT q.query_id, f.src_id, round(sum(q.qtf * i.idf * f.tf * 2.5::DOUBLE / (f.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * f.dl / i.avgdl))), 6) AS score FROM v_tf f JOIN (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS term FROM v_queries) GROUP BY ALL) q USING (term) JOIN v_idf i USING (term) GROUP BY ALL"
CTE["v_bm25"] = _BM25.format(text="query_en")
CTE["v_bm25w"] = _BM25.format(text="split_part(query_en, ' ', 1)")
_TOP = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src_id) AS rank FROM {0}"
CTE["v_lex"] = _TOP.format("v_bm25")
CTE["v_dense"] = _TOP.format(f"(SELECT query_id, src_id, round({DOT('query_vector', 'embedding')}, 6) AS score FROM v_emb, v_qvec)")
CTE["v_max"] = _TOP.format(f"(SELECT query_id, src_id, round(list_sum(list_transform({PARTS('query_vector')}, lambda x: list_max(list_transform({PARTS('embedding')}, lambda y: {DOT('x', 'y')})))), 6) AS score FROM v_emb, v_qvec)")
CTE["v_two"] = _TOP.format(f"(SELECT l.query_id, l.src_id, round({DOT('query_vector', 'embedding')}, 6) AS score, count(*) OVER (PARTITION BY l.query_id) AS candidate_pool_size FROM v_lex l JOIN v_emb e USING (src_id) JOIN v_qvec q USING (query_id) WHERE l.rank <= 20)")
for _n in ("lex", "dense", "two", "max"):
    CTE[f"v_{_n}_p"] = f"SELECT h.query_id, h.rank, p.doc_id, p.page_idx, h.score FROM v_{_n} h JOIN v_pages p USING (src_id)"
    CTE[f"v_{_n}_d"] = f"""SELECT g.query_id, g.query_type, g.gold_doc_id, g.gold_page_idx, max(h.doc_id) FILTER (h.rank = 1) AS top1_doc_id, max(h.page_idx) FILTER (h.rank = 1) AS top1_page_idx, max(h.score) FILTER (h.rank = 1) AS top1_score,
    coalesce(bool_or(h.rank = 1 AND h.doc_id = gold_doc_id), false) AS top1_doc_hit, coalesce(bool_or(h.rank = 1 AND h.doc_id = gold_doc_id AND h.page_idx = gold_page_idx), false) AS top1_exact_hit, coalesce(bool_or(h.doc_id = gold_doc_id), false) AS top5_doc_hit, coalesce(bool_or(h.doc_id = gold_doc_id AND h.page_idx = gold_page_idx), false) AS top5_exact_hit,
    coalesce('[' || string_agg('"' || h.doc_id || '"', ',' ORDER BY h.rank) || ']', '[]') AS retrieved_doc_ids, coalesce('[' || string_agg(h.page_idx::VARCHAR, ',' ORDER BY h.rank) || ']', '[]') AS retrieved_page_idxs
    FROM v_gold g LEFT JOIN (SELECT * FROM v_{_n}_p WHERE rank <= 5) h USING (query_id) GROUP BY g.query_id, g.query_type, g.gold_doc_id, g.gold_page_idx"""
CTE["v_runs"] = "SELECT *, 'lexical' AS run_name FROM v_lex_d UNION ALL BY NAME SELECT *, 'dense' AS run_name FROM v_dense_d UNION ALL BY NAME SELECT *, 'two_stage' AS run_name FROM v_two_d"
_RATES = ", ".join(f"round(avg({h}::INT), 6) AS {n}" for n, h in (("top1_exact_acc", "top1_exact_hit"), ("top5_exact_recall", "top5_exact_hit"), ("top1_doc_acc", "top1_doc_hit"), ("top5_doc_recall", "top5_doc_hit")))
_HITS = "top1_doc_hit, top1_exact_hit, top5_doc_hit, top5_exact_hit"

_ADJ = "SELECT g.query_id, t.doc_id AS neg_doc_id, t.page_idx AS neg_page_idx, CASE WHEN t.page_idx < g.gold_page_idx THEN 'adjacent_prev' ELSE 'adjacent_next' END AS neg_source FROM {g} g JOIN {t} t ON t.doc_id = g.gold_doc_id AND abs(t.page_idx - g.gold_page_idx) = 1"
CTE["v_both"] = _ADJ.format(g="v_tgold", t="v_turns")
CTE["v_far"] = "SELECT query_id, neg_doc_id, neg_page_idx, 'same_doc_far' AS neg_source FROM (SELECT g.query_id, t.doc_id AS neg_doc_id, t.page_idx AS neg_page_idx, row_number() OVER (PARTITION BY g.query_id ORDER BY abs(t.page_idx - g.gold_page_idx) DESC, t.page_idx) AS nth FROM v_tgold g JOIN v_turns t ON t.doc_id = g.gold_doc_id AND t.page_idx <> g.gold_page_idx) WHERE nth = 1"
_ONE = "SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY neg_page_idx) AS nth FROM ({0})) WHERE nth = 1"
CTE["v_all"] = f"SELECT *, 0 AS part FROM ({_ONE.format('SELECT * FROM v_both')}) UNION ALL SELECT *, 1 FROM v_far UNION ALL SELECT *, 2 FROM v_both"
CTE["v_pairs"] = "SELECT * FROM (SELECT a.query_id || '_' || neg_source AS sample_id, a.query_id, g.query_type, g.gold_doc_id AS pos_doc_id, g.gold_page_idx AS pos_page_idx, printf('data/pages/%d/page_%04d.png', g.gold_doc_id, g.gold_page_idx) AS pos_image_path, neg_doc_id, neg_page_idx, printf('data/pages/%d/page_%04d.png', neg_doc_id, neg_page_idx) AS neg_image_path, neg_source, row_number() OVER (PARTITION BY a.query_id, g.gold_page_idx, neg_doc_id, neg_page_idx ORDER BY part, a.query_id || '_' || neg_source) AS nth FROM v_all a JOIN v_tgold g USING (query_id)) WHERE nth = 1"
CTE["v_lab"] = "SELECT doc_id AS query_id, 'q' || quality AS query_type FROM labels"
CTE["v_tri"] = "SELECT a.vec_id AS i, a.embedding AS q, b.embedding AS p, c.embedding AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2"
CTE["v_sim"] = f"SELECT a.i // 16 AS batch, a.i, b.i AS j, {DOT('a.q', 'b.p')} / 0.07::DOUBLE AS s FROM v_tri a JOIN v_tri b ON a.i // 16 = b.i // 16"
_HALF = "(SELECT batch, avg(l) AS l FROM (SELECT batch, {0}, max(s) + ln(sum(exp(s - m))) - max(s) FILTER (i = j) AS l FROM (SELECT *, max(s) OVER (PARTITION BY batch, {0}) AS m FROM v_sim) GROUP BY batch, {0}) GROUP BY batch)"
CTE["v_raw"] = "SELECT query_id, page_idx, CASE query_id % 6 WHEN 0 THEN '<one concise answer> ' || s || ' </one concise answer>' || chr(10) || '<confidence>0.' || c || '</confidence>' WHEN 1 THEN 'Answer: ' || s || chr(10) || 'Confidence: ' || c WHEN 2 THEN s || chr(10) || lower(s) || chr(10) || 'confidence 0.' || c WHEN 3 THEN c WHEN 4 THEN 'Confidence: 0.' || c ELSE 'It is common knowledge. ' || s END AS raw, CASE WHEN page_idx % 2 = 0 THEN 'What is the rated payload?' ELSE 'Where is it?' END AS question FROM (SELECT doc_id * 100 + page_idx AS query_id, page_idx, text AS s, ((doc_id * 100 + page_idx) % 97)::VARCHAR AS c FROM v_turns)"
_CONF = "CASE WHEN coalesce(said, '') = '' THEN 0.2::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN said::DOUBLE > 1 THEN said::DOUBLE / 100 ELSE said::DOUBLE END)) END"
CTE["v_conf"] = f"SELECT *, {_CONF} AS confidence FROM (SELECT *, regexp_extract(raw, '(?i)confidence[^0-9]{{0,10}}([0-9]+(?:\\.[0-9]+)?)', 1) AS said FROM v_raw)"


def _extract(source: str, column: str, name: str) -> dict[str, str]:
    """Answer extraction as a chain of views: name_1, ..., name."""
    within = lambda p: f"CASE WHEN regexp_matches(t, {quoted(p)}) THEN {STRIP(f'regexp_extract(t, {quoted(p)}, 1)')} ELSE t END"
    drop = "t"
    number = r"[0-9]+(?:\.[0-9]+)?"
    for p in (r"(?is)</?one\s+concise\s+answer>", r"(?is)</?confidence>", r"(?im)^answer\s*:\s*", rf"(?im)^confidence\s*:\s*{number}\s*$", rf"(?im)^{number}\s*$"):
        drop = f"regexp_replace({drop}, {quoted(p)}, '', 'g')"
    lines = rf"list_filter(list_transform(string_split({drop}, {NL}), lambda x: {STRIP('x')}), lambda x: x <> '' AND NOT regexp_full_match(x, '(?i)confidence\s*:?\s*{number}'))"
    return {
        f"{name}_1": f"SELECT * REPLACE ({within(r'(?is)<one concise answer>\s*(.*?)\s*(?:</one(?:\s+concise\s+answer)?>|<confidence>|\z)')} AS t) FROM (SELECT *, {STRIP(column)} AS t FROM {source})",
        f"{name}_2": f"SELECT * REPLACE ({within(r'(?is)answer\s*:\s*(.*?)(?:\n\s*confidence\s*:|\z)')} AS t) FROM {name}_1",
        f"{name}_3": f"SELECT *, {lines} AS ls FROM {name}_2",
        name: f"SELECT * EXCLUDE (t, ls), {STRIP(f'array_to_string(list_filter(ls, lambda x, i: NOT list_contains(list_transform(ls[1:i - 1], lambda y: lower(y)), lower(x))), {NL})')} AS a FROM {name}_3",
    }


def _quality(source: str, column: str, name: str) -> dict[str, str]:
    number = r"[0-9]+(?:\.[0-9]+)?"
    bare = rf"regexp_full_match({STRIP('x')}, '(?i)confidence\s*:\s*{number}')"
    pre = rf"SELECT *, {STRIP(f'array_to_string(list_filter(string_split({STRIP(column)}, {NL}), lambda x: NOT {bare} AND {STRIP("x")} <> {quoted("")}), {NL})')} AS stripped FROM {source}"
    hints = holds("question", L.FACT_HINTS)
    total = rf"""CASE WHEN length(a) > 0 THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN length(a) >= 20 THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN length(a) >= 60 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN lower(a) NOT IN ('yes', 'no', 'unknown') THEN 0.1 ELSE 0 END::DOUBLE
    + CASE WHEN NOT regexp_full_match({STRIP(column)}, '(?i)confidence\s*:\s*{number}') THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN NOT (contains(lower(a), '<one concise answer>') OR contains(lower(a), '<confidence>')) THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN NOT (contains(lower(a), 'cannot confidently answer') OR contains(lower(a), 'answer is uncertain')) THEN 0.05 ELSE 0 END::DOUBLE
    + CASE WHEN {hints} AND regexp_matches(a, '\d') THEN 0.1 ELSE 0 END::DOUBLE - CASE WHEN {holds('a', L.BAD_ANSWERS)} THEN 0.4 ELSE 0 END::DOUBLE"""
    return {f"v_{name}_0": pre, **_extract(f"v_{name}_0", "stripped", f"v_{name}_x"), f"v_{name}": f"SELECT * EXCLUDE (a, stripped), greatest(0.0::DOUBLE, least(1.0::DOUBLE, {total})) AS {name} FROM v_{name}_x"}


CTE |= _extract("v_raw", "raw", "v_ans")
CTE |= _quality("v_conf", "raw", "qual")
CTE["v_four"] = "SELECT *, raw || chr(10) || 'and more of it for good measure' AS more, 'unknown' AS joint FROM v_qual"
CTE |= _quality("v_four", "more", "qmore")
CTE |= _quality("v_qmore", "joint", "qjoint")


def sql(select: str) -> str:
    """select with the views that it names, and those that these name, in front."""
    used: dict[str, None] = {}

    def need(text: str) -> None:
        for n in re.findall(r"\bv_\w+\b", text):
            if n in CTE and n not in used:
                need(CTE[n])
                used[n] = None

    need(select)
    return (f"WITH {', '.join(f'{n} AS ({CTE[n]})' for n in used)} " if used else "") + select


_DIRECTIVE = "CASE query_id % 4 WHEN 0 THEN 'bm25_top' || (query_id % 5 + 1) WHEN 1 THEN 'manual' ELSE 'skip' END"
_BAD = lambda c, t: holds(f"coalesce({c}, '')", t)
_KEEPQ = f"NOT (({_BAD('anchor_heading', L.BAD_HEADINGS)} AND query_source IN ('layout_heading', 'fact_heading', 'generic_heading')) OR query_source IN ('generic_topic', 'generic_heading') OR {_BAD('query_zh', L.BROAD_ZH)} OR {_BAD('query_en', L.BROAD_EN)} OR (page_type = 'navigation' AND query_source NOT IN ('navigation_emstop', 'navigation_heading')) OR (query_source IN ('semantic_keyword', 'semantic_topic') AND {_BAD('anchor_heading', L.WEAK_HEADINGS)}))"
_PRIORITY = "CASE query_source " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in L.PRIORITY.items()) + " ELSE 99 END"
_PROMPT = ", ".join(f"md5({quoted(L.PROMPT_BASE + chr(10) + L.PROMPT_MODES[m] + 'Question: ')} || question) AS {m}" for m in ("per_page", "joint", "stitched", "single"))
_OCR_T = f"list_transform(string_split(ocr_text, {NL}), lambda x: {STRIP('x')})"
_FIRST = lambda hits, k, src: f"SELECT query_id, neg_doc_id, neg_page_idx, '{src}' AS neg_source FROM (SELECT h.query_id, h.doc_id AS neg_doc_id, h.page_idx AS neg_page_idx, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS nth FROM {hits} h JOIN v_gold g USING (query_id) WHERE h.rank <= {k} AND NOT (h.doc_id = g.gold_doc_id AND h.page_idx = g.gold_page_idx)) WHERE nth = 1"
_TRAIN = lambda name, parts: f"SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pos_doc_id, pos_page_idx, neg_doc_id, neg_page_idx ORDER BY part, sample_id) AS nth FROM ({' UNION ALL BY NAME '.join(f'SELECT * EXCLUDE part, {i} AS part FROM ({p})' if 'v_train' in p else f'SELECT *, {i} AS part FROM ({p})' for i, p in enumerate(parts))})) WHERE nth = 1"
_PAIR = lambda negs, suffix=None: f"SELECT n.query_id || '_' || {quoted(suffix) if suffix else 'n.neg_source'} AS sample_id, n.query_id, g.query_en, g.query_type, g.gold_doc_id AS pos_doc_id, g.gold_page_idx AS pos_page_idx, n.neg_doc_id, n.neg_page_idx, n.neg_source FROM ({negs}) n JOIN v_gold g USING (query_id)"
_GADJ = _ADJ.format(g="v_gold", t="v_pages")
_GPREV = _ONE.format(_GADJ)
_GBLIND = "SELECT query_id, gold_doc_id AS neg_doc_id, CASE WHEN gold_page_idx > 0 THEN gold_page_idx - 1 ELSE gold_page_idx + 1 END AS neg_page_idx, CASE WHEN gold_page_idx > 0 THEN 'adjacent_prev' ELSE 'adjacent_next' END AS neg_source FROM v_gold"
_GFAR = "SELECT query_id, neg_doc_id, neg_page_idx, 'same_doc_far' AS neg_source FROM (SELECT g.query_id, t.doc_id AS neg_doc_id, t.page_idx AS neg_page_idx, row_number() OVER (PARTITION BY g.query_id ORDER BY abs(t.page_idx - g.gold_page_idx) DESC, t.page_idx) AS nth FROM v_gold g JOIN v_pages t ON t.doc_id = g.gold_doc_id AND t.page_idx <> g.gold_page_idx) WHERE nth = 1"
_GBOTH = f"SELECT * REPLACE ('gold_' || neg_source AS neg_source) FROM ({_GADJ})"
_VISION = _PAIR(_FIRST("(SELECT * FROM v_max_p WHERE rank <= 5)", 10, "vision_hard"), "vision")
_BM25_NEG = _PAIR(_FIRST("v_lex_p", 10, "bm25_hard"), "bm25")
CTE["v_train_v1"] = _TRAIN("v1", [_BM25_NEG, _VISION, _PAIR(_GBLIND)])
CTE["v_train_large"] = _TRAIN("large", [_BM25_NEG, _PAIR(_GPREV), _PAIR(_GFAR)])
CTE["v_train_v2"] = _TRAIN("v2", ["SELECT * FROM v_train_large", _VISION])
CTE["v_train_v3"] = f"SELECT * FROM v_train_v2 WHERE NOT ({_BAD('query_en', L.COPIED_EN)} OR {_BAD('query_en', L.COPIED_ZH)} OR {_BAD('query_en', L.WEAK_TITLES)})"
CTE["v_train_v4"] = _TRAIN("v4", ["SELECT * FROM v_train_v3", *[_PAIR(_FIRST(f"v_{n}_p", 5, s)) for n, s in (("lex", "gold_bm25"), ("dense", "gold_siglip_v1"), ("two", "gold_two_stage"))], _PAIR(_GBOTH)])
CTE["v_batch"] = f"SELECT batch, nce, margin_loss, round(nce + 0.25::DOUBLE * margin_raw, 6) AS loss FROM (SELECT a.batch, round((a.l + b.l) / 2, 6) AS nce FROM {_HALF.format('i')} a JOIN {_HALF.format('j')} b USING (batch)) JOIN (SELECT i // 16 AS batch, avg(greatest(0.0::DOUBLE, 0.2::DOUBLE - {DOT('q', 'p')} + {DOT('q', 'n')})) AS margin_raw, round(avg(greatest(0.0::DOUBLE, 0.2::DOUBLE - {DOT('q', 'p')} + {DOT('q', 'n')})), 6) AS margin_loss FROM v_tri GROUP BY 1) USING (batch)"
_POOL = ", ".join(f"round(list_sum(list_transform(range(0, 8), lambda j: (1 + j / 7.0::DOUBLE) * embedding[j * 8 + {i + 1}]::DOUBLE)) / 12.0::DOUBLE, 6) AS v{i}" for i in range(8))

SQL = {k: sql(v) for k, v in {
    "page_keys": "SELECT printf('%s:%04d', doc_id, page_idx) AS page_id, printf('pages/%s/page_%04d.png', doc_id, page_idx) AS image_path, src_id FROM v_pages",
    "nonempty_filter": "SELECT doc_id, page_idx, ocr_text_clean_len::BIGINT AS ocr_text_clean_len FROM v_clean WHERE ocr_text_clean_len > 0",
    "line_split_stats": "SELECT doc_id, k AS key, n_pages FROM v_df",
    "clean_lines": "SELECT doc_id, page_idx, md5(ocr_text_clean) AS text_md5, ocr_text_len, ocr_text_clean_len, ocr_text_len - ocr_text_clean_len AS ocr_reduction FROM v_cleaned",
    "clean_summary": "SELECT count(*) AS rows, count(DISTINCT doc_id) AS documents, count(*) FILTER (ocr_text_len > 0) AS non_empty_raw_pages, count(*) FILTER (ocr_text_clean_len > 0) AS non_empty_clean_pages, (SELECT count(*) FROM v_index WHERE has_ocr_error) AS error_pages, round(avg(ocr_text_clean_len), 6) AS avg_clean_length, round(avg(ocr_text_len - ocr_text_clean_len), 6) AS avg_reduction FROM v_cleaned",
    "page_index_left_join": "SELECT * FROM v_index",
    "page_index_summary": "SELECT count(DISTINCT doc_id) AS documents, count(*) AS pages, count(*) FILTER (has_ocr_text) AS pages_with_ocr_text, count(*) FILTER (has_clean_text) AS pages_with_clean_text, count(*) FILTER (has_ocr_error) AS pages_with_ocr_error, to_json(list(DISTINCT doc_id ORDER BY doc_id))::VARCHAR AS doc_ids FROM v_index",
    "ocr_json_flatten": f"SELECT src_id, array_to_string(list_filter({_OCR_T}, lambda x: x <> ''), {NL}) AS ocr_text, round(coalesce(list_avg(list_transform(list_filter(list_zip({_OCR_T}, string_split(ocr_text, {NL})), lambda z: z[1] <> ''), lambda z: round(length(z[2]) / 1000, 6))), 0), 6) AS avg_score, 2::BIGINT AS num_boxes FROM v_pages",
    "page_previews": f"SELECT src_id, replace(substr(ocr_text, 1, 300), {NL}, ' | ') AS preview FROM v_pages",
    "upper_case_search": "SELECT src_id, doc_id, page_idx FROM v_pages WHERE doc_id IN ('src1', 'src2') ORDER BY src_id LIMIT 50",
    "keyword_hits": f"SELECT src_id, len({FOUND(_T, LEX.high)}) AS n_hits, array_to_string(({FOUND(_T, LEX.high)})[1:4], ',') AS first_hits, coalesce(({FOUND(_T, LEX.semantic_keywords)})[1], '') AS first_semantic FROM v_clean",
    "number_unit_counts": "SELECT src_id, units, numbers, bullets, titles FROM v_feat",
    "page_score": "SELECT src_id, page_score, score_reasons, is_strong_low_value FROM v_scored",
    "page_type": "SELECT src_id, page_type FROM v_feat",
    "doc_quotas": "SELECT * FROM v_quota",
    "select_candidates": "SELECT src_id, doc_id, page_idx, page_score, page_type, selected_quota FROM v_selected",
    "refine_candidates": f"SELECT src_id, page_type, page_score FROM v_scored WHERE NOT (ocr_text_clean_len < 120 OR is_strong_low_value OR (page_type = 'navigation' AND {holds(_T, LEX.noisy_navigation)}) OR cert) AND (page_type IN ('fact', 'semantic', 'layout') OR page_score >= 10)",
    "lowest_scores": "SELECT src_id, page_score FROM v_scored ORDER BY page_score, src_id LIMIT 15",
    "generate_queries": "SELECT query_id, doc_id, page_idx, page_type, query_zh, query_en, query_source, anchor_heading FROM v_gen",
    "filter_queries_cap3": f"SELECT query_id, query_source, source_priority, rank_in_page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY source_priority, page_score DESC, ocr_text_clean_len DESC, query_id) AS rank_in_page FROM (SELECT *, ({_PRIORITY})::BIGINT AS source_priority FROM v_gen WHERE {_KEEPQ})) WHERE rank_in_page <= 3",
    "token_stats": "SELECT term, round(idf, 6) AS idf, round(avgdl, 6) AS avgdl FROM v_idf",
    "bm25_topk": "SELECT query_id, rank, src_id, score FROM v_lex WHERE rank <= 5",
    "bm25_backfill": "SELECT query_id, rank, src_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src_id) AS rank FROM (SELECT q.query_id, d.src_id, coalesce(s.score, 0) AS score FROM v_queries q CROSS JOIN v_tok d LEFT JOIN v_bm25w s ON s.query_id = q.query_id AND s.src_id = d.src_id)) WHERE rank <= 10",
    "bm25_all_scores": "SELECT query_id, count(*) AS n_pages, max(score) AS best, round(avg(score), 4) AS mean_score FROM v_bm25 GROUP BY 1",
    "dense_topk": "SELECT query_id, rank, src_id, score FROM v_dense WHERE rank <= 5",
    "maxsim_topk": "SELECT query_id, rank, src_id, score FROM v_max WHERE rank <= 5",
    "two_stage": "SELECT query_id, rank, src_id, score, candidate_pool_size FROM v_two WHERE rank <= 5",
    "retrieval_filter": "SELECT g.query_id, g.gold_doc_id AS doc_id, g.gold_page_idx AS page_idx FROM v_gold g WHERE EXISTS (SELECT 1 FROM v_lex_p h WHERE h.query_id = g.query_id AND h.doc_id = g.gold_doc_id AND ((h.page_idx = g.gold_page_idx AND h.rank <= 20) OR h.rank <= 5))",
    "eval_details": f"SELECT query_id, query_type, gold_doc_id, gold_page_idx, top1_doc_id, top1_page_idx, top1_score, {_HITS} FROM v_lex_d",
    "ranked_json_lists": "SELECT query_id, retrieved_doc_ids, retrieved_page_idxs FROM v_dense_d",
    "eval_summary_grouping_sets": f"SELECT CASE WHEN grouping(query_type) = 1 THEN '(all)' ELSE query_type END AS query_type, count(*) AS num_queries, {_RATES} FROM v_lex_d GROUP BY GROUPING SETS ((), (query_type))",
    "failures": f"SELECT query_id, query_type, gold_doc_id, gold_page_idx, {_HITS} FROM v_dense_d WHERE NOT top1_exact_hit OR NOT top5_exact_hit",
    "compare_runs": f"SELECT run_name, count(*) AS num_queries, {_RATES} FROM v_runs GROUP BY 1",
    "best_by_query": f"SELECT query_id, run_name, {_HITS} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 4 * top1_exact_hit::INT + 2 * top5_exact_hit::INT + top1_doc_hit::INT DESC, run_name) AS nth FROM v_runs) WHERE nth = 1",
    "label_directives": f"SELECT q.query_id, CASE query_id % 4 WHEN 0 THEN coalesce(h.doc_id, '') WHEN 1 THEN 'src' || query_id ELSE '' END AS gold_doc_id, CASE query_id % 4 WHEN 0 THEN coalesce(h.page_idx, -1) WHEN 1 THEN 12 ELSE -1 END AS gold_page_idx, CASE WHEN query_id % 4 = 0 AND h.doc_id IS NULL THEN 'skip' ELSE {_DIRECTIVE} END AS label_source FROM v_queries q LEFT JOIN v_dense_p h ON h.query_id = q.query_id AND h.rank = q.query_id % 5 + 1 AND h.rank <= 5".replace("CASE query_id", "CASE q.query_id").replace("'src' || query_id", "'src' || q.query_id").replace("(query_id %", "(q.query_id %").replace("WHEN query_id", "WHEN q.query_id"),
    "first_wrong": _FIRST("v_lex_p", 10, "bm25_hard"),
    "vision_negatives": f"SELECT w.*, h.score AS neg_score FROM ({_FIRST('v_max_p', 5, 'vision_hard')}) w JOIN v_max_p h ON h.query_id = w.query_id AND h.doc_id = w.neg_doc_id AND h.page_idx = w.neg_page_idx",
    "adjacent_prev_else_next": _ONE.format("SELECT * FROM v_both"),
    "adjacent_both": "SELECT * FROM v_both",
    "adjacent_unchecked": "SELECT query_id, gold_doc_id AS neg_doc_id, CASE WHEN gold_page_idx > 0 THEN gold_page_idx - 1 ELSE gold_page_idx + 1 END AS neg_page_idx, CASE WHEN gold_page_idx > 0 THEN 'adjacent_prev' ELSE 'adjacent_next' END AS neg_source FROM v_tgold",
    "same_doc_far": "SELECT * FROM v_far",
    **{f"trainset_{s}": f"SELECT sample_id, query_id, pos_doc_id, pos_page_idx, neg_doc_id, neg_page_idx, neg_source, query_type FROM v_train_{s}" for s in ("v1", "large", "v2", "v3", "v4")},
    "combined_loss": "SELECT * FROM v_batch",
    "best_epoch": "SELECT arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best_val_loss FROM (SELECT batch % 5 + 1 AS epoch, round(avg(loss), 6) AS val_loss FROM v_batch GROUP BY 1)",
    "confirmed_labels": "SELECT doc_id AS query_id, 'confirmed' AS label_status FROM labels WHERE quality = 1",
    "missing_images": "SELECT count(*) AS rows, count(*) FILTER (NOT EXISTS (SELECT 1 FROM v_turns t WHERE t.role = 'assistant' AND t.doc_id = pos_doc_id AND t.page_idx = pos_page_idx)) AS missing_pos_images, count(*) FILTER (NOT EXISTS (SELECT 1 FROM v_turns t WHERE t.role = 'assistant' AND t.doc_id = neg_doc_id AND t.page_idx = neg_page_idx)) AS missing_neg_images FROM v_pairs",
    "stitched_sizes": "SELECT doc_id, sum(CASE WHEN height = tall THEN width ELSE floor(width * (tall / height))::BIGINT END)::BIGINT AS width, max(tall) AS height FROM (SELECT *, max(height) OVER (PARTITION BY doc_id) AS tall FROM (SELECT doc_id, (600 + length(text) % 7 * 40)::BIGINT AS width, (800 + length(text) % 5 * 100)::BIGINT AS height FROM v_turns)) GROUP BY doc_id",
    "trainset_union_dedup_first": "SELECT sample_id, query_id, pos_doc_id, pos_page_idx, neg_doc_id, neg_page_idx, pos_image_path, neg_image_path, neg_source, query_type FROM v_pairs",
    "trainset_pattern_filter": f"SELECT query_id, query_source FROM v_gen WHERE NOT ({_BAD('query_en', L.COPIED_EN)} OR {_BAD('query_zh', L.COPIED_ZH)} OR {_BAD('query_en', L.WEAK_TITLES)} OR {_BAD('query_zh', L.WEAK_TITLES)})",
    "pairs_per_query": "SELECT count(*) AS n_pairs, count(DISTINCT query_id) AS n_queries, round_even(count(*)::DOUBLE / count(DISTINCT query_id), 2) AS pairs_per_query FROM v_pairs",
    "value_counts": "SELECT neg_source, count(*) AS n FROM v_pairs GROUP BY 1",
    "pairs_summary": "SELECT (SELECT count(*) FROM v_pairs) AS rows, (SELECT count(DISTINCT query_id) FROM v_pairs) AS query_count, (SELECT string_agg(query_type || '=' || n, ',' ORDER BY query_type) FROM (SELECT query_type, count(*) AS n FROM v_pairs GROUP BY 1)) AS query_types, (SELECT string_agg(neg_source || '=' || n, ',' ORDER BY neg_source) FROM (SELECT neg_source, count(*) AS n FROM v_pairs GROUP BY 1)) AS neg_sources",
    "missing_keys_report": "SELECT lang, count(*) AS missing FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1",
    "semi_join_exists": "SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "anti_join_remaining": "SELECT src_id, doc_id FROM v_pages p WHERE NOT EXISTS (SELECT 1 FROM v_selected s WHERE s.src_id = p.src_id)",
    "smoke_corpus_distinct": "SELECT DISTINCT gold_doc_id AS doc_id, gold_page_idx AS page_idx, printf('pages/%s/page_%04d.png', gold_doc_id, gold_page_idx) AS image_path FROM v_gold",
    "balanced_weights": "SELECT query_id, query_type, round(1.0::DOUBLE / count(*) OVER (PARTITION BY query_type), 9) AS weight FROM v_lab",
    "split_by_query": "SELECT query_id, nth <= greatest(1, least(n - 1, greatest(20, floor(n * 0.2)))) AS is_val FROM v_lab JOIN (SELECT query_id, row_number() OVER (ORDER BY md5(query_id || '42') DESC, query_id) AS nth, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM v_lab)) USING (query_id)",
    "hinge_loss": f"SELECT round(avg(greatest(0.0::DOUBLE, 0.2::DOUBLE - {DOT('q', 'p')} + {DOT('q', 'n')})), 6) AS loss FROM v_tri",
    "info_nce": f"SELECT batch, round((a.l + b.l) / 2, 6) AS loss FROM {_HALF.format('i')} a JOIN {_HALF.format('j')} b USING (batch)",
    "pos_weighted_pool": f"SELECT vec_id, {_POOL} FROM embeddings",
    "answer_extract": "SELECT query_id, a AS answer FROM v_ans",
    "answer_quality": "SELECT query_id, round(qual, 6) AS quality FROM v_qual",
    "confidence_parse": "SELECT query_id, round(confidence, 6) AS confidence FROM v_conf",
    "blend_select": "SELECT query_id, o.name AS selected_strategy, o.s AS selection_score FROM (SELECT query_id, list_sort([{'s': round(0.30 + 0.70 * qual, 6), 'o': 0, 'name': 'single_page'}, {'s': round(0.35 + 0.70 * qmore, 6), 'o': -1, 'name': 'stitched'}, {'s': round(0.10 + 0.60 * (0.45 * confidence + 0.25 * (query_id % 10) / 10.0 + 0.30 * qual) + 0.30 * qual, 6), 'o': -2, 'name': 'per_page_weighted'}, {'s': round(0.35 + 0.75 * qjoint, 6), 'o': -3, 'name': 'multi_image_joint'}], 'DESC')[1] AS o FROM v_qjoint)",
    "prompts": f"SELECT query_id, {_PROMPT} FROM v_raw",
    "cache_fingerprint": "SELECT page_id, substr(sha256(url || '::' || (page_id * 1000) || '::' || length(html)), 1, 16) AS fingerprint FROM pages",
    "best_sessions": "SELECT user_id, event_id, event_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, value DESC, event_id) AS rank FROM events) WHERE rank <= 3",
}.items()}
