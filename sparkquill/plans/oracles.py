"""DuckDB SQL for the catalogue's queries, written apart from the Spark code."""

from __future__ import annotations

STOP = "'a','an','and','are','as','at','be','by','does','do','for','from','has','have','how','in','is','it','its','of','on','or','that','the','this','to','was','what','when','where','which','who','why','with'"


def norm(x: str) -> str:
    x = f"replace(replace(replace({x}, 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')"
    x = f"""translate({x}, '’‘“”–—', '''''""--')"""
    x = rf"regexp_replace({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g')"
    x = rf"regexp_replace({x}, '([\pL\pN_])-\s*\n\s*([\pL\pN_])', '\1\2', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def squash(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def toks(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: w NOT IN ({STOP}))"


CUT = f"""cut AS (SELECT doc_id, source, lang, list_filter(string_split(w, ' '), lambda y: y <> '') AS w FROM (SELECT doc_id, source, lang, {norm('text')} AS w FROM documents)),
chunks AS (
  SELECT doc_id, source, lang, n, printf('%010d:%03d', doc_id, n) AS chunk_id, array_to_string(w[n * 250 + 1:n * 250 + 300], ' ') AS text
  FROM (SELECT *, unnest(range(0, CASE WHEN len(w) > 300 THEN (len(w) - 51) // 250 + 1 WHEN len(w) > 0 THEN 1 ELSE 0 END)) AS n FROM cut))"""
HEADED = "headed AS (SELECT chunk_id, coalesce(lang, doc_id::VARCHAR) || '. ' || source || '. ' || text AS text FROM chunks)"
ASKED = "questions AS (SELECT item_id AS qid, text AS question FROM benchmark)"


def tokens(source: str, name: str = "tk") -> str:
    return f"{name} AS (SELECT chunk_id, {toks('text')} AS t FROM {source})"


def bm25(name: str, source: str, k: int, questions: str = "questions") -> str:
    p = name
    return f"""{p}_tk AS (SELECT chunk_id, {toks('text')} AS t FROM {source}),
{p}_st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {p}_tk),
{p}_tf AS (SELECT chunk_id, dl, token, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS token FROM {p}_tk) GROUP BY ALL),
{p}_df AS (SELECT token, count(*) AS df FROM {p}_tf GROUP BY token),
{p}_raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM {p}_df, {p}_st),
{p}_idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {p}_raw) ELSE raw END AS idf FROM {p}_raw),
{p}_q AS (SELECT qid, unnest({toks('question')}) AS token FROM {questions}),
{p}_hit AS (SELECT qid, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {p}_q JOIN {p}_tf USING (token) JOIN {p}_idf USING (token), {p}_st GROUP BY ALL),
{p}_all AS (SELECT qid, chunk_id, coalesce(score, 0.0) AS score FROM (SELECT qid FROM {questions}) CROSS JOIN (SELECT chunk_id FROM {source}) LEFT JOIN {p}_hit USING (qid, chunk_id)),
{p} AS (SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM {p}_all) WHERE rank <= {k})"""


def fts(name: str, source: str, k: int, questions: str = "questions") -> str:
    p = name
    return f"""{p}_tf AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest({toks('text')}) AS token FROM {source}) GROUP BY ALL),
{p}_q AS (SELECT DISTINCT qid, token FROM (SELECT qid, unnest({toks('question')}) AS token FROM {questions})),
{p}_hit AS (SELECT qid, chunk_id, sum(tf)::DOUBLE AS score FROM {p}_q JOIN {p}_tf USING (token) GROUP BY ALL),
{p} AS (SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM {p}_hit) WHERE rank <= {k})"""


def rrf(name: str, left: str, right: str, k: int) -> str:
    return f"""{name} AS (SELECT qid, chunk_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT qid, chunk_id, rank FROM {left} UNION ALL SELECT qid, chunk_id, rank FROM {right}) GROUP BY ALL)) WHERE rank <= {k})"""


QUOTES = f"""q0 AS (SELECT doc_id, {norm('text')} AS t FROM documents WHERE doc_id % 20 = 0),
q1 AS (SELECT doc_id, t, unnest(range(1, (length(t) + 699) // 700 + 1)) AS ev FROM q0),
quotes AS (SELECT doc_id AS qid, ev::INT AS ev, doc_id::VARCHAR AS paper_id, substr(t, (ev - 1) * 700 + 1, 90) AS quote FROM q1 WHERE length(substr(t, (ev - 1) * 700 + 1, 90)) >= 20)"""
SHIFTED = "asked AS (SELECT qid, ev, CASE ev WHEN 2 THEN 'none' WHEN 3 THEN (qid + 1)::VARCHAR ELSE qid::VARCHAR END AS paper_id, quote FROM quotes)"


def resolve(source: str) -> str:
    return f"""met AS (SELECT qid, ev, chunk_id, contains(t, q) AS whole, contains(t, left(q, 40)) OR contains(t, right(q, 40)) AS piece
  FROM (SELECT qid, ev, paper_id, {squash('quote')} AS q FROM {source}) JOIN (SELECT doc_id::VARCHAR AS paper_id, chunk_id, {squash('text')} AS t FROM chunks) USING (paper_id)),
resolved AS (SELECT qid, ev, chunk_id, whole FROM (SELECT *, bool_or(whole) OVER (PARTITION BY qid, ev) AS any_whole FROM met WHERE whole OR piece) WHERE whole OR NOT any_whole)"""


OWN = f"""WITH {CUT}, {QUOTES}, {resolve('quotes')},
own AS (SELECT qid, arg_min(quote, ev) AS question, count(*) AS n_evidence, CASE WHEN qid % 100 = 0 THEN 'cross_paper' ELSE 'factual' END AS kind FROM quotes GROUP BY qid),
{bm25('b', 'chunks', 10, 'own')}, {fts('f', 'chunks', 10, 'own')},
rankings AS (SELECT 'bm25' AS retriever, qid, chunk_id, rank FROM b UNION ALL SELECT 'fts', qid, chunk_id, rank FROM f),
found AS (SELECT retriever, qid, count(DISTINCT ev) AS found FROM rankings JOIN resolved USING (qid, chunk_id) WHERE rank <= 5 GROUP BY ALL),
firsts AS (SELECT retriever, qid, min(rank) AS rank FROM rankings JOIN resolved USING (qid, chunk_id) WHERE rank <= 10 GROUP BY ALL),
bad AS (SELECT retriever, qid, avg((ltrim(split_part(chunk_id, ':', 1), '0') = ltrim(qid::VARCHAR, '0'))::INT) AS bad FROM rankings WHERE rank <= 5 GROUP BY ALL),
per AS (SELECT retriever, qid, kind, coalesce(found, 0) / n_evidence AS recall, (rank IS NOT NULL)::INT::DOUBLE AS hit, rank, coalesce(1.0::DOUBLE / rank, 0.0) AS rr, CASE WHEN kind = 'cross_paper' THEN coalesce(bad, 0.0) END AS wrong
  FROM own CROSS JOIN (SELECT DISTINCT retriever FROM rankings) LEFT JOIN found USING (retriever, qid) LEFT JOIN firsts USING (retriever, qid) LEFT JOIN bad USING (retriever, qid))"""

ANSWERS = """WITH a AS (SELECT o_orderkey AS qid, o_orderpriority AS kind, o_orderstatus = 'P' AS should_refuse, o_custkey % 5 = 0 AS refused,
  CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 4) / 4.0 END AS cp, o_custkey % 3 = 0 AS hit, o_custkey % 11 = 0 AS wp, CASE WHEN o_custkey % 13 <> 0 THEN (o_custkey % 8) / 8.0 END AS fa,
  o_custkey % 2 AS dropped, o_totalprice AS latency_ms, o_custkey AS c,
  CASE WHEN o_custkey % 17 = 0 THEN 'judge failed: timeout' WHEN o_custkey % 19 = 0 THEN 'pipeline failed' END AS error FROM orders),
r AS (SELECT *, error IS NULL OR error LIKE 'judge failed%' AS scored, error IS NULL AS ok FROM a)"""
MEANS = """round(avg((refused = should_refuse)::INT) FILTER (WHERE scored), 6) AS refusal_accuracy,
  round(avg(cp::DOUBLE) FILTER (WHERE scored AND NOT should_refuse AND NOT refused), 6) AS citation_precision,
  round(avg(wp::INT) FILTER (WHERE scored AND NOT should_refuse AND NOT refused), 6) AS wrong_paper_citation_rate, round(avg(fa::DOUBLE) FILTER (WHERE scored), 6) AS faithfulness"""
GOLD = """gold AS (SELECT CASE WHEN doc_id % 17 = 0 THEN 'tmpl-' || doc_id ELSE doc_id::VARCHAR END AS id, CASE WHEN toxic = 1 THEN 'unanswerable' ELSE 'factual' END AS kind,
  CASE WHEN quality = 1 THEN 'verified' ELSE 'draft' END AS status, 'question ' || doc_id AS question, CASE WHEN doc_id % 2 = 0 THEN 'old note' END AS notes, doc_id AS n FROM labels)"""
VERSIONS = """o AS (SELECT doc_id, lang, n_chars::DOUBLE AS embedding FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT doc_id, upper(lang) AS lang, CASE WHEN doc_id % 4 = 0 THEN -1.0::DOUBLE END AS embedding FROM documents WHERE doc_id % 2 = 0)"""


def md5_mod(x: str, dim: int) -> str:
    r = "0"
    for k in range(4):
        r = f"(({r}) * {2**32 % dim} + ('0x' || substr(md5({x}), {8 * k + 1}, 8))::BIGINT) % {dim}"
    return r


def hashed(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_w AS (SELECT {key}, ({md5_mod('w', 64)})::INT AS bucket, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {source}) GROUP BY ALL),
{name} AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS v FROM {name}_w)"""


VECTOR_TOPK = """SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
      SELECT q.vec_id AS qid, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)) WHERE rank <= 10"""

ORACLE_SQL: dict[str, str] = {
    "normalize_text": f"SELECT doc_id, {norm('text')} AS normalized FROM documents",
    "squash_text": f"SELECT doc_id, {squash('text')} AS squashed FROM documents",
    "slug_text": "SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 40), ''), 'body') AS slug FROM documents",
    "clean_titles": "SELECT p_partkey, '3 ' || upper(left(rtrim(p_name, '.'), 1)) || lower(substr(rtrim(p_name, '.'), 2)) AS title, rtrim(p_name, '.') AS plain FROM part",
    "tokenize_count": f"SELECT doc_id, len(t)::INT AS n_tokens, array_to_string(t[1:10], ' ') AS first_tokens FROM (SELECT doc_id, {toks('text')} AS t FROM documents)",
    "chunk_words": f"WITH {CUT} SELECT chunk_id, text FROM chunks",
    "postings_tf": f"WITH {CUT}, {tokens('chunks')} SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS token FROM tk) GROUP BY ALL",
    "doc_freq": f"WITH {CUT}, {tokens('chunks')} SELECT token, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest(t) AS token FROM tk) GROUP BY ALL",
    "corpus_stats": f"WITH {CUT}, {tokens('chunks')} SELECT count(*) AS n_chunks, round(avg(len(t)), 6) AS avgdl FROM tk",
    "bm25_idf": f"WITH {CUT}, {ASKED}, {bm25('b', 'chunks', 10)} SELECT token, df, round(idf, 6) AS idf FROM b_idf JOIN b_df USING (token)",
    "bm25_topk": f"WITH {CUT}, {ASKED}, {bm25('b', 'chunks', 10)} SELECT * FROM b",
    "bm25_header_topk": f"WITH {CUT}, {HEADED}, {ASKED}, {bm25('b', 'headed', 10)} SELECT * FROM b",
    "fts_cover_topk": f"""WITH {CUT}, {ASKED},
w AS (SELECT qid, list_sort(list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda x: length(x) >= 8)))[1:2] AS ws FROM questions),
tk AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM chunks),
hit AS (SELECT qid, chunk_id, pos, word, len(ws) AS n FROM (SELECT chunk_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM tk) JOIN (SELECT qid, ws, unnest(ws) AS word FROM w) USING (word)),
near AS (SELECT *, lag(word) OVER (PARTITION BY qid, chunk_id ORDER BY pos) AS before, lag(pos) OVER (PARTITION BY qid, chunk_id ORDER BY pos) AS place FROM hit),
s AS (SELECT qid, chunk_id, round(sum(CASE WHEN n = 1 THEN 0.1::DOUBLE WHEN before <> word THEN 0.1::DOUBLE / (pos - place) ELSE 0 END), 9) AS score FROM near GROUP BY qid, chunk_id HAVING count(DISTINCT word) = any_value(n))
SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""",
    "fts_or_topk": f"WITH {CUT}, {ASKED}, {fts('f', 'chunks', 10)} SELECT * FROM f",
    "vector_topk": VECTOR_TOPK,
    "vector_index_topk": VECTOR_TOPK,
    "vector_width": "SELECT label, count(embedding) AS n, min(len(embedding))::INT AS width, round(avg(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings GROUP BY label",
    "hash_buckets": f"SELECT w AS word, ({md5_mod('w', 384)})::INT AS bucket FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)",
    "hash_embed_topk": f"""WITH {ASKED}, {hashed('hq', 'questions', 'qid', 'question')}, {hashed('hd', 'documents', 'doc_id', 'text')},
      s AS (SELECT qid, doc_id AS chunk_id, sum(hq.v * hd.v) AS s FROM hq JOIN hd USING (bucket) GROUP BY ALL),
      f AS (SELECT qid, chunk_id, round(coalesce(s, 0.0), 6) AS score FROM (SELECT DISTINCT qid FROM hq) CROSS JOIN (SELECT DISTINCT doc_id AS chunk_id FROM hd) LEFT JOIN s USING (qid, chunk_id))
      SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 10""",
    "hybrid_rrf": f"WITH {CUT}, {ASKED}, {bm25('b', 'chunks', 50)}, {fts('f', 'chunks', 50)}, {rrf('r', 'b', 'f', 10)} SELECT * FROM r",
    "hybrid_header_rrf": f"WITH {CUT}, {HEADED}, {ASKED}, {bm25('b', 'headed', 50)}, {fts('f', 'chunks', 50)}, {rrf('r', 'b', 'f', 10)} SELECT * FROM r",
    "hybrid_rerank_overlap": f"""WITH {CUT}, {ASKED}, {bm25('b', 'chunks', 50)}, {fts('f', 'chunks', 50)}, {rrf('r', 'b', 'f', 20)},
      s AS (SELECT qid, chunk_id, r.rank AS base_rank, len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))))::DOUBLE AS score
        FROM r JOIN questions USING (qid) JOIN chunks USING (chunk_id))
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, base_rank) AS rank FROM s) WHERE rank <= 10""",
    "hybrid_vector_rrf": f"""WITH {CUT}, {HEADED}, {ASKED}, {bm25('b', 'headed', 50)}, {hashed('hq', 'questions', 'qid', 'question')}, {hashed('hd', 'headed', 'chunk_id', 'text')},
      hs AS (SELECT qid, chunk_id, sum(hq.v * hd.v) AS s FROM hq JOIN hd USING (bucket) GROUP BY ALL),
      hf AS (SELECT qid, chunk_id, round(coalesce(s, 0.0), 6) AS score FROM (SELECT DISTINCT qid FROM hq) CROSS JOIN (SELECT DISTINCT chunk_id FROM hd) LEFT JOIN hs USING (qid, chunk_id)),
      h AS (SELECT qid, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM hf) WHERE rank <= 50), {rrf('r', 'b', 'h', 10)} SELECT * FROM r""",
    "evidence_resolve": f"WITH {CUT}, {QUOTES}, {resolve('quotes')} SELECT * FROM resolved",
    "evidence_head_tail": f"WITH {CUT}, {QUOTES}, cut_off AS (SELECT * REPLACE (quote || ' and so forth' AS quote) FROM quotes), {resolve('cut_off')} SELECT qid, ev, chunk_id FROM resolved WHERE NOT whole",
    "evidence_unresolved": f"""WITH {CUT}, {QUOTES}, {SHIFTED}, {resolve('asked')}
      SELECT qid, ev, CASE WHEN paper_id NOT IN (SELECT doc_id::VARCHAR FROM chunks) THEN 'paper ''' || paper_id || ''' is not in the corpus' ELSE 'quote not found in ' || paper_id END AS problem
      FROM asked WHERE (qid, ev) NOT IN (SELECT (qid, ev) FROM resolved)""",
    "evidence_anywhere": f"""WITH {CUT} SELECT DISTINCT item_id AS qid, 1 AS ev, chunk_id FROM (SELECT item_id, {squash('text')} AS q FROM benchmark), (SELECT chunk_id, {squash('text')} AS t FROM chunks)
      WHERE contains(t, q)""",
    "evidence_pages": f"""WITH {CUT}, {QUOTES},
      t AS (SELECT doc_id, n + 1 AS page, {squash('text')} AS t FROM chunks),
      u AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY page) AS nxt FROM t),
      m AS (SELECT qid, ev, u.page, contains(t, q) AS whole, nxt IS NOT NULL AND contains(t || coalesce(nxt, ''), q) AND contains(t, left(q, 40)) AS starts
        FROM (SELECT qid, ev, {squash('quote')} AS q FROM quotes) JOIN u ON doc_id = qid),
      g AS (SELECT qid, ev, coalesce(list_sort(list(page) FILTER (WHERE whole)), CASE WHEN bool_or(starts) THEN [min(page) FILTER (WHERE starts)] END, []) AS p FROM m GROUP BY ALL)
      SELECT qid, ev, (CASE WHEN len(p) > 0 AND NOT list_contains(p, 1) THEN p[1] ELSE 1 END)::INT AS page,
        CASE WHEN p IS NULL THEN NULL WHEN len(p) = 0 THEN qid || ': quote not found in ' || qid || ' (left page 1)' WHEN NOT list_contains(p, 1) THEN qid || ': ' || qid || ' page 1 -> ' || p[1] END AS note
      FROM quotes LEFT JOIN g USING (qid, ev)""",
    "question_metrics": f"{OWN} SELECT retriever, qid, kind, round(recall, 6) AS recall, hit, rank::DOUBLE AS rank, round(rr, 6) AS rr, round(wrong, 6) AS wrong FROM per",
    "retriever_ablation": f"""{OWN} SELECT retriever, kind, count(*) AS n, round(avg(recall), 6) AS recall_at_5, round(avg(rr), 6) AS mrr_at_10, round(avg(wrong), 6) AS wrong_paper_at_5
      FROM per GROUP BY GROUPING SETS ((retriever, kind), (retriever))""",
    "latency_percentiles": "SELECT event_type, min(value) AS p0, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS p100 FROM events GROUP BY event_type",
    "answer_summary": f"""{ANSWERS} SELECT count(*) AS n_questions, count(error) AS n_errors, count(*) FILTER (WHERE scored AND NOT should_refuse) AS n_answerable, count(*) FILTER (WHERE scored AND should_refuse) AS n_unanswerable,
      round(avg(refused::INT) FILTER (WHERE scored AND NOT should_refuse), 6) AS false_refusal_rate, round(avg((NOT refused)::INT) FILTER (WHERE scored AND should_refuse), 6) AS false_answer_rate,
      round(avg(hit::INT) FILTER (WHERE scored AND NOT should_refuse AND NOT refused), 6) AS citation_hit_rate, {MEANS}, (sum(dropped) FILTER (WHERE scored))::BIGINT AS citations_dropped_total,
      quantile_disc(latency_ms, 0.5) FILTER (WHERE ok) AS latency_p50_ms, quantile_disc(latency_ms, 0.95) FILTER (WHERE ok) AS latency_p95_ms,
      round(avg(c * 3) FILTER (WHERE ok), 6) AS mean_input_tokens, round(avg(c) FILTER (WHERE ok), 6) AS mean_output_tokens, round(avg((c * 3 * 1.0::DOUBLE + c * 5.0::DOUBLE) / 1e6) FILTER (WHERE ok), 6) AS mean_cost_usd,
      round(sum(0.0075::DOUBLE), 6) AS total_judge_cost_usd FROM r""",
    "answer_summary_by_kind": f"{ANSWERS} SELECT kind, count(*) AS n_questions, count(error) AS n_errors, {MEANS} FROM r GROUP BY kind",
    "regression_gate": """WITH l AS (SELECT l_returnflag || l_linestatus AS metric, l_quantity, l_orderkey FROM lineitem)
      SELECT metric FROM (SELECT metric, avg(l_quantity) AS now FROM l GROUP BY metric) JOIN (SELECT metric, avg(l_quantity) AS base FROM l WHERE l_orderkey % 2 = 0 GROUP BY metric) USING (metric) WHERE now < base""",
    "upsert_chunks": f"""WITH {VERSIONS} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.lang ELSE o.lang END AS lang, coalesce(n.embedding, o.embedding) AS embedding
      FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
    "stale_chunks": f"WITH {VERSIONS} SELECT doc_id FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)",
    "store_stats": "SELECT count(*) AS n_chunks, count(*) FILTER (WHERE doc_id % 4 = 0) AS n_embedded FROM documents",
    "gold_composition": f"WITH {GOLD} SELECT kind, count(*) AS total, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE status = 'draft') AS drafts FROM gold GROUP BY kind",
    "duplicate_ids": "SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
    "scored_questions": f"WITH {GOLD} SELECT id FROM gold WHERE kind <> 'unanswerable' AND status = 'verified' AND id NOT LIKE 'tmpl-%'",
    "apply_reviews": f"""WITH {GOLD},
      rv AS (SELECT id, CASE n % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'verified' WHEN 2 THEN 'needs_fix' ELSE 'draft' END AS v, n % 5 = 0 AS eq, n % 7 = 0 AS ea, n % 8 = 2 AS ec FROM gold WHERE n % 3 <> 0)
      SELECT id, CASE WHEN eq THEN 'edited question' ELSE question END AS question, CASE WHEN ea THEN 'an answer' END AS reference_answer, CASE WHEN v = 'verified' THEN 'verified' ELSE status END AS status,
        CASE WHEN v = 'needs_fix' THEN concat_ws(' | ', notes, CASE WHEN ec THEN 'Reviewer: look again' ELSE 'Reviewer flagged this for a fix.' END) ELSE notes END AS notes,
        CASE WHEN v IN ('verified', 'needs_fix') THEN v WHEN eq OR ea THEN 'edited' ELSE 'unchanged' END AS action
      FROM gold LEFT JOIN rv USING (id) WHERE v IS DISTINCT FROM 'rejected'""",
}
