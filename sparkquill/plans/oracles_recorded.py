"""DuckDB SQL for the queries over recorded conversations, written from the rules the rows are made by."""

from __future__ import annotations

from sparkquill.plans.oracles import ANSWERS, GOLD, OWN, norm, squash

P = """p AS (SELECT a.conv_id || '-' || a.turn AS qid, a.conv_id, a.turn, u.text AS u, a.text AS g, (a.conv_id * 31 + a.turn) % 8 AS c
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND a.role = 'assistant' AND u.role = 'user' AND a.text IS NOT NULL AND u.text IS NOT NULL)"""
UNVERIFIED = "The model drafted an answer but none of its citations could be verified against the retrieved passages, so it was withheld."
CUT_OFF = "The model''s reply was cut off at the token limit, so no answer was produced."
UNSUPPORTED = "The retrieved passages do not support an answer."

RESPONSES = f"""{P},
ok AS (SELECT *, length({squash('u')}) >= 12 AS ok_u, length({squash('g')}) >= 12 AS ok_g, contains({squash('u')}, {squash('g')}) AS inside FROM p),
cites AS (SELECT *, CASE c WHEN 0 THEN ok_u::INT + ok_g::INT WHEN 1 THEN (ok_g AND inside)::INT WHEN 5 THEN ok_u::INT WHEN 6 THEN ok_u::INT ELSE 0 END AS kept,
  CASE c WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 5 THEN 6 WHEN 6 THEN 1 WHEN 7 THEN 1 ELSE 0 END AS listed FROM ok),
r AS (SELECT *, c IN (0, 1, 5) AND trim(g) <> '' AND kept > 0 AS answered, listed - kept AS dropped, (length(u) + 5 * length(g)) / 1e6 AS cost,
  CASE WHEN c = 7 THEN '{UNSUPPORTED}' WHEN c IN (0, 1, 5, 6) THEN '{UNVERIFIED}' WHEN c = 4 THEN '{CUT_OFF}' WHEN c = 2 THEN 'not in the passages' ELSE '{UNSUPPORTED}' END AS reason,
  CASE WHEN c = 0 THEN concat_ws(',', CASE WHEN ok_u THEN qid || ':1' END, CASE WHEN ok_g THEN qid || ':2' END) ELSE qid || ':1' END AS cited FROM cites)"""

FAITH = """f AS (SELECT qid, turn, turn % 5 AS n, (SELECT count(*) FROM range(1, 5) t(k) WHERE k <= turn % 5 AND k <> 3 AND (turn + k) % 3 <> 0) AS s FROM p)"""

LINES = """turns AS (SELECT conv_id, turn, text, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations WHERE text IS NOT NULL),
said AS (SELECT * FROM (SELECT conv_id, asked, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM turns) WHERE trim(line) <> ''),
n AS (SELECT conv_id, max(greatest(asked, 1)) AS pages FROM turns GROUP BY conv_id),
shift AS (SELECT conv_id, pages, (pages = 1 OR conv_id IN (SELECT conv_id FROM said WHERE asked = 0))::INT AS front FROM n),
body AS (
  SELECT conv_id, 0 AS section_no, 'Front matter' AS section, 1 AS page, -1 AS seq, 0 AS k, 'Recorded conversations, page 1' AS line FROM shift WHERE pages = 1
  UNION ALL SELECT conv_id, 0, 'Front matter', 1, turn, k, line FROM said WHERE asked = 0
  UNION ALL SELECT conv_id, front, 'Abstract', 1, 0, 0, 'Conversation number ' || conv_id FROM shift
  UNION ALL SELECT conv_id, front + asked, asked || ' Question ' || conv_id, asked, turn, k, line FROM said JOIN shift USING (conv_id) WHERE asked > 0)"""

CHUNKED = rf"""{LINES},
w AS (SELECT conv_id, section_no, section, min(page) AS page, list_filter(string_split({norm("string_agg(line, ' ' ORDER BY seq, k)")}, ' '), lambda x: x <> '') AS w FROM body GROUP BY ALL),
ch AS (SELECT printf('%s:%02d-%s:%03d', conv_id::VARCHAR, section_no, left(trim(regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'), '-'), 40), i) AS chunk_id, conv_id::VARCHAR AS paper_id, section, page::INT AS page,
  array_to_string(w[i * 45 + 1:i * 45 + 60], ' ') AS text FROM (SELECT *, unnest(range(CASE WHEN len(w) > 60 THEN (len(w) - 16) // 45 + 1 ELSE 1 END)) AS i FROM w WHERE len(w) > 0))"""

TAGS = "p|div|h[1-6]|li|ul|ol|tr|td|th|table|br|section|article|nav|header|footer|title|body|html|head"
HTML_LINES = rf"""blocks AS (SELECT page_id, list_filter(list_transform(
    string_split_regex(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?i)</?(?:{TAGS})\b[^>]*>'),
    lambda b: trim(regexp_replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda b: b <> '') AS b FROM pages),
lines AS (SELECT page_id, unnest(b) AS text, unnest(range(len(b))) AS k, len(b) AS n FROM blocks)"""

ORACLE_SQL: dict[str, str] = {
    "citation_check": f"""WITH {P},
      s AS (SELECT qid, {squash('u')} AS t, {squash('left(u, length(u) // 2)')} AS a, {squash('substr(u, length(u) // 2 + 1)')} AS b, {squash('g')} AS g FROM p),
      f AS (SELECT *, length(a) >= 12 AS la, length(b) >= 12 AS lb, position(a IN t) AS pa, position(b IN t) AS pb FROM s),
      k AS (
        SELECT qid, 0 AS pos, a || b AS key, CASE WHEN la AND lb THEN pa > 0 AND contains(substr(t, pa + length(a)), b) WHEN la THEN pa > 0 WHEN lb THEN pb > 0 ELSE false END AS good FROM f
        UNION ALL SELECT qid, 1, b || a, CASE WHEN la AND lb THEN pb > 0 AND contains(substr(t, pb + length(b)), a) WHEN la THEN pa > 0 WHEN lb THEN pb > 0 ELSE false END FROM f
        UNION ALL SELECT qid, 2, t, length(t) >= 12 FROM f UNION ALL SELECT qid, 3, t, length(t) >= 12 FROM f UNION ALL SELECT qid, 4, g, length(g) >= 12 AND contains(t, g) FROM f)
      SELECT qid, pos, CASE WHEN NOT good THEN 'dropped' WHEN row_number() OVER (PARTITION BY qid, good, key ORDER BY pos) = 1 THEN 'kept' ELSE 'merged' END AS verdict FROM k""",
    "citation_parse": f"""WITH {P}
      SELECT qid, pos, source, md5(quote) AS quote_md5 FROM (
        SELECT qid, 0 AS pos, 1 AS source, CASE WHEN c = 1 THEN g ELSE u END AS quote FROM p WHERE c IN (0, 1, 5, 6, 7)
        UNION ALL SELECT qid, 1, 2, g FROM p WHERE c = 0 UNION ALL SELECT qid, unnest([1, 2, 3]), NULL, u FROM p WHERE c = 5
        UNION ALL SELECT qid, 4, 1, NULL FROM p WHERE c = 5 UNION ALL SELECT qid, 5, 9, u FROM p WHERE c = 5)""",
    "response_build": f"""WITH {RESPONSES} SELECT qid, CASE WHEN answered THEN 'answered' ELSE 'refused' END AS status, CASE WHEN answered THEN length(trim(g)) END AS answer_chars, CASE WHEN answered THEN cited ELSE '' END AS cited,
      CASE WHEN NOT answered THEN reason END AS refusal_reason, round(cost, 9) AS estimated_cost_usd, CASE WHEN c <> 7 THEN qid || ':1,' || qid || ':2' END AS retrieved, dropped AS dropped_citations FROM r""",
    "invalid_responses": f"""WITH {RESPONSES} SELECT qid, CASE WHEN answered THEN 'answered without an answer' ELSE 'refused without a reason' END AS problem FROM r
      WHERE CASE WHEN answered THEN length(u) % 3 = 0 ELSE length(u) % 2 = 0 END""",
    "faithfulness": f"WITH {P}, {FAITH} SELECT qid, CASE WHEN n > 0 THEN round(s / n, 6) END AS faithfulness FROM f",
    "answer_rows": f"""WITH {RESPONSES}, {FAITH},
      a AS (SELECT r.*, n, s, c IN (1, 2) AS should, answered AND c NOT IN (1, 2) AS scored, CASE WHEN r.turn % 3 = 0 THEN qid || ':1' ELSE qid || ':2' END AS gold, string_split(cited, ',') AS cl FROM r JOIN f USING (qid))
      SELECT qid, CASE WHEN should THEN 'unanswerable' ELSE 'factual' END AS kind, should AS should_refuse, NOT answered AS refused, CASE WHEN scored THEN list_contains(cl, gold) END AS citation_hit,
        CASE WHEN scored THEN false END AS wrong_paper_citation, dropped AS dropped_citations, CASE WHEN n = 0 THEN 'judge failed: no claims' END AS error,
        CASE WHEN scored THEN round(len(list_filter(cl, lambda x: x = gold)) / len(cl), 6) END AS citation_precision, CASE WHEN scored THEN (turn % 4 < 2)::INT::DOUBLE END AS citation_precision_page,
        CASE WHEN answered AND n > 0 THEN round(s / n, 6) END AS faithfulness, round(cost, 6) AS cost_usd FROM a""",
    "select_questions": f"WITH {GOLD} SELECT id, n AS file_pos FROM gold WHERE status = 'verified' AND id NOT LIKE 'tmpl-%' ORDER BY n LIMIT 100",
    "first_seen_kinds": "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source",
    "invalid_questions": """WITH q AS (SELECT doc_id AS n, doc_id::VARCHAR AS id, toxic = 1 AS un, toxic <> 1 AND quality = 1 AS cross_paper, doc_id % 3 <> 0 AS ev FROM labels),
      b AS (SELECT id, CASE WHEN un AND ev THEN 'unanswerable question with evidence' WHEN NOT un AND NOT ev THEN 'answerable question without evidence' WHEN ev AND n % 5 = 0 THEN 'quote shorter than 20 characters'
        WHEN ev AND n % 7 = 0 THEN 'page below 1' WHEN cross_paper AND n % 2 <> 0 THEN 'cross-paper question without distractors' WHEN ev AND n % 2 = 0 AND n % 11 = 0 THEN 'a distractor is a gold paper' END AS problem FROM q)
      SELECT id, problem FROM b WHERE problem IS NOT NULL""",
    "section_split": f"WITH {LINES} SELECT conv_id::VARCHAR AS doc_id, section_no, section, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, min(page)::INT AS page FROM body GROUP BY ALL",
    "section_chunks": f"WITH {CHUNKED} SELECT * FROM ch",
    "ingest_counts": f"WITH {CHUNKED} SELECT paper_id, count(DISTINCT section) AS sections, count(*) AS chunks FROM ch GROUP BY paper_id",
    "rendered_sources": f"""WITH {P}, t AS (SELECT *, CASE WHEN turn % 2 = 1 THEN 'Conversation ' || conv_id ELSE qid END AS title FROM p WHERE c <> 7)
      SELECT qid, md5('[1] ' || title || ', turn, page 1' || chr(10) || u || chr(10) || chr(10) || '[2] ' || title || ', turn, page 1' || chr(10) || g || chr(10)) AS message_md5 FROM t""",
    "running_lines": f"""WITH {HTML_LINES},
      m AS (SELECT (page_id // 5)::VARCHAR AS doc_id, page_id % 5 + 1 AS page, text, k < 2 OR k >= n - 2 AS margin, regexp_replace(lower(text), '[0-9]+', '#', 'g') AS key FROM lines),
      d AS (SELECT doc_id, max(page) AS pages FROM m GROUP BY doc_id),
      run AS (SELECT doc_id, key FROM m JOIN d USING (doc_id) WHERE margin GROUP BY doc_id, key, pages HAVING count(DISTINCT page) >= greatest(2, pages // 2))
      SELECT doc_id, count(*) AS kept, count(*) FILTER (WHERE margin) AS kept_margin FROM m
      WHERE NOT margin OR ((doc_id, key) NOT IN (SELECT (doc_id, key) FROM run) AND NOT regexp_full_match(text, '[0-9]{{1,3}}')) GROUP BY doc_id""",
    "bootstrap_ci": f"""{OWN},
      d AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS i, d FROM (SELECT qid, sum(recall) FILTER (WHERE retriever = 'bm25') - sum(recall) FILTER (WHERE retriever = 'fts') AS d FROM per GROUP BY qid)),
      draws AS (SELECT rep, ('0x' || substr(md5('7|' || rep || '|' || j), 1, 8))::BIGINT % (SELECT count(*) FROM d) AS i FROM range(5000) a(rep), range((SELECT count(*) FROM d)) b(j)),
      means AS (SELECT rep, avg(d) AS m FROM draws JOIN d USING (i) GROUP BY rep)
      SELECT round((SELECT avg(d) FROM d), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM means""",
    "spotcheck_sample": f"{ANSWERS} SELECT qid, refused, fa::DOUBLE AS faithfulness FROM a ORDER BY md5('3|' || qid), qid LIMIT 20",
}
