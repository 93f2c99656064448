"""DuckDB SQL for the queries whose rows have been through files, written from the rules the rows are made by."""

from __future__ import annotations

from sparkquill.plans.oracles import CUT, GOLD, VERSIONS
from sparkquill.plans.oracles_recorded import RESPONSES

PREFIX = "Represent this sentence for searching relevant passages: "

ORACLE_SQL: dict[str, str] = {
    "store_versions": f"""WITH {VERSIONS} SELECT 1 AS version, doc_id, lang, embedding FROM o
      UNION ALL SELECT 2, coalesce(o.doc_id, n.doc_id), CASE WHEN n.doc_id IS NOT NULL THEN n.lang ELSE o.lang END, coalesce(n.embedding, o.embedding) FROM o FULL JOIN n ON o.doc_id = n.doc_id
      UNION ALL SELECT 3, n.doc_id, n.lang, coalesce(n.embedding, o.embedding) FROM n LEFT JOIN o ON o.doc_id = n.doc_id""",
    "gold_file": f"""WITH {GOLD},
      j AS (SELECT n, CASE WHEN n % 2 = 0 AND n % 19 <> 0 THEN status ELSE 'verified' END AS status, CASE WHEN n % 5 = 0 THEN 'not a row of the schema' WHEN n % 13 = 0 THEN 'no such kind: odd'
        WHEN kind = 'factual' AND n % 11 = 0 THEN 'answerable question without evidence' WHEN kind = 'factual' AND n % 7 = 0 THEN 'quote shorter than 20 characters' END AS problem FROM gold),
      k AS (SELECT *, n % 19 = 0 AND row_number() OVER (PARTITION BY problem, n % 19 = 0 ORDER BY n) > 1 AS again FROM j)
      SELECT CASE WHEN problem IS NOT NULL THEN problem WHEN again THEN 'id same stands in a line already' ELSE 'sound, ' || status END AS what, count(*) AS n FROM k GROUP BY ALL""",
    "chunk_file": f"WITH {CUT} SELECT chunk_id, doc_id::VARCHAR AS paper_id, source AS section, (n + 1)::INT AS page, md5(text) AS text_md5 FROM chunks",
    "metrics_file": "SELECT source AS metric, round(avg(n_chars), 3) AS value FROM documents WHERE source IS NOT NULL GROUP BY source",
    "review_files": f"""WITH {GOLD} SELECT id, CASE WHEN n % 3 = 0 THEN 'rejected' ELSE 'verified' END AS status, CASE WHEN n % 5 = 0 THEN 'edited' END AS question, NULL::VARCHAR AS answer,
      CASE WHEN n % 7 = 0 THEN 'look "again"' END AS comment FROM gold""",
    "markdown_report": """SELECT '| source | documents | mean_chars | english |' AS line UNION ALL SELECT '|---|---|---|---|' UNION ALL
      SELECT '| ' || coalesce(source, '–') || ' | ' || count(*) || ' | ' || coalesce(printf('%.3f', avg(n_chars) FILTER (WHERE doc_id % 2 = 0)), '–') || ' | ' || coalesce(printf('%.1f%%', 100 * avg((lang = 'en')::INT)), '–') || ' |' FROM documents GROUP BY source""",
    "summary_rows": """SELECT unnest([0, 1, 2])::INT AS n, unnest(['n_documents', 'mean_chars', 'no_such']) AS metric, unnest([count(*)::VARCHAR, coalesce(printf('%.3f', avg(n_chars)), '–'), '–']) AS value FROM documents""",
    "ask_log": f"""WITH {RESPONSES} SELECT '{{"event":"ask","qid":"' || qid || '","status":"' || CASE WHEN answered THEN 'answered' ELSE 'refused' END || '","dropped_citations":' || dropped
      || ',"input_tokens":' || length(u) || ',"output_tokens":' || length(g) || '}}' AS value FROM r""",
    "query_texts": f"SELECT item_id AS qid, md5('{PREFIX}' || text) AS prefixed, md5(text) AS plain FROM benchmark",
    "array_metrics": """WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS r, list(DISTINCT l_partkey) FILTER (WHERE l_quantity > 25) AS g FROM lineitem GROUP BY l_orderkey)
      SELECT l_orderkey, round(len(list_intersect(list_distinct(r[1:2]), g)) / len(g), 6) AS recall, list_has_any(r[1:2], g)::INT::DOUBLE AS hit,
        round(1.0::DOUBLE / list_min(list_filter(range(1, len(r) + 1), lambda i: list_contains(g, r[i]))), 6) AS rr FROM o WHERE len(g) > 0""",
}
