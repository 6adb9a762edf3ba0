"""SQL that the queries of this subpackage are checked against."""

_LONG = r"length(regexp_replace(text, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')) > 500"

_TOP = """
WITH e AS (SELECT node_id, unnest(mounted_chunk_ids) AS chunk_id,
                  unnest(list_resize(scores, len(mounted_chunk_ids))) AS score
           FROM node_mountings WHERE node_id IS NOT NULL),
b AS (SELECT node_id, chunk_id, max(score) AS score FROM e
      WHERE chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY node_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM b)
SELECT {columns} FROM r WHERE rank <= 6
"""

_SCORES = """
WITH m AS (
  SELECT query_id AS g, id AS item,
         max(vector_score) FILTER (NOT isnan(vector_score)) AS s0,
         max(bm25_score) FILTER (NOT isnan(bm25_score)) AS s1,
         max(score) FILTER (NOT isnan(score)) AS s2
  FROM retrieval_results WHERE query_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL)
"""

SQL = {
    "p1_found": f"SELECT DISTINCT id FROM text_chunks WHERE {_LONG} AND id IS NOT NULL",
    "p5_found": _TOP.format(columns="node_id, chunk_id"),
    "p5_topn": _TOP.format(columns="node_id, chunk_id, score, rank"),
    "p6_found": _SCORES
    + """,
r AS (SELECT *, count(*) OVER (PARTITION BY g ORDER BY s0 DESC NULLS LAST RANGE UNBOUNDED PRECEDING) AS c0,
             count(*) OVER (PARTITION BY g ORDER BY s1 DESC NULLS LAST RANGE UNBOUNDED PRECEDING) AS c1,
             count(*) OVER (PARTITION BY g ORDER BY s2 DESC NULLS LAST RANGE UNBOUNDED PRECEDING) AS c2 FROM m),
few AS (SELECT * FROM r WHERE least(c0, c1, c2) <= 5),
cand AS (SELECT * FROM r WHERE greatest(c0, c1, c2) <= 5)
SELECT cand.g AS query_id, cand.item AS id
FROM cand JOIN few ON few.g = cand.g
GROUP BY ALL
HAVING count(*) FILTER (few.item <> cand.item AND (few.c0 <= cand.c0 OR few.c1 <= cand.c1 OR few.c2 <= cand.c2)) <= 4
""",
    "p6_ranking": _SCORES
    + """,
r AS (SELECT g, item, count(*) OVER (PARTITION BY g) AS n,
             CASE WHEN s0 IS NULL THEN count(*) OVER (PARTITION BY g)
                  ELSE rank() OVER (PARTITION BY g ORDER BY s0 DESC NULLS LAST) END AS r0,
             CASE WHEN s1 IS NULL THEN count(*) OVER (PARTITION BY g)
                  ELSE rank() OVER (PARTITION BY g ORDER BY s1 DESC NULLS LAST) END AS r1,
             CASE WHEN s2 IS NULL THEN count(*) OVER (PARTITION BY g)
                  ELSE rank() OVER (PARTITION BY g ORDER BY s2 DESC NULLS LAST) END AS r2 FROM m),
u AS (SELECT *, list_sort([r0 / n, r1 / n, r2 / n]) AS u, (r0 + r1 + r2) / 3.0::DOUBLE AS mean FROM r),
p AS (SELECT *, least(3 * u[1] * pow(1 - u[1], 2) + 3 * pow(u[1], 2) * (1 - u[1]) + pow(u[1], 3),
                      3 * pow(u[2], 2) * (1 - u[2]) + pow(u[2], 3), pow(u[3], 3)) AS p FROM u)
SELECT g AS query_id, item AS id, round(least(1.0, 3 * p), 9) AS rho,
       row_number() OVER (PARTITION BY g ORDER BY round(ln(p), 9), round(mean, 9), item) AS place
FROM p
""",
}
