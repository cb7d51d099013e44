"""Registered queries: pre-ranked enrichment (ANA9) in long and vector form."""

from __future__ import annotations

from sigflow.functions.common import rounded
from sigflow.operators import enrich as E
from sigflow.plans.oracles_base import with_views
from sigflow.sources import proxies as px

# The proxy pathways have 12-13 members, below the library's default
# minimum of 15; the queries use a minimum of 5 (maximum unchanged).
MIN_SIZE = 5


def ana9_enrichment(spark, sf):
    out = E.prerank_long(px.signatures_long(spark, sf), px.pathways(spark, sf), min_size=MIN_SIZE)
    return rounded(out)


def ana9_enrichment_vectors(spark, sf):
    out = E.enrichment_vectors(px.signatures(spark, sf), px.pathways(spark, sf), min_size=MIN_SIZE)
    return rounded(out)


QUERIES = {
    "ANA9_enrichment": ana9_enrichment,
    "ANA9_enrichment_vectors": ana9_enrichment_vectors,
}

_ES = f"""
WITH ranked AS (
    SELECT sig_id, gene, v, row_number() OVER (PARTITION BY sig_id ORDER BY v DESC, gene) AS r,
           count(*) OVER (PARTITION BY sig_id) AS N
    FROM v_signatures_long WHERE v IS NOT NULL),
hits AS (SELECT r.sig_id, p.pathway_id, r.r, abs(r.v) AS w, r.N FROM ranked r JOIN v_pathways p USING (gene)),
h2 AS (SELECT *, row_number() OVER (PARTITION BY sig_id, pathway_id ORDER BY r) AS i,
              sum(w) OVER (PARTITION BY sig_id, pathway_id ORDER BY r
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS csum,
              count(*) OVER (PARTITION BY sig_id, pathway_id) AS nh,
              sum(w) OVER (PARTITION BY sig_id, pathway_id) AS wsum
       FROM hits),
st AS (SELECT sig_id, pathway_id, max(csum / wsum - (r - i) / (N - nh)) AS hi,
              min((csum - w) / wsum - (r - i) / (N - nh)) AS lo,
              any_value(nh) AS nh, any_value(N) AS nn, any_value(wsum) AS wsum FROM h2 GROUP BY ALL)
SELECT sig_id, pathway_id,
       round(CASE WHEN nh < nn AND wsum > 0 THEN CASE WHEN abs(hi) > abs(lo) THEN hi ELSE lo END END, 6) AS es,
       nh AS n_hits
FROM st WHERE nh >= {MIN_SIZE} AND nh <= {E.MAX_SIZE}"""

ORACLES = {
    "ANA9_enrichment": with_views(_ES),
    "ANA9_enrichment_vectors": with_views(_ES),
}
