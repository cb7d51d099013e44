"""DuckDB SQL for the proxy views (see ``sigflow.sources.proxies``).

The oracle queries are written independently of the Spark code: each one is
``WITH <proxy views> <query>``; DuckDB ignores CTEs a query does not use.
"""

from __future__ import annotations

# Fixed values of the proxy mapping (same as sigflow.sources.proxies).
CTES = {
    "v_signatures": """
        SELECT vec_id AS sig_id, embedding AS features, label AS moa,
               vec_id % 4 AS cell
        FROM embeddings""",
    "v_signatures_long": """
        SELECT vec_id AS sig_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS gene,
               CAST(unnest(embedding) AS DOUBLE) AS v
        FROM embeddings""",
    "v_signatures_null": """
        SELECT sig_id, gene,
               CASE WHEN gene % 16 = 0 AND sig_id % 50 = 0 THEN NULL ELSE v END AS v
        FROM v_signatures_long""",
    "v_sig_info": """
        SELECT event_id AS sig_id, user_id AS cell_iname, event_type AS pert_type,
               value AS tas, CAST(json_extract_string(props, '$.k') AS BIGINT) AS pert_id
        FROM events""",
    "v_available": """
        SELECT event_id AS sig_id FROM events WHERE event_id % 10 <> 0""",
    "v_compounds": """
        WITH pp AS (SELECT *, CASE WHEN p_partkey % 17 = 0 THEN NULL
                    ELSE upper(replace(p_name, ' ', '')) || '-' || CAST(p_size % 9 AS VARCHAR) END AS smiles
                    FROM part)
        SELECT p_partkey AS pert_id, p_name AS cmap_name,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS moa,
               p_type AS cluster_id, p_size AS target, smiles AS canonical_smiles, p_partkey * 2 AS _ord
        FROM pp
        UNION ALL
        SELECT p_partkey, p_name, p_brand || '_alt', p_type, p_size + 100, smiles, p_partkey * 2 + 1
        FROM pp WHERE p_partkey % 3 = 0""",
    "v_cells": """
        SELECT c_custkey AS cell_iname,
               CASE WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE 'CVCL_' || CAST(c_nationkey AS VARCHAR) END
                   AS cellosaurus_id,
               c_custkey AS _ord
        FROM customer""",
    "v_genes": """
        SELECT DISTINCT CAST(unnest(range(len(embedding))) AS INTEGER) AS gene FROM embeddings""",
    "v_pathways": """
        SELECT p.pathway_id, g.gene
        FROM v_genes g, (SELECT CAST(unnest(range(6)) AS INTEGER) AS pathway_id) p
        WHERE (g.gene * 7 + p.pathway_id * 3) % 5 = p.pathway_id % 5""",
    "v_pathway_names": """
        SELECT DISTINCT pathway_id, 'pathway_' || CAST(pathway_id AS VARCHAR) AS name
        FROM v_pathways WHERE pathway_id < 5""",
    "v_measured": """
        SELECT gene FROM v_genes WHERE gene % 3 <> 0""",
    "v_fingerprints": """
        SELECT vec_id AS drug_id, label AS moa,
               list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0) AS bits
        FROM embeddings""",
    "v_results": """
        WITH ev AS (
            SELECT CASE WHEN event_id % 2 = 0 THEN 'pearson' ELSE 'spearman' END AS cor_type,
                   user_id AS cell, event_type AS moa, value FROM events)
        SELECT cor_type, cell, moa, median(value) AS r FROM ev GROUP BY ALL
        UNION ALL
        SELECT cor_type, cell, '__inter_moa__', median(value) FROM ev GROUP BY cor_type, cell""",
    "v_depmap": """
        SELECT 'CELL_' || CAST(c_custkey % 700 AS VARCHAR) AS CCLEName,
               CASE WHEN c_custkey % 5 = 0 THEN 'N/A'
                    WHEN c_custkey % 11 = 0 THEN NULL
                    ELSE 'CVCL_' || CAST(c_custkey % 40 AS VARCHAR) END AS RRID,
               c_custkey AS _ord
        FROM customer""",
    "v_trans": """
        SELECT 'CELL_' || CAST(o_custkey % 900 AS VARCHAR) AS ccle_name,
               'ENSG' || CAST(o_orderkey % 50 AS VARCHAR) || '.' || CAST(o_orderkey % 3 AS VARCHAR) AS gene,
               o_custkey % 900 AS _cell_ord, avg(o_totalprice) AS value
        FROM orders GROUP BY ALL""",
    "v_metab": """
        SELECT 'CELL_' || CAST(l_orderkey % 800 AS VARCHAR) AS ccle_name,
               'M' || CAST(l_partkey % 40 AS VARCHAR) AS metabolite,
               l_orderkey % 800 AS _cell_ord, avg(l_extendedprice) AS value
        FROM lineitem GROUP BY ALL""",
    "v_metab_map": """
        SELECT 'M' || CAST(p_partkey % 36 AS VARCHAR) AS Query,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'C' || CAST(p_partkey % 30 AS VARCHAR) END AS KEGG,
               p_partkey AS _ord
        FROM part""",
    "v_gene_map": """
        SELECT 'ENSG' || CAST(p_partkey % 60 AS VARCHAR) AS query,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 'SYM' || CAST(p_partkey % 37 AS VARCHAR) END AS symbol,
               p_partkey AS _ord
        FROM part""",
}

# Dependencies between proxy CTEs (emitted in this order).
_ORDER = ["v_signatures", "v_signatures_long", "v_signatures_null", "v_sig_info",
          "v_available", "v_compounds", "v_cells", "v_genes", "v_pathways",
          "v_pathway_names", "v_measured", "v_fingerprints", "v_results",
          "v_depmap", "v_trans", "v_metab", "v_metab_map", "v_gene_map"]


def with_views(body: str) -> str:
    """Prefix ``body`` with the proxy CTEs it mentions (and their inputs)."""
    needed = set()
    for name in _ORDER:
        if name in body:
            needed.add(name)
    # transitive closure over CTE texts
    changed = True
    while changed:
        changed = False
        for name in _ORDER:
            if name in needed:
                for dep in _ORDER:
                    if dep not in needed and dep in CTES[name]:
                        needed.add(dep)
                        changed = True
    parts = [f"{n} AS ({CTES[n]})" for n in _ORDER if n in needed]
    body = body.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
