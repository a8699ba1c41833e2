"""Queries over the classification tables: full hierarchies (problem 2)."""

from __future__ import annotations

from terrane.operators import hierarchy
from terrane.runtime import ship, table

_NORM = """CASE WHEN regexp_matches(s, '^[A-Z][0-9]{2}[A-Z][0-9]+/[0-9]+$')
  THEN regexp_extract(s, '^([A-Z][0-9]{2}[A-Z])', 1) || CAST(CAST(regexp_extract(s, '^[A-Z][0-9]{2}[A-Z]([0-9]+)/', 1) AS BIGINT) AS VARCHAR) || '/' || regexp_extract(s, '/([0-9]+)$', 1)
  ELSE nullif(s, '') END"""

_ENTRIES = f"""
entries AS (
  SELECT scheme_version, symbol, min({_NORM}) AS parent
  FROM (SELECT scheme_version, symbol, upper(regexp_replace(parent, '[\\s\\p{{Z}}]', '', 'g')) AS s FROM cpc_entry)
  WHERE scheme_version IS NOT NULL AND symbol IS NOT NULL GROUP BY scheme_version, symbol
),
heads AS (
  SELECT *, parent IS NOT NULL AS orphan FROM entries e
  WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM entries p WHERE p.scheme_version = e.scheme_version AND p.symbol = e.parent)
),
walk AS (
  SELECT scheme_version, symbol, orphan, [symbol] AS path FROM heads
  UNION ALL
  SELECT e.scheme_version, e.symbol, w.orphan, list_append(w.path, e.symbol) FROM walk w JOIN entries e ON e.scheme_version = w.scheme_version AND e.parent = w.symbol
)"""


def _on(f):
    def run(spark, sf_dir):
        ship(spark)
        return f(table(spark, sf_dir, "cpc_entry"))

    return run


QUERIES = {
    "p2_found": _on(hierarchy.endless),
    "p2_paths": _on(lambda c: hierarchy.hierarchy(c).selectExpr("scheme_version", "symbol", "status", "array_join(path, '>') AS path", "depth", "root")),
    "p2_descendants": _on(hierarchy.descendants),
    "p2_back_edges": _on(hierarchy.back_edges),
}

ORACLE = {
    "p2_found": f"WITH RECURSIVE {_ENTRIES} SELECT scheme_version, symbol FROM entries EXCEPT SELECT scheme_version, symbol FROM walk",
    "p2_paths": f"""WITH RECURSIVE {_ENTRIES}
      SELECT scheme_version, symbol, CASE WHEN orphan THEN 'orphan' ELSE 'tree' END AS status, array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS depth, path[1] AS root FROM walk
      UNION ALL SELECT scheme_version, symbol, 'cycle', NULL, NULL, NULL FROM (SELECT scheme_version, symbol FROM entries EXCEPT SELECT scheme_version, symbol FROM walk)""",
    "p2_back_edges": f"""WITH RECURSIVE {_ENTRIES},
      lost AS (SELECT scheme_version, symbol, parent FROM entries ANTI JOIN walk USING (scheme_version, symbol)),
      up AS (SELECT scheme_version, symbol, parent AS at FROM lost UNION SELECT u.scheme_version, u.symbol, l.parent FROM up u JOIN lost l ON l.scheme_version = u.scheme_version AND l.symbol = u.at),
      loop AS (SELECT u.scheme_version, u.symbol, min(u.at) AS least FROM up u WHERE EXISTS (SELECT 1 FROM up o WHERE o.scheme_version = u.scheme_version AND o.symbol = u.symbol AND o.at = u.symbol) GROUP BY 1, 2)
      SELECT l.scheme_version, e.parent AS symbol, l.symbol AS back_to FROM loop l JOIN entries e ON e.scheme_version = l.scheme_version AND e.symbol = l.symbol WHERE l.symbol = l.least""",
    "p2_descendants": f"""WITH RECURSIVE {_ENTRIES}
      SELECT scheme_version, path[k] AS symbol, symbol AS descendant, CAST(len(path) - k AS INTEGER) AS distance
      FROM (SELECT *, unnest(range(1, len(path))) AS k FROM walk)""",
}
