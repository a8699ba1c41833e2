"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import bpe, collapse, consensus, cutoff, forest, lookalike, mixture, nametrie
from terrane.runtime import ship, table


def _on(*names: str, f: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(*[table(spark, sf_dir, n) for n in names])

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _on("patent_document", f=consensus.found),
        "p1_survivors": _on("patent_document", f=consensus.records),
        "p1_majority": _on("patent_document", f=lambda d: consensus.survivors(d, "majority").select("publication_number", "field_name", "document_id", "votes")),
        "p3_found": _on("patent_document", f=lookalike.found),
        "p3_normalized": _on("patent_document", f=lookalike.normalized),
        "p4_found": _on("ingest_item", "patent_document", f=collapse.found),
        "p4_records": _on("ingest_item", "patent_document", f=collapse.records),
        "p5_found": _on("name_key", "alias_group", f=nametrie.found),
        "p5_groups": _on("name_key", "alias_group", "patent_document", f=nametrie.groups),
        "p6_found": _on("patent_document", f=forest.family_groups),
        "p6_keys": _on("patent_document", f=forest.family_keys),
        "p7_ids": _on("documents", f=bpe.encode_corpus),
        "p8_mixture": _on("documents", "mix_target", f=mixture.mixture),
        "p8_shares": _on("documents", "mix_target", f=mixture.shares),
        "p9_found": _on("documents", f=cutoff.found),
        "p9_by_source": _on("documents", f=cutoff.by_source),
    }


# The normal form of a publication, as a select item over patent_document.
PUB = """coalesce(publication.country || publication.number || coalesce(publication.kind, ''),
         upper(regexp_replace(publication_number_raw, '[^0-9A-Za-z]', '', 'g')))"""

P1_VALUES = f"""
docs AS (SELECT DISTINCT {PUB} AS pub, document_id, retrieved_at, title, abstract, to_json(applicants) AS applicants, len(applicants) AS n_app,
                filing_date, grant_date, to_json(legal_status) AS legal_status, legal_status IS NULL AS no_status FROM patent_document),
several AS (SELECT pub FROM docs GROUP BY pub HAVING count(DISTINCT document_id) > 1),
vals AS (
  SELECT pub, document_id, retrieved_at, 'title' AS field_name, title AS value FROM docs WHERE regexp_matches(title, '[^\\s\\p{{Z}}\\p{{Cf}}\\p{{Cc}}]')
  UNION ALL SELECT pub, document_id, retrieved_at, 'abstract', abstract FROM docs WHERE regexp_matches(abstract, '[^\\s\\p{{Z}}\\p{{Cf}}\\p{{Cc}}]')
  UNION ALL SELECT pub, document_id, retrieved_at, 'applicants', applicants FROM docs WHERE n_app > 0
  UNION ALL SELECT pub, document_id, retrieved_at, 'filing_date', CAST(filing_date AS VARCHAR) FROM docs WHERE filing_date IS NOT NULL
  UNION ALL SELECT pub, document_id, retrieved_at, 'grant_date', CAST(grant_date AS VARCHAR) FROM docs WHERE grant_date IS NOT NULL
  UNION ALL SELECT pub, document_id, retrieved_at, 'legal_status', legal_status FROM docs WHERE NOT no_status
)"""

P4_CANON = """
CASE WHEN len(regexp_extract_all(upper(raw), '(?:^|[^\\p{L}\\p{N}])\\p{L}[\\p{L}\\p{N}]*\\s*[=:]')) >= 2 THEN
  array_to_string(list_sort(list_filter(list_transform(
    string_split(regexp_replace(upper(raw), '(^|[^\\p{L}\\p{N}])(\\p{L}[\\p{L}\\p{N}]*)\\s*[=:]', chr(1) || '\\2' || chr(2), 'g'), chr(1)),
    lambda p: regexp_replace(p, '[^\\p{L}\\p{N}\\x02]', '', 'g')), lambda p: p <> '')), chr(1))
ELSE regexp_replace(upper(raw), '[^\\p{L}\\p{N}]', '', 'g') END"""

P4_ROWS = f"""
raws AS (
  SELECT DISTINCT 'ingest_item' AS table_name, id, requested_key AS raw FROM ingest_item WHERE requested_key IS NOT NULL AND id IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'patent_document', document_id, publication_number_raw FROM patent_document WHERE publication_number_raw IS NOT NULL AND document_id IS NOT NULL
), canon AS (SELECT table_name, id, raw, {P4_CANON} AS canonical FROM raws),
keyed AS (SELECT *, min(id) OVER (PARTITION BY table_name, canonical) AS first_key FROM canon WHERE canonical <> '')"""

P6_LINKS = f"""
docs AS (SELECT DISTINCT {PUB} AS pub, source_id, trim(family_id_simple) AS fid, family_members FROM patent_document),
links AS (
  SELECT DISTINCT '0' || pub AS a, '2' || source_id || '|' || fid AS b FROM docs
  WHERE regexp_matches(fid, '[1-9]') AND NOT regexp_matches(fid, '^9{{3,}}$') AND upper(fid) NOT IN ('UNKNOWN', 'N/A', 'NA', 'NONE', 'NULL', 'TBD', '-')
  UNION
  SELECT DISTINCT '0' || pub, CASE WHEN m IN (SELECT pub FROM docs) THEN '0' ELSE '1' END || m
  FROM (SELECT pub, upper(regexp_replace(unnest(family_members), '[^0-9A-Za-z]', '', 'g')) AS m FROM docs) WHERE m <> pub
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS node, a AS seen FROM both_ways
  UNION
  SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.seen = w.a
), keys AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {P1_VALUES} SELECT pub AS publication_number, field_name, arg_max(document_id, (coalesce(retrieved_at, TIMESTAMPTZ '0001-01-01'), document_id)) AS document_id FROM vals SEMI JOIN several USING (pub) GROUP BY pub, field_name",
        "p4_found": f"WITH {P4_ROWS} SELECT table_name, first_key, id AS copy_key FROM keyed WHERE id <> first_key",
        "p4_records": f"WITH {P4_ROWS} SELECT table_name, replace(replace(canonical, chr(1), ';'), chr(2), ' ') AS canonical, count(*) AS n_copies, count(DISTINCT raw) AS n_spellings, first_key FROM keyed GROUP BY table_name, canonical, first_key",
        "p6_found": f"WITH RECURSIVE {P6_LINKS} SELECT substr(root, 2) AS family_key, substr(node, 2) AS publication_number FROM keys WHERE node LIKE '0%' AND node <> root",
        "p6_keys": f"WITH RECURSIVE {P6_LINKS} SELECT DISTINCT coalesce(substr(root, 2), pub) AS family_key, pub AS publication_number FROM docs LEFT JOIN keys ON node = '0' || pub",
    }
