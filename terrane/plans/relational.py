"""Filters, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.names import NAME_KEY_SQL, name_key
from terrane.operators.similar import word_prefixes
from terrane.plans.base import COPIES, ENTRIES, ITEMS, LATEST, copies, entries, items, latest
from terrane.plans.registry import Registry
from terrane.runtime import table

query = Registry()

# ---------------------------------------------------------------- filters


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(s, d):
    o = table(s, d, "orders")
    return o.where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query(f"WITH {ITEMS} SELECT id, detail FROM item WHERE contains(detail, 'kind code')")
def filter_contains(s, d):
    return items(s, d).where(F.col("detail").contains("kind code")).select("id", "detail")


@query("SELECT k, count(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS k FROM events) WHERE k IS NOT NULL GROUP BY k")
def json_field_counts(s, d):
    e = table(s, d, "events").select(F.get_json_object("props", "$.k").alias("k"))
    return e.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))


@query(f"""WITH {COPIES} SELECT i.id, p.pub AS served,
  substr(i.k, 1, length(i.k)) AS asked, p.pub = i.k OR regexp_replace(p.pub, '[A-Z][0-9]?$', '') = i.k AS matches
  FROM (SELECT DISTINCT id, raw_record_id, upper(regexp_replace(requested_key, '[^0-9A-Za-z]', '', 'g')) AS k FROM ingest_item WHERE outcome = 'stored') i
  JOIN copies p USING (raw_record_id)""")
def request_match(s, d):
    i = items(s, d).where("outcome = 'stored'").select("id", "raw_record_id", F.regexp_replace(F.upper("requested_key"), "[^0-9A-Z]", "").alias("asked"))
    p = copies(s, d, "raw_record_id").select("raw_record_id", F.col("pub").alias("served"))
    bare = F.regexp_replace("served", "[A-Z][0-9]?$", "")
    return i.join(p, "raw_record_id").select("id", "served", "asked", ((F.col("served") == F.col("asked")) | (bare == F.col("asked"))).alias("matches"))


@query(f"WITH {ENTRIES} SELECT scheme_version, symbol FROM entry WHERE symbol LIKE 'A%' OR symbol LIKE 'G0%'")
def prefix_filter(s, d):
    return entries(s, d).where(F.col("symbol").startswith("A") | F.col("symbol").startswith("G0")).select("scheme_version", "symbol")


@query("""WITH ranked AS (SELECT publication, lower(trim(decision)) AS decision, row_number() OVER (PARTITION BY publication ORDER BY document_id DESC) AS k FROM dataset_document)
SELECT c.publication, c.field_name FROM dataset_conflict c WHERE EXISTS (SELECT 1 FROM ranked r WHERE r.publication = c.publication AND k = 1 AND decision = 'selected')""")
def gate_latest_approved(s, d):
    last = table(s, d, "dataset_document").groupBy("publication").agg(F.max_by(F.lower(F.trim("decision")), "document_id").alias("decision"))
    return table(s, d, "dataset_conflict").join(last.where("decision = 'selected'"), "publication", "left_semi").select("publication", "field_name")


# ---------------------------------------------------------------- joins


@query(f"WITH {COPIES}, {ITEMS} SELECT i.batch_id, p.document_id, p.pub FROM item i JOIN copies p USING (raw_record_id) WHERE i.outcome = 'stored'")
def join_inner(s, d):
    return items(s, d).where("outcome = 'stored'").join(copies(s, d, "raw_record_id"), "raw_record_id").select("batch_id", "document_id", "pub")


@query(f"WITH {COPIES}, {ITEMS} SELECT i.id, p.document_id FROM item i LEFT JOIN copies p USING (raw_record_id)")
def join_left(s, d):
    return items(s, d).join(copies(s, d, "raw_record_id"), "raw_record_id", "left").select("id", "document_id")


@query("""SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0""")
def join_chain(s, d):
    c, n, r = table(s, d, "customer"), table(s, d, "nation"), table(s, d, "region")
    return c.where("c_acctbal > 0").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name")


@query(f"WITH {LATEST} SELECT DISTINCT family_key, publication FROM family_member f WHERE EXISTS (SELECT 1 FROM doc WHERE doc.pub = f.publication)")
def join_semi(s, d):
    f = table(s, d, "family_member").select("family_key", "publication").distinct()
    return f.join(copies(s, d).select(F.col("pub").alias("publication")), "publication", "left_semi")


@query(f"WITH {ITEMS} SELECT DISTINCT requested_key FROM item i WHERE NOT EXISTS (SELECT 1 FROM item j WHERE j.requested_key = i.requested_key AND j.outcome IN ('stored', 'duplicate', 'not_found'))")
def join_anti(s, d):
    i = items(s, d)
    final = i.where(F.col("outcome").isin("stored", "duplicate", "not_found")).select("requested_key")
    return i.select("requested_key").distinct().join(final, "requested_key", "left_anti")


_ALIAS_SQL = f"alias AS (SELECT {NAME_KEY_SQL.format('v')} AS key, min(canonical) AS canonical FROM (SELECT canonical, unnest(list_append(variants, canonical)) AS v FROM alias_group) GROUP BY 1)"


def aliases(s, d):
    """Key of every curated variant with its canonical name: a table kept by hand, of fixed size."""
    a = table(s, d, "alias_group")
    v = a.select("canonical", F.explode(F.array_append("variants", F.col("canonical"))).alias("v"))
    return v.groupBy(name_key(F.col("v")).alias("key")).agg(F.min("canonical").alias("canonical"))


@query(f"WITH {_ALIAS_SQL} SELECT DISTINCT name_id, coalesce(canonical, n.key) AS entity FROM (SELECT name_id, {NAME_KEY_SQL.format('raw')} AS key FROM name_key) n LEFT JOIN alias USING (key)")
def join_broadcast_alias(s, d):
    n = table(s, d, "name_key").select("name_id", name_key(F.col("raw")).alias("key")).distinct()
    # Left to the planner: the curated table is far below the broadcast threshold.
    return n.join(aliases(s, d), "key", "left").select("name_id", F.coalesce("canonical", "key").alias("entity"))


@query("""WITH known AS (SELECT DISTINCT publication, substr(publication, 1, 2) AS c, regexp_extract(publication, '([0-9]+)', 1) AS n FROM family_member),
got AS (SELECT DISTINCT substr(publication, 1, 2) AS c, regexp_extract(publication, '([0-9]+)', 1) AS n FROM dataset_document WHERE lower(trim(decision)) = 'selected')
SELECT k.publication, CASE WHEN g.c IS NOT NULL THEN 'found' ELSE 'not among the retrieved records' END AS result FROM known k LEFT JOIN got g ON k.c = g.c AND k.n = g.n""")
def recall_check(s, d):
    cn = [F.substring("publication", 1, 2).alias("c"), F.regexp_extract("publication", "([0-9]+)", 1).alias("n")]
    known = table(s, d, "family_member").select("publication", *cn).distinct()
    got = table(s, d, "dataset_document").where("lower(trim(decision)) = 'selected'").select(*cn).distinct().withColumn("hit", F.lit(True))
    return known.join(got, ["c", "n"], "left").select("publication", F.when(F.col("hit"), "found").otherwise("not among the retrieved records").alias("result"))


@query(f"""WITH k AS (SELECT DISTINCT {NAME_KEY_SQL.format('raw')} AS key FROM name_key),
s AS (SELECT key AS b, string_split(key, ' ') AS w, unnest(range(1, len(string_split(key, ' ')))) AS n FROM k WHERE key IS NOT NULL)
SELECT k.key AS a, s.b FROM s JOIN k ON k.key = array_to_string(w[1:n], ' ')""")
def name_prefix_pairs(s, d):
    """Keys of name_key whose words are the first words of another key."""
    return word_prefixes(table(s, d, "name_key").select(name_key(F.col("raw")).alias("key")).where("key is not null").distinct())


_EDGES = f"""{LATEST}, edge AS (SELECT DISTINCT pub AS a, m AS b FROM (SELECT pub, unnest(family_members) AS m FROM doc) WHERE m IS NOT NULL AND m <> pub)"""


def edges(s, d):
    e = latest(s, d, "family_members").select(F.col("pub").alias("a"), F.explode("family_members").alias("b"))
    return e.where("b is not null and a <> b").distinct()


@query(f"WITH {_EDGES} SELECT a, b FROM edge e WHERE EXISTS (SELECT 1 FROM doc WHERE doc.pub = e.b AND family_members IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM edge r WHERE r.a = e.b AND r.b = e.a)")
def asymmetric_edges(s, d):
    e = edges(s, d)
    knows = latest(s, d, "family_members").where("family_members is not null").select(F.col("pub").alias("b"))
    return e.join(knows, "b", "left_semi").join(e.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti").select("a", "b")


@query(f"""WITH {LATEST}, cites AS (SELECT DISTINCT doc.pub AS citing, c.publication_number AS cited, publication_date FROM doc, unnest(backward_citations) AS u(c) WHERE c.kind = 'patent')
SELECT citing, cited FROM cites JOIN doc t ON t.pub = cited WHERE cites.publication_date BETWEEN t.publication_date AND t.publication_date + INTERVAL 5 YEAR""")
def windowed_citations(s, d):
    c = latest(s, d, "publication_date", "backward_citations").select(F.col("pub").alias("citing"), F.col("publication_date").alias("at"), F.explode("backward_citations").alias("c"))
    c = c.where("c.kind = 'patent'").select("citing", F.col("c.publication_number").alias("cited"), "at").distinct()
    t = latest(s, d, "publication_date").select(F.col("pub").alias("cited"), F.col("publication_date").alias("since"))
    return c.join(t, "cited").where("at between since and add_months(since, 60)").select("citing", "cited")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer FULL OUTER JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_full(s, d):
    c, o = table(s, d, "customer").select("c_custkey"), table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("m"))
    return c.join(o, "c_custkey", "full").groupBy("c_custkey").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))


@query("SELECT s_suppkey, count(l_orderkey) AS n FROM lineitem RIGHT JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def join_right(s, d):
    li = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("m"))
    return li.join(table(s, d, "supplier").select("s_suppkey"), "s_suppkey", "right").select("s_suppkey", F.coalesce("m", F.lit(0)).alias("n"))


# ---------------------------------------------------------------- aggregates


@query(f"WITH {ITEMS} SELECT count(*) AS n, count(created_at) AS dated, count(DISTINCT batch_id) AS batches FROM item")
def agg_count(s, d):
    return items(s, d).agg(F.count("*").alias("n"), F.count("created_at").alias("dated"), F.countDistinct("batch_id").alias("batches"))


@query(f"""WITH {ITEMS}, last AS (SELECT batch_id, requested_key, arg_max(outcome, (coalesce(created_at, TIMESTAMPTZ '0001-01-01'), id)) AS outcome FROM item GROUP BY 1, 2)
SELECT batch_id, coalesce(outcome, 'missing') AS outcome, count(*) AS n FROM last GROUP BY 1, 2""")
def outcome_counts(s, d):
    return latest_outcome(s, d).groupBy("batch_id", F.coalesce("outcome", F.lit("missing")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {LATEST} SELECT c.publication_number AS cited, count(DISTINCT pub) AS links, min(c.publication_number_raw) AS spelling
FROM doc, unnest(backward_citations) AS u(c) WHERE c.kind = 'patent' AND c.publication_number IS NOT NULL GROUP BY 1""")
def link_counts(s, d):
    c = latest(s, d, "backward_citations").select("pub", F.explode("backward_citations").alias("c")).where("c.kind = 'patent' and c.publication_number is not null")
    return c.groupBy(F.col("c.publication_number").alias("cited")).agg(F.countDistinct("pub").alias("links"), F.min("c.publication_number_raw").alias("spelling"))


@query("""SELECT family_key, count(*) FILTER (WHERE inside) AS in_dataset, count(*) FILTER (WHERE NOT inside) AS outside, string_agg(DISTINCT substr(publication, 1, 2), ',' ORDER BY substr(publication, 1, 2)) AS offices
FROM (SELECT DISTINCT family_key, publication, coalesce(in_dataset, false) AS inside FROM family_member) GROUP BY family_key""")
def family_summary(s, d):
    f = table(s, d, "family_member").select("family_key", "publication", F.coalesce("in_dataset", F.lit(False)).alias("inside")).distinct()
    return f.groupBy("family_key").agg(
        F.count_if("inside").alias("in_dataset"), F.count_if(~F.col("inside")).alias("outside"),
        F.array_join(F.array_sort(F.collect_set(F.substring("publication", 1, 2))), ",").alias("offices"),
    )


@query("SELECT size, count(*) AS families FROM (SELECT family_key, count(DISTINCT publication) AS size FROM family_member GROUP BY 1) GROUP BY 1")
def family_size_hist(s, d):
    return table(s, d, "family_member").groupBy("family_key").agg(F.countDistinct("publication").alias("size")).groupBy("size").agg(F.count("*").alias("families"))


@query(f"WITH {COPIES} SELECT missing['family_members'] AS reason, count(*) AS n FROM copies WHERE family_members IS NULL GROUP BY 1")
def missing_reason_hist(s, d):
    return copies(s, d, "missing", "family_members").where("family_members is null").groupBy(F.col("missing")["family_members"].alias("reason")).agg(F.count("*").alias("n"))


_NAMES_SQL = f"names AS (SELECT DISTINCT name_id, raw, {NAME_KEY_SQL.format('raw')} AS key FROM name_key)"


@query(f"""WITH {_ALIAS_SQL}, {_NAMES_SQL} SELECT coalesce(canonical, key) AS entity, count(DISTINCT raw) AS spellings, string_agg(DISTINCT raw, '|' ORDER BY raw) AS list
FROM names LEFT JOIN alias USING (key) WHERE key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT raw) > 1""")
def name_merges(s, d):
    n = table(s, d, "name_key").select("raw", name_key(F.col("raw")).alias("key")).where("key is not null").distinct()
    n = n.join(aliases(s, d), "key", "left").groupBy(F.coalesce("canonical", "key").alias("entity"))
    return n.agg(F.countDistinct("raw").alias("spellings"), F.array_join(F.array_sort(F.collect_set("raw")), "|").alias("list")).where("spellings > 1")


@query(f"""WITH {_NAMES_SQL}, n AS (SELECT key, trim(raw) AS raw, sum(coalesce(w, 0)) AS k FROM names JOIN (SELECT DISTINCT name_id, n_seen AS w FROM name_key) USING (name_id) GROUP BY 1, 2)
SELECT key, raw AS display FROM n WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC, raw) = 1""")
def mode_tiebreak(s, d):
    n = table(s, d, "name_key").dropDuplicates(["name_id"]).select(name_key(F.col("raw")).alias("key"), F.trim("raw").alias("raw"), F.coalesce("n_seen", F.lit(0)).alias("w"))
    n = n.where("key is not null").groupBy("key", "raw").agg(F.sum("w").alias("k"))
    return n.groupBy("key").agg(F.min_by("raw", F.struct(-F.col("k"), F.col("raw"))).alias("display"))


@query(f"WITH {COPIES}, two AS (SELECT DISTINCT document_id FROM dataset_document) SELECT 'undecided' AS problem, count(*) AS n FROM copies WHERE document_id NOT IN (SELECT document_id FROM two) UNION ALL SELECT 'selected twice', count(*) FROM (SELECT publication FROM dataset_document WHERE lower(trim(decision)) = 'selected' GROUP BY 1 HAVING count(DISTINCT document_id) > 1) UNION ALL SELECT 'in two families', count(*) FROM (SELECT publication FROM family_member GROUP BY 1 HAVING count(DISTINCT family_key) > 1)")
def conservation(s, d):
    dd = table(s, d, "dataset_document")
    undecided = copies(s, d).join(dd, "document_id", "left_anti").agg(F.count("*").alias("n"))
    twice = dd.where("lower(trim(decision)) = 'selected'").groupBy("publication").agg(F.countDistinct("document_id").alias("k")).where("k > 1").agg(F.count("*").alias("n"))
    homes = table(s, d, "family_member").groupBy("publication").agg(F.countDistinct("family_key").alias("k")).where("k > 1").agg(F.count("*").alias("n"))
    parts = [x.select(F.lit(p).alias("problem"), "n") for p, x in (("undecided", undecided), ("selected twice", twice), ("in two families", homes))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH stored AS (SELECT family_key, count(DISTINCT publication) AS n FROM family_member WHERE in_dataset GROUP BY 1), again AS (
  SELECT f.family_key, count(DISTINCT f.publication) AS n FROM family_member f WHERE EXISTS (SELECT 1 FROM dataset_document x WHERE x.publication = f.publication AND lower(trim(x.decision)) = 'selected') GROUP BY 1)
SELECT coalesce(a.family_key, b.family_key) AS family_key, a.n AS stored, b.n AS recomputed FROM stored a FULL OUTER JOIN again b ON a.family_key = b.family_key WHERE a.n IS DISTINCT FROM b.n""")
def family_count_check(s, d):
    f = table(s, d, "family_member")
    sel = table(s, d, "dataset_document").where("lower(trim(decision)) = 'selected'").select("publication")
    a = f.where("in_dataset").groupBy("family_key").agg(F.countDistinct("publication").alias("stored"))
    b = f.join(sel, "publication", "left_semi").groupBy("family_key").agg(F.countDistinct("publication").alias("recomputed"))
    return a.join(b, "family_key", "full").where(~F.col("stored").eqNullSafe(F.col("recomputed")))


@query("SELECT dataset_id, sha256('[\"' || string_agg(document_id, '\",\"' ORDER BY document_id) || '\"]') AS fingerprint FROM (SELECT DISTINCT dataset_id, document_id FROM dataset_document) GROUP BY 1")
def input_fingerprint(s, d):
    # The fingerprint is by definition a hash over the whole sorted list; the list itself is one value per dataset.
    x = table(s, d, "dataset_document").select("dataset_id", "document_id").distinct()
    joined = F.array_join(F.array_sort(F.collect_list("document_id")), '","')
    return x.groupBy("dataset_id").agg(F.sha2(F.concat(F.lit('["'), joined, F.lit('"]')), 256).alias("fingerprint"))


@query(f"WITH {LATEST} SELECT count(DISTINCT pub) AS n FROM doc WHERE len(list_filter(cpc, lambda c: starts_with(c.code, 'A') OR starts_with(c.code, 'G06'))) > 0")
def count_distinct_match(s, d):
    hit = F.exists("cpc", lambda c: c["code"].startswith("A") | c["code"].startswith("G06"))
    return latest(s, d, "cpc").where(hit).agg(F.countDistinct("pub").alias("n"))


@query(f"WITH {ENTRIES} SELECT substr(symbol, 1, 1) AS section, max(scheme_version) AS newest, CAST(max(CAST(replace(scheme_version, '.', '') AS BIGINT)) + 1 AS BIGINT) AS next FROM entry GROUP BY 1")
def next_version(s, d):
    n = F.max(F.replace("scheme_version", F.lit("."), F.lit("")).cast("bigint")) + 1
    return entries(s, d).groupBy(F.substring("symbol", 1, 1).alias("section")).agg(F.max("scheme_version").alias("newest"), n.alias("next"))


@query("SELECT source, section AS heaviest FROM (SELECT source, section, sum(n_chars) AS w FROM documents GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY w DESC NULLS LAST, section DESC) = 1")
def weighted_mode(s, d):
    w = table(s, d, "documents").groupBy("source", "section").agg(F.sum("n_chars").alias("w"))
    return w.groupBy("source").agg(F.max_by("section", F.struct("w", "section")).alias("heaviest"))


@query("SELECT min(len(embedding)) AS least, max(len(embedding)) AS most, count(DISTINCT len(embedding)) = 1 AS agree FROM embeddings")
def agreement_check(s, d):
    n = F.size("embedding")
    return table(s, d, "embeddings").agg(F.min(n).cast("bigint").alias("least"), F.max(n).cast("bigint").alias("most"), (F.countDistinct(n) == 1).alias("agree"))


@query("""SELECT o_orderpriority, CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * CAST(3.25 AS DECIMAL(6,2)) + CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1.5 AS DECIMAL(6,2))) AS DOUBLE) / 1000000 AS cost
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def decimal_cost(s, d):
    dec = lambda c, t="decimal(18,2)": c.cast(t)
    cost = dec(F.col("l_quantity")) * dec(F.lit("3.25"), "decimal(6,2)") + dec(F.col("l_extendedprice")) * dec(F.lit("1.50"), "decimal(6,2)")
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    part = li.groupBy("l_orderkey").agg(F.sum(cost).alias("c"))
    return part.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg((F.sum("c").cast("double") / 1000000).alias("cost"))


@query(f"WITH {ITEMS} SELECT batch_id, requested_key, arg_min(id, (coalesce(created_at, TIMESTAMPTZ '9999-01-01'), id)) AS first_id FROM item GROUP BY 1, 2")
def dedupe_first_seen(s, d):
    order = F.struct(F.col("created_at").isNull(), F.col("created_at"), F.col("id"))
    return items(s, d).groupBy("batch_id", "requested_key").agg(F.min_by("id", order).alias("first_id"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_overall_and_per(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"))


# ---------------------------------------------------------------- windows


@query(f"WITH {LATEST} SELECT pub, document_id FROM doc")
def latest_copy(s, d):
    return latest(s, d).select("pub", "document_id")


@query(f"""WITH {COPIES} SELECT pub, document_id, CASE WHEN k = 1 THEN 'selected' ELSE 'excluded' END AS decision, CASE WHEN k > 1 THEN 'superseded_copy' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY pub ORDER BY retrieved_at DESC NULLS LAST, document_id DESC) AS k FROM copies)""")
def copy_decisions(s, d):
    # Join with the aggregate instead of a window: a publication of very many copies needs no sort in one task.
    kept = latest(s, d).select("pub", F.col("document_id").alias("keep"))
    won = F.col("document_id") == F.col("keep")
    return copies(s, d).join(kept, "pub").select("pub", "document_id", F.when(won, "selected").otherwise("excluded").alias("decision"), F.when(~won, "superseded_copy").alias("reason"))


_CONFLICT_FIELDS = ("title", "abstract", "claims", "language", "filing_date", "grant_date", "publication_date", "family_id_simple")


@query(f"WITH {COPIES}, v AS (" + " UNION ALL ".join(f"SELECT pub, document_id, '{f}' AS field_name, CAST({f} AS VARCHAR) AS value FROM copies" for f in _CONFLICT_FIELDS) + """)
SELECT pub, field_name, count(*) AS n_copies, count(DISTINCT coalesce(value, chr(0))) AS n_values FROM v GROUP BY 1, 2 HAVING count(DISTINCT coalesce(value, chr(0))) > 1""")
def copy_conflicts(s, d):
    c = copies(s, d, *_CONFLICT_FIELDS)
    v = c.select("pub", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.coalesce(F.col(f).cast("string"), F.lit("\0")).alias("value")) for f in _CONFLICT_FIELDS])).alias("v"))
    v = v.select("pub", "v.*").groupBy("pub", "field_name", "value").agg(F.count("*").alias("m"))
    return v.groupBy("pub", "field_name").agg(F.sum("m").alias("n_copies"), F.count("*").alias("n_values")).where("n_values > 1")


@query(f"WITH {LATEST} SELECT pub, office, CAST(publication_date AS VARCHAR) AS publication_date, title FROM doc")
def latest_record(s, d):
    return latest(s, d, "publication_date", "title").select("pub", "office", F.col("publication_date").cast("string").alias("publication_date"), "title")


@query(f"WITH {ITEMS} SELECT batch_id, requested_key, arg_max(outcome, (coalesce(created_at, TIMESTAMPTZ '0001-01-01'), id)) AS outcome FROM item GROUP BY 1, 2")
def latest_outcome(s, d):
    order = F.struct(F.col("created_at").isNotNull(), F.col("created_at"), F.col("id"))
    return items(s, d).groupBy("batch_id", "requested_key").agg(F.max_by("outcome", order).alias("outcome"))


@query(f"WITH {ENTRIES} SELECT symbol, max(scheme_version) AS newest FROM entry GROUP BY 1")
def newest_version(s, d):
    return entries(s, d).groupBy("symbol").agg(F.max("scheme_version").alias("newest"))


@query(f"WITH {LATEST} SELECT pub, CAST(i AS INTEGER) AS ordinal, applicants[i].name_raw AS name FROM (SELECT pub, applicants, unnest(range(1, len(applicants) + 1)) AS i FROM doc)")
def ordinals(s, d):
    return latest(s, d, "applicants").select("pub", F.posexplode("applicants").alias("k", "a")).select("pub", (F.col("k") + 1).alias("ordinal"), F.col("a.name_raw").alias("name"))


@query(f"WITH {ENTRIES} SELECT scheme_version, dot_level, CAST(least(dense_rank() OVER (PARTITION BY scheme_version ORDER BY dot_level) - 1, 2) AS INTEGER) AS heading FROM (SELECT DISTINCT scheme_version, dot_level FROM entry WHERE dot_level IS NOT NULL)")
def dense_rank_capped(s, d):
    lv = entries(s, d).where("dot_level is not null").select("scheme_version", "dot_level").distinct()
    return lv.select("scheme_version", "dot_level", F.least(F.dense_rank().over(W.partitionBy("scheme_version").orderBy("dot_level")) - 1, F.lit(2)).alias("heading"))


# ---------------------------------------------------------------- top-k and sets


@query("SELECT s_nationkey, s_suppkey, CAST(rank_ AS INTEGER) AS rank_ FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank_ FROM supplier) WHERE rank_ <= 3")
def top_per_group(s, d):
    w = W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(s, d, "supplier").withColumn("rank_", F.row_number().over(w)).where("rank_ <= 3").select("s_nationkey", "s_suppkey", "rank_")


@query("""WITH p AS (SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS k, p_size FROM part)
SELECT p_partkey, CASE WHEN p_size > 45 THEN 'not in list' WHEN ok > 5 THEN 'over limit' END AS rejected FROM (SELECT *, sum(CASE WHEN p_size <= 45 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY k) AS ok FROM p)""")
def accept_picks(s, d):
    w = W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    p = table(s, d, "part").withColumn("ok", F.count_if(F.col("p_size") <= 45).over(w))
    return p.select("p_partkey", F.when(F.col("p_size") > 45, "not in list").when(F.col("ok") > 5, "over limit").alias("rejected"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")).distinct()


@query(f"WITH {COPIES} SELECT DISTINCT pub FROM copies EXCEPT SELECT publication FROM dataset_document WHERE lower(trim(decision)) = 'selected'")
def set_except(s, d):
    """Publications of which no copy was selected."""
    return copies(s, d).select("pub").subtract(table(s, d, "dataset_document").where("lower(trim(decision)) = 'selected'").select("publication"))


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_intersect(s, d):
    return table(s, d, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("k")).intersect(table(s, d, "supplier").where("s_acctbal > 0").select("s_suppkey"))


@query(f"WITH {COPIES}, a AS (SELECT DISTINCT pub FROM copies), b AS (SELECT DISTINCT publication AS pub FROM family_member) (SELECT 'retrieved' AS side, pub FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT 'family', pub FROM (SELECT * FROM b EXCEPT SELECT * FROM a))")
def set_symdiff(s, d):
    a, b = copies(s, d).select("pub").distinct(), table(s, d, "family_member").select(F.col("publication").alias("pub")).distinct()
    return a.join(b, "pub", "left_anti").select(F.lit("retrieved").alias("side"), "pub").unionByName(b.join(a, "pub", "left_anti").select(F.lit("family").alias("side"), "pub"))


@query("SELECT count(*) AS only_left, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem))) AS only_right FROM (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)")
def set_equal(s, d):
    a, b = table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct(), table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
    both = a.withColumn("x", F.lit(1)).unionByName(b.withColumn("x", F.lit(-1))).groupBy("k").agg(F.sum("x").alias("x"))
    return both.agg(F.coalesce(F.sum(F.when(F.col("x") > 0, F.col("x"))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.when(F.col("x") < 0, -F.col("x"))), F.lit(0)).alias("only_right"))


_LINKS = f"""{LATEST}, link AS (
  SELECT pub AS document, c.publication_number AS target, 'backward' AS direction FROM doc, unnest(backward_citations) AS u(c) WHERE c.kind = 'patent' AND c.publication_number IS NOT NULL
  UNION ALL SELECT pub, unnest(forward_citations.citing_publication_numbers), 'forward' FROM doc)"""


def links(s, d):
    """Citation links of the latest copies in both directions."""
    doc = latest(s, d, "backward_citations", "forward_citations")
    back = doc.select(F.col("pub").alias("document"), F.explode("backward_citations").alias("c")).where("c.kind = 'patent' and c.publication_number is not null")
    back = back.select("document", F.col("c.publication_number").alias("target"), F.lit("backward").alias("direction"))
    return back.unionByName(doc.select(F.col("pub").alias("document"), F.explode("forward_citations.citing_publication_numbers").alias("target"), F.lit("forward").alias("direction")))


@query(f"WITH {_LINKS} SELECT * FROM link")
def union_all(s, d):
    return links(s, d)


QUERIES, ORACLE = query.queries, query.oracle
