"""Search counts, dataset families, classification queries, citation discovery, ingestion and provenance."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.names import NAME_KEY_SQL, name_key
from terrane.gateway import calls
from terrane.operators import audit, search
from terrane.operators.graph import bfs, connected_components
from terrane.operators.hierarchy import hierarchy
from terrane.operators.similar import similar
from terrane.plans.base import COPIES, ENTRIES, ITEMS, LATEST, copies, entries, items, latest
from terrane.plans.registry import Registry
from terrane.plans.relational import _EDGES, _LINKS, edges, links
from terrane.plans.tree import _ENTRIES as _TREE
from terrane.runtime import Scratch, table
from terrane.sinks import versions
from terrane.sources.titles import parents
from terrane.streaming.events import resume, sessions, windows

query = Registry()

# ---------------------------------------------------------------- three-valued search

# The logical queries of the demonstration landscape: two segments of a drafted taxonomy.
SEARCHES = {
    **search.build_queries("sealing", ("floating seal", "clamping ring"), ("A", "G06N"), "2008-01-01", "2022-12-31", ("US", "EP", "DE", "JP")),
    **{f"m_{k}": v for k, v in search.build_queries("metering", ("viscous fluid", "porous membrane"), ("B", "C13M5/00"), "2010-01-01", "2024-12-31", ("US", "EP", "FR")).items()},
}


def newest_entries(s, d) -> DataFrame:
    """The entries of the newest edition, before anything is built from them."""
    e = table(s, d, "cpc_entry")
    newest = e.agg(F.max("scheme_version").alias("scheme_version"))  # one row
    return e.join(F.broadcast(newest), "scheme_version", "left_semi")


def newest_tree(s, d) -> DataFrame:
    """code and path of every entry of the newest edition that has a root."""
    return hierarchy(newest_entries(s, d)).where("status = 'tree'").select(F.col("symbol").alias("code"), "path")


def scheme_of(s, d, codes: list[str], tree: DataFrame | None = None) -> search.Scheme:
    """What queries need to know of the newest edition; rows come for the codes asked, with their groups if a tree is given."""
    e = newest_entries(s, d).where("symbol is not null")
    version = e.agg(F.max("scheme_version")).first()[0]
    found = e.where(F.col("symbol").isin(*codes)).groupBy("symbol").agg(F.max("kind").alias("kind"), F.max("dot_level").alias("level")).collect()
    levels = {r.symbol: r.level if r.kind in ("main_group", "subgroup") else None for r in found}
    levels |= {r.symbol: 0 for r in found if r.kind == "main_group"}
    groups: dict[str, tuple[str, ...]] = {}
    if tree is not None:
        pos = e.groupBy(F.col("symbol").alias("code")).agg(F.min("pos").alias("pos"))
        below = tree.where("code like '%/%'").select("code", F.explode("path").alias("at")).where(F.col("at").isin(*codes)).join(pos, "code")
        for r in below.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]).alias("codes")).collect():
            groups[r["at"]] = tuple(r["codes"])
    return search.Scheme(version, levels, groups)


def records(s, d) -> DataFrame:
    """Match records: the latest copies with the path of each of their codes in the newest edition, null if it has none."""
    doc = latest(s, d, "title", "abstract", "publication_date", "cpc")
    codes = doc.select("pub", F.explode("cpc.code").alias("code")).where("code is not null").distinct().join(newest_tree(s, d), "code", "left")
    codes = codes.groupBy("pub").agg(F.collect_list(F.struct("code", "path")).alias("codes"))  # the codes of one publication
    return doc.drop("cpc").join(codes, "pub", "left")


_NEWEST = "(SELECT max(scheme_version) FROM cpc_entry)"
_RECORDS = f"""{_TREE}, {LATEST}, tree AS (SELECT symbol AS code, path FROM walk WHERE NOT orphan AND scheme_version = {_NEWEST}),
level AS (SELECT symbol, max(kind) AS kind, max(dot_level) AS dot_level FROM cpc_entry WHERE scheme_version = {_NEWEST} GROUP BY 1),
code AS (SELECT DISTINCT pub, unnest(list_transform(cpc, lambda c: c.code)) AS code FROM doc),
coded AS (SELECT pub, code, path FROM code LEFT JOIN tree USING (code) WHERE code IS NOT NULL),
rec AS (SELECT pub, office, publication_date AS at_, nullif(trim(title), '') AS t, nullif(trim(abstract), '') AS a FROM doc)"""


def _group_sql(code: str) -> str:
    return f"TRY_CAST(regexp_extract({code}, '^.{{4}}([0-9]+)/', 1) AS INTEGER)"


def _within_sql(symbol: str, code: str = "code", path: str = "path") -> str:
    """``within`` in SQL; the level of the symbol is looked up in ``level``. ``symbol`` is an SQL expression."""
    same = f"abs({_group_sql(code)} - {_group_sql(symbol)})"
    return f"""CASE WHEN {path} IS NOT NULL THEN list_contains({path}, {symbol})
      WHEN (SELECT bool_or(l.kind NOT IN ('main_group', 'subgroup')) FROM level l WHERE l.symbol = {symbol}) THEN starts_with({code}, {symbol})
      WHEN left({code}, 4) <> left({symbol}, 4) THEN false
      WHEN {same} = 0 AND (SELECT bool_or(l.kind = 'main_group' OR l.dot_level = 0) FROM level l WHERE l.symbol = {symbol}) THEN true
      WHEN {same} IS NULL OR {same} IN (0, {search.INDEXING}) THEN NULL ELSE false END"""


def _verdict_sql(q: search.LogicalQuery) -> str:
    date = f"at_ BETWEEN DATE '{q.date_from}' AND DATE '{q.date_to}'"
    pattern = search.boundary_pattern(q.phrases) if q.phrases else ""
    text = f"(regexp_matches(lower(t), '{pattern}') OR regexp_matches(lower(a), '{pattern}'))" if q.phrases else "true"
    asked = ", ".join(f"('{c}')" for c in q.cpc or ())
    per_code = f"(SELECT pub, {_within_sql('symbol')} AS w FROM coded, (VALUES {asked}) AS v(symbol))" if q.cpc else "(SELECT pub, true AS w FROM coded)"
    code = "CASE WHEN yes THEN true WHEN yes IS NULL OR open THEN NULL ELSE false END" if q.cpc else "true"
    offices = f"coalesce(office IN ({', '.join(repr(o) for o in q.offices)}), false)" if q.offices else "true"
    return f"""SELECT pub, '{q.name}' AS query, coalesce(d AND x AND c AND inside, false) AS matched,
      CASE WHEN inside AND d IS DISTINCT FROM false AND x IS DISTINCT FROM false AND c IS DISTINCT FROM false AND (d AND x AND c) IS NULL THEN
        concat_ws('; ', CASE WHEN d IS NULL THEN 'no publication date' END,
          CASE WHEN x IS NULL THEN CASE WHEN t IS NULL AND a IS NULL THEN 'no title or abstract' WHEN t IS NULL THEN 'no title' ELSE 'no abstract' END END,
          CASE WHEN c IS NULL THEN CASE WHEN yes IS NULL THEN 'no CPC codes' ELSE 'CPC codes not in ' || {_NEWEST} END END) END AS undecidable
      FROM (SELECT *, {date} AS d, {text} AS x, {code} AS c, {offices} AS inside
            FROM rec LEFT JOIN (SELECT pub, coalesce(bool_or(w), false) AS yes, bool_or(w IS NULL) AS open FROM {per_code} GROUP BY pub) USING (pub))"""


def _searched(s, d, keys: list[str]) -> DataFrame:
    """One scan: a struct per query in an array, exploded."""
    rec, scheme = records(s, d), scheme_of(s, d, sorted({c for k in keys for c in SEARCHES[k].cpc or ()}))
    col = {c: F.col(c) for c in ("office", "publication_date", "title", "abstract", "codes")}
    out = []
    for k in keys:
        hit, why = search.evaluate(SEARCHES[k], col["office"], col["publication_date"], col["title"], col["abstract"], col["codes"], scheme)
        out.append(F.struct(F.lit(SEARCHES[k].name).alias("query"), hit.alias("matched"), why.alias("undecidable")))
    return rec.select("pub", F.explode(F.array(*out)).alias("v")).select("pub", "v.*")


def _all(keys: list[str]) -> str:
    return " UNION ALL ".join(_verdict_sql(SEARCHES[k]) for k in keys)


@query(f"WITH RECURSIVE {_RECORDS} {_verdict_sql(SEARCHES['combined'])}")
def search_combined(s, d):
    return _searched(s, d, ["combined"])


@query(f"WITH RECURSIVE {_RECORDS} {_verdict_sql(SEARCHES['keywords'])}")
def search_keywords(s, d):
    return _searched(s, d, ["keywords"])


@query(f"WITH RECURSIVE {_RECORDS} {_verdict_sql(SEARCHES['cpc'])}")
def search_cpc(s, d):
    return _searched(s, d, ["cpc"])


@query(f"WITH {LATEST} SELECT pub, publication_date BETWEEN DATE '2008-01-01' AND DATE '2022-12-31' AS inside FROM doc")
def search_date(s, d):
    return latest(s, d, "publication_date").select("pub", search.date_verdict(SEARCHES["combined"], F.col("publication_date")).alias("inside"))


@query(f"WITH RECURSIVE {_RECORDS} SELECT query, matched, undecidable, count(*) AS n FROM ({_all(list(SEARCHES))}) GROUP BY ALL")
def search_matrix(s, d):
    return _searched(s, d, list(SEARCHES)).groupBy("query", "matched", "undecidable").agg(F.count("*").alias("n"))


_COUNTS = f"SELECT query, count(*) FILTER (WHERE matched) AS n, count(undecidable) AS n_undecidable, count(undecidable) > 0 AS lower_bound FROM ({_all(list(SEARCHES))}) GROUP BY query"


@query(f"WITH RECURSIVE {_RECORDS} {_COUNTS}")
def query_counts(s, d):
    n = F.count("undecidable")
    return _searched(s, d, list(SEARCHES)).groupBy("query").agg(F.count_if("matched").alias("n"), n.alias("n_undecidable"), (n > 0).alias("lower_bound"))


@query()
def query_renderings(s, d):
    """Every generated query in the foreign query languages and as canonical JSON."""
    asked = sorted({c for q in SEARCHES.values() for c in q.cpc or ()})
    scheme = scheme_of(s, d, asked, newest_tree(s, d))
    known = lambda q: replace(q, cpc=tuple(c for c in q.cpc if c in scheme.levels) or None) if q.cpc else q
    rows = [(q.name, search.canonical(q), search.to_cql(q), search.to_json_body(known(q), scheme), search.to_sql(known(q), scheme)) for q in SEARCHES.values()]
    return s.createDataFrame(rows, "query string, canonical string, cql string, json_body string, sql string")


@query(f"""WITH {ITEMS}, asked AS (SELECT unnest(['no such batch', NULL]) AS batch_id UNION ALL SELECT DISTINCT batch_id FROM item),
state AS (SELECT batch_id, count(*) FILTER (WHERE outcome IS NULL) AS left_, count(*) FILTER (WHERE outcome = 'stored') AS stored FROM item GROUP BY 1)
SELECT a.batch_id, CASE WHEN s.batch_id IS NULL THEN 'unknown' WHEN left_ > 0 THEN 'unfinished' WHEN stored = 0 THEN 'empty' END AS problem FROM asked a LEFT JOIN state s USING (batch_id) WHERE a.batch_id IS NOT NULL""")
def universe_guard(s, d):
    """Why a batch can't be searched in: it doesn't exist, has items without an outcome, or stored nothing."""
    i = items(s, d)
    state = i.groupBy("batch_id").agg(F.count_if(F.col("outcome").isNull()).alias("left"), F.count_if(F.col("outcome") == "stored").alias("stored"))
    asked = i.select("batch_id").distinct().unionByName(s.createDataFrame([("no such batch",)], "batch_id string"))
    got = asked.join(state, "batch_id", "left").where("batch_id is not null")
    problem = F.when(F.col("left").isNull(), "unknown").when(F.col("left") > 0, "unfinished").when(F.col("stored") == 0, "empty")
    return got.select("batch_id", problem.alias("problem"))


# ---------------------------------------------------------------- families of the dataset

_FAM_EDGES = f"""{LATEST}, fe AS (
  SELECT pub AS a, m AS b FROM (SELECT pub, unnest(family_members) AS m FROM doc) WHERE m IS NOT NULL AND m <> pub
  UNION SELECT pub, '#f:' || source_id || ':' || family_id_simple FROM doc WHERE regexp_matches(family_id_simple, '[1-9]')
  UNION SELECT pub, '#a:' || office || '|' || upper(regexp_replace(application_number_raw, '[^0-9A-Za-z]', '', 'g')) FROM doc WHERE application_number_raw IS NOT NULL),
both_ways AS (SELECT a, b FROM fe UNION SELECT b, a FROM fe),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.seen = w.a),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""


def family_edges(s, d) -> DataFrame:
    """Evidence edges of the latest copies: stated members, family ids per source, application numbers."""
    doc = latest(s, d, "source_id", "family_members", "family_id_simple", "application_number_raw")
    stated = doc.select(F.col("pub").alias("a"), F.explode("family_members").alias("b")).where("b is not null and a <> b")
    fid = doc.where(F.col("family_id_simple").rlike("[1-9]")).select(F.col("pub").alias("a"), F.concat(F.lit("#f:"), "source_id", F.lit(":"), "family_id_simple").alias("b"))
    app = F.concat(F.lit("#a:"), "office", F.lit("|"), F.upper(F.regexp_replace("application_number_raw", "[^0-9A-Za-z]", "")))
    return stated.unionByName(fid).unionByName(doc.where("application_number_raw is not null").select(F.col("pub").alias("a"), app.alias("b"))).distinct()


def components(s, d) -> DataFrame:
    return connected_components(family_edges(s, d))


@query(f"WITH RECURSIVE {_FAM_EDGES} SELECT node, component FROM comp")
def families(s, d):
    return components(s, d)


@query(f"""WITH RECURSIVE {_FAM_EDGES}, key AS (SELECT component, min(node) AS family_key FROM comp WHERE node IN (SELECT pub FROM doc) GROUP BY 1)
SELECT family_key, node AS publication, node IN (SELECT pub FROM doc) AS in_dataset FROM comp JOIN key USING (component) WHERE node NOT LIKE '#%'""")
def family_members(s, d):
    c = Scratch(s, "members").save(components(s, d).where("node not like '#%'"))
    known = latest(s, d).select(F.col("pub").alias("node"), F.lit(True).alias("known"))
    c = c.join(known, "node", "left")
    key = c.where("known").groupBy("component").agg(F.min("node").alias("family_key"))
    return c.join(key, "component").select("family_key", F.col("node").alias("publication"), F.coalesce("known", F.lit(False)).alias("in_dataset"))


@query(f"""WITH RECURSIVE {_FAM_EDGES}, att AS (SELECT b, count(DISTINCT a) AS n FROM fe WHERE b LIKE '#%' GROUP BY 1)
SELECT DISTINCT component, CASE WHEN b LIKE '#f:%' THEN 'family_id' WHEN b LIKE '#a:%' THEN 'application' ELSE 'stated_member' END AS evidence
FROM fe JOIN comp ON fe.b = comp.node LEFT JOIN att USING (b) WHERE fe.b NOT LIKE '#%' OR att.n > 1""")
def family_evidence(s, d):
    e = Scratch(s, "evidence").save(family_edges(s, d))
    told = e.groupBy("b").agg(F.count("*").alias("n")).where("b not like '#%' or n > 1")
    kind = F.when(F.col("b").startswith("#f:"), "family_id").when(F.col("b").startswith("#a:"), "application").otherwise("stated_member")
    return told.join(connected_components(e), F.col("b") == F.col("node")).select("component", kind.alias("evidence")).distinct()


# ---------------------------------------------------------------- classification

@query(f"""WITH {ENTRIES}, g AS (SELECT scheme_version, left(symbol, 4) AS sub, pos, symbol, dot_level, {_group_sql('symbol')} AS grp FROM entry WHERE kind IN ('main_group', 'subgroup') AND dot_level >= 0),
near AS (SELECT g.*, (SELECT arg_max(struct_pack(symbol := p.symbol, lev := p.dot_level, grp := p.grp), (p.pos, p.symbol)) FROM g p
  WHERE p.scheme_version = g.scheme_version AND p.sub = g.sub AND (p.pos, p.symbol) < (g.pos, g.symbol) AND p.dot_level < g.dot_level) AS b FROM g)
SELECT scheme_version, symbol, CASE WHEN b.lev = dot_level - 1 AND grp - b.grp IN (0, {search.INDEXING}) THEN b.symbol END AS parent FROM near""")
def asof_parent(s, d):
    return parents(entries(s, d))


_TITLED = f"{_TREE}, titled AS (SELECT scheme_version, symbol, min(trim(regexp_replace(title, '[{{{{}}}}]', '', 'g'))) AS title, min(kind) AS kind FROM cpc_entry GROUP BY 1, 2)".replace("{{", "{").replace("}}", "}")


@query(f"""WITH RECURSIVE {_TITLED}, step AS (SELECT scheme_version, symbol, unnest(path) AS at, unnest(range(1, len(path) + 1)) AS k FROM walk WHERE NOT orphan)
SELECT s.scheme_version, s.symbol, coalesce(string_agg(t.title, ' > ' ORDER BY k) FILTER (WHERE t.kind IN ('main_group', 'subgroup')), '') AS title_path FROM step s JOIN titled t ON t.scheme_version = s.scheme_version AND t.symbol = s.at GROUP BY 1, 2""")
def title_paths(s, d):
    tree = hierarchy(table(s, d, "cpc_entry")).where("status = 'tree'")
    titled = entries(s, d).select("scheme_version", F.col("symbol").alias("at"), F.trim(F.regexp_replace("title", "[{}]", "")).alias("title"), "kind")
    step = tree.select("scheme_version", "symbol", F.posexplode("path").alias("k", "at")).join(titled, ["scheme_version", "at"])
    own = F.when(F.col("kind").isin("main_group", "subgroup") & F.col("title").isNotNull(), F.struct("k", "title"))
    joined = step.groupBy("scheme_version", "symbol").agg(F.array_sort(F.collect_list(own)).alias("t"))  # as long as the path is deep
    return joined.select("scheme_version", "symbol", F.array_join(F.transform("t", lambda x: x["title"]), " > ").alias("title_path"))


@query(f"WITH RECURSIVE {_TREE} SELECT w.scheme_version, e.symbol AS ancestor, count(*) AS n_below FROM (SELECT scheme_version, symbol, unnest(path) AS symbol2 FROM walk) w JOIN entries e ON e.scheme_version = w.scheme_version AND e.symbol = w.symbol2 WHERE w.symbol <> e.symbol GROUP BY 1, 2")
def descendants(s, d):
    tree = hierarchy(table(s, d, "cpc_entry")).where("path is not null")
    pairs = tree.select("scheme_version", F.explode("path").alias("ancestor"), "symbol").where("ancestor <> symbol")
    return pairs.groupBy("scheme_version", "ancestor").agg(F.count("*").alias("n_below"))


_ASKED = ("A", "G06N", "B12C3/00", "A36D5/00", "A36D5/10")


@query(f"WITH RECURSIVE {_RECORDS}, target AS (SELECT unnest({list(_ASKED)}) AS symbol) SELECT code, symbol, {_within_sql('symbol')} AS within FROM (SELECT DISTINCT code, path FROM coded), target")
def is_within(s, d):
    levels = scheme_of(s, d, list(_ASKED)).levels
    code = latest(s, d, "cpc").select(F.explode("cpc.code").alias("code")).where("code is not null").distinct().join(newest_tree(s, d), "code", "left")
    told = [F.struct(F.lit(a).alias("symbol"), search.within(F.col("code"), F.col("path"), a, levels).alias("within")) for a in _ASKED]
    return code.select("code", F.explode(F.array(*told)).alias("w")).select("code", "w.*")


@query(f"WITH RECURSIVE {_TREE}, pick AS (SELECT scheme_version, symbol, path FROM walk WHERE NOT orphan AND contains(symbol, '/')) SELECT DISTINCT scheme_version, a AS queried, symbol FROM (SELECT scheme_version, symbol, unnest(path) AS a FROM pick) WHERE a IN ('A36D5/00', 'A03D', 'A16F11/00')")
def expand_codes(s, d):
    tree = hierarchy(table(s, d, "cpc_entry")).where("status = 'tree' and symbol like '%/%'")
    return tree.select("scheme_version", F.explode("path").alias("queried"), "symbol").where(F.col("queried").isin("A36D5/00", "A03D", "A16F11/00")).distinct()


@query(f"WITH RECURSIVE {_TREE}, {LATEST}, code AS (SELECT DISTINCT pub, unnest(list_transform(cpc, lambda c: c.code)) AS code FROM doc), tree AS (SELECT symbol AS code, unnest(path) AS node FROM walk WHERE NOT orphan AND scheme_version = (SELECT max(scheme_version) FROM cpc_entry)) SELECT node, count(DISTINCT pub) AS publications FROM code JOIN tree USING (code) GROUP BY 1")
def subtree_rollup(s, d):
    tree = newest_tree(s, d).select("code", F.explode("path").alias("node"))
    code = latest(s, d, "cpc").select("pub", F.explode("cpc.code").alias("code")).distinct()
    return code.join(tree, "code").select("node", "pub").distinct().groupBy("node").agg(F.count("*").alias("publications"))


@query(f"WITH {ENTRIES} SELECT 'repeated symbol' AS problem, count(*) AS n FROM (SELECT scheme_version, symbol FROM entry GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'missing parent', count(*) FROM entry e WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM entry p WHERE p.scheme_version = e.scheme_version AND p.symbol = e.parent)")
def hierarchy_integrity(s, d):
    e = table(s, d, "cpc_entry").distinct()
    twice = e.groupBy("scheme_version", "symbol").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated symbol").alias("problem"), "n")
    gone = e.where("parent is not null").join(e.select("scheme_version", F.col("symbol").alias("parent")), ["scheme_version", "parent"], "left_anti")
    return twice.unionByName(gone.agg(F.count("*").alias("n")).select(F.lit("missing parent").alias("problem"), "n"))


_SCORE = "(CASE WHEN regexp_matches(' ' || w || ' ', ' viscous fluids? ') THEN 2 ELSE 0 END) + (CASE WHEN regexp_matches(' ' || w || ' ', ' membranes? ') THEN 1 ELSE 0 END)"


@query(f"WITH {ENTRIES}, t AS (SELECT scheme_version, symbol, array_to_string(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+'), ' ') AS w FROM entry WHERE kind IN ('main_group', 'subgroup')) SELECT scheme_version, symbol, CAST(score AS INTEGER) AS score FROM (SELECT *, {_SCORE} AS score FROM t) WHERE score > 0 ORDER BY score DESC, symbol, scheme_version LIMIT 20")
def title_search(s, d):
    w = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "), F.lit(" "))
    score = F.when(w.rlike(" viscous fluids? "), 2).otherwise(0) + F.when(w.rlike(" membranes? "), 1).otherwise(0)
    e = entries(s, d).where("kind in ('main_group', 'subgroup')").select("scheme_version", "symbol", score.alias("score"))
    return e.where("score > 0").orderBy(F.desc("score"), "symbol", "scheme_version").limit(20)


@query(f"SELECT key, count(DISTINCT group_id) AS groups, count(DISTINCT group_id) > 1 AS conflict FROM (SELECT group_id, {NAME_KEY_SQL.format('raw')} AS key FROM (SELECT group_id, unnest(list_append(variants, canonical)) AS raw FROM alias_group)) WHERE key IS NOT NULL GROUP BY 1")
def alias_conflicts(s, d):
    """Name keys of the curated groups, and whether one of them stands in two groups."""
    v = table(s, d, "alias_group").select("group_id", F.explode(F.array_append("variants", F.col("canonical"))).alias("raw"))
    n = F.countDistinct("group_id")
    return v.select("group_id", name_key(F.col("raw")).alias("key")).where("key is not null").groupBy("key").agg(n.alias("groups"), (n > 1).alias("conflict"))


@query()
def similar_pairs(s, d):
    """All pairs of name keys that look alike: the words of one begin the other, or the ratio is 0.88 or more."""
    return similar(table(s, d, "name_key").select(name_key(F.col("raw")).alias("key")))


# ---------------------------------------------------------------- discovery


@query(f"""WITH {_LINKS}, seed AS (SELECT pub AS node FROM doc WHERE office = 'SE'), cand AS (SELECT target, count(DISTINCT document) AS n FROM link WHERE document IN (SELECT node FROM seed) GROUP BY 1),
r AS (SELECT *, CASE WHEN target IN (SELECT node FROM seed) THEN 'already_requested' WHEN left(target, 2) NOT IN ('US', 'EP') THEN 'out_of_scope' END AS why FROM cand),
k AS (SELECT *, row_number() OVER (PARTITION BY why ORDER BY n DESC, target) AS k FROM r)
SELECT target, n AS n_links, coalesce(why, CASE WHEN k <= 25 THEN 'requested' ELSE 'over_cap' END) AS decision FROM k""")
def choose_candidates(s, d):
    li = Scratch(s, "choose").save(links(s, d))
    seed = latest(s, d).where("office = 'SE'").select(F.col("pub").alias("document"))
    cand = li.join(seed, "document", "left_semi").groupBy("target").agg(F.countDistinct("document").alias("n_links"))
    cand = cand.join(seed.select(F.col("document").alias("target"), F.lit(True).alias("known")), "target", "left")
    why = F.when(F.col("known"), "already_requested").when(~F.substring("target", 1, 2).isin("US", "EP"), "out_of_scope")
    cand = cand.select("target", "n_links", why.alias("why"))
    top = cand.where("why is null").orderBy(F.desc("n_links"), "target").limit(25).select("target", F.lit("requested").alias("got"))
    return cand.join(top, "target", "left").select("target", "n_links", F.coalesce("why", "got", F.lit("over_cap")).alias("decision"))


CAP = 40


def _bfs(s, d):
    li = Scratch(s, "links").save(links(s, d))
    seed = latest(s, d).where("office = 'SE'").select(F.col("pub").alias("node"))
    allowed = li.select("target").where(F.substring("target", 1, 2).isin("US", "EP", "DE"))
    return bfs(seed, li, allowed, hops=2, cap=CAP)


def _hop_sql(n: int, frontier: str, seen: str) -> str:
    return f"""c{n} AS (SELECT target, count(DISTINCT document) AS k FROM link WHERE document IN (SELECT node FROM {frontier}) GROUP BY 1),
r{n} AS (SELECT target, k, CASE WHEN target IN (SELECT node FROM {seen}) THEN 'already_requested' WHEN left(target, 2) NOT IN ('US', 'EP', 'DE') THEN 'out_of_scope' ELSE 'eligible' END AS reason FROM c{n}),
d{n} AS (SELECT target, CASE WHEN reason = 'eligible' THEN CASE WHEN row_number() OVER (PARTITION BY reason ORDER BY k DESC, target) <= {CAP} THEN 'requested' ELSE 'over_cap' END ELSE reason END AS reason FROM r{n}),
h{n} AS (SELECT target AS node FROM d{n} WHERE reason = 'requested')"""


_HOPS = f"""{_LINKS}, h0 AS (SELECT pub AS node FROM doc WHERE office = 'SE'), {_hop_sql(1, 'h0', 'h0')}, s1 AS (SELECT node FROM h0 UNION SELECT node FROM h1), {_hop_sql(2, 'h1', 's1')}"""


@query(f"WITH {_HOPS} SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2")
def bfs_hops(s, d):
    return _bfs(s, d)[0]


@query(f"WITH {_HOPS} SELECT 1 AS hop, reason, count(*) AS n FROM d1 GROUP BY 2 UNION ALL SELECT 2, reason, count(*) FROM d2 GROUP BY 2")
def exclusion_counts(s, d):
    return _bfs(s, d)[1]


# ---------------------------------------------------------------- ingestion and provenance


@query(f"""WITH {ITEMS} SELECT batch_id, count(*) AS items, count(DISTINCT requested_key) AS keys, CAST(coalesce(sum(document_count), 0) AS BIGINT) AS documents, count(*) FILTER (WHERE (raw_record_id IS NOT NULL) <> (outcome IN ('stored', 'quarantined', 'duplicate'))) AS raw_problems FROM item GROUP BY 1""")
def reconcile(s, d):
    fetched = F.col("outcome").isin("stored", "quarantined", "duplicate")
    return items(s, d).groupBy("batch_id").agg(
        F.count("*").alias("items"), F.countDistinct("requested_key").alias("keys"), F.coalesce(F.sum("document_count"), F.lit(0)).alias("documents"),
        F.count_if(F.col("raw_record_id").isNotNull() != fetched).alias("raw_problems"),
    )


_CHAIN = """ev AS (SELECT 'user_' || user_id AS run_id, event_id AS seq, event_type || ':' || event_id AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
ch AS (SELECT run_id, seq, payload, k, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || payload) AS hash FROM ev WHERE k = 1
  UNION ALL SELECT e.run_id, e.seq, e.payload, e.k, c.hash, sha256(c.hash || '|' || e.payload) FROM ch c JOIN ev e ON e.run_id = c.run_id AND e.k = c.k + 1)"""


def _events(s, d) -> DataFrame:
    return table(s, d, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("seq"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("payload")
    )


@query(f"WITH RECURSIVE {_CHAIN} SELECT run_id, seq, payload, prev_hash, hash FROM ch")
def audit_chain(s, d):
    """Every event of every user in a chain of hashes. A user's chain is one after another by definition."""
    return audit.chain(_events(s, d))


@query(f"""WITH RECURSIVE {_CHAIN}, t AS (SELECT run_id, seq, substr(run_id, -1) AS e, k FROM ch)
SELECT run_id, count(*) AS events, min(CASE WHEN e = '7' AND k > 2 OR e = '8' AND k = 4 THEN seq END) AS first_bad, CASE WHEN max(k) > 2 AND max(e) = '7' THEN 'content' WHEN max(k) > 3 AND max(e) = '8' THEN 'link' END AS reason FROM t GROUP BY 1""")
def chain_verify(s, d):
    return _tampered(_events(s, d))


def _tampered(events: DataFrame) -> DataFrame:
    """Verification of chains in which runs ending in 7 have other contents from their third event on, and those ending in 8
    lack their third event's link."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("run_id").orderBy("seq"))
    c = audit.chain(events).withColumn("k", k)
    changed = F.col("run_id").endswith("7") & (F.col("k") > 2)
    unlinked = F.col("run_id").endswith("8") & (F.col("k") == 4)
    c = c.withColumn("payload", F.when(changed, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return audit.verify(c.withColumn("prev_hash", F.when(unlinked, F.lit("0" * 63 + "1")).otherwise(F.col("prev_hash"))).drop("k"))


@query("""WITH a AS (SELECT source_id AS dim, count(DISTINCT document_id) AS value FROM patent_document GROUP BY 1), b AS (SELECT source_id AS dim, count(*) AS other FROM patent_document GROUP BY 1)
SELECT dim, value, other, value = other AS agree FROM a JOIN b USING (dim)""")
def fact_agreement(s, d):
    """A fact computed twice in unlike ways, documents by id and by row: where they differ both values stay as evidence."""
    docs = table(s, d, "patent_document")
    one = docs.groupBy(F.col("source_id").alias("dim")).agg(F.countDistinct("document_id").alias("value"))
    two = s.sql("SELECT source_id AS dim, count(*) AS other FROM {docs} GROUP BY source_id", docs=docs)
    return one.join(two, "dim").select("dim", "value", "other", F.col("value").eqNullSafe(F.col("other")).alias("agree"))


_VERSIONED = f"{ENTRIES}, v AS (SELECT symbol AS name, CAST(replace(scheme_version, '.', '') AS INTEGER) AS version, min(coalesce(title, '')) AS content, min(kind) AS kind FROM entry GROUP BY 1, 2)"


def _versions(s, d) -> DataFrame:
    """Every title as a version of its symbol, numbered by edition."""
    v = entries(s, d).select(F.col("symbol").alias("name"), F.replace("scheme_version", F.lit("."), F.lit("")).cast("int").alias("version"), F.coalesce("title", F.lit("")).alias("content"), "kind")
    parent = F.lit(None).cast("int")
    return v.select("name", "version", parent.alias("parent"), "content", F.sha2("content", 256).alias("sha256"), F.lit("office").alias("author"), "kind")


@query(f"WITH {_VERSIONED} SELECT name, max(version) AS version, arg_max(content, version) AS content FROM v GROUP BY 1")
def vst_newest(s, d):
    """The newest version of every entry."""
    return versions.newest(_versions(s, d)).select("name", "version", "content")


@query(f"WITH {_VERSIONED} SELECT name, max(version) AS version, arg_max(content, version) AS content FROM v WHERE kind IN ('main_group', 'subgroup') AND version % 2 = 0 GROUP BY 1")
def vst_approved(s, d):
    """The newest approved version of every entry: groups are approved, those of odd editions rejected again."""
    v = _versions(s, d)
    groups = v.where("kind in ('main_group', 'subgroup')").select("name", "version")
    decisions = groups.select("name", "version", F.lit("approved").alias("decision"), F.lit(1).alias("at"))
    decisions = decisions.unionByName(groups.where("version % 2 = 1").select("name", "version", F.lit("rejected").alias("decision"), F.lit(2).alias("at")))
    return versions.approved(v, decisions).select("name", "version", "content")


@query(f"WITH {_VERSIONED} SELECT name, version FROM v WHERE version % 7 = 0")
def vst_broken(s, d):
    """Versions that no longer have their hash, after some were changed."""
    changed = _versions(s, d).withColumn("content", F.when(F.col("version") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return versions.broken(changed).select("name", "version")


@query(f"WITH {LATEST} SELECT DISTINCT title AS prompt, upper(title) AS answer FROM doc WHERE title IS NOT NULL AND regexp_matches(title, '^[ -~]*$')")
def gateway_answers(s, d):
    """Every title put to a model once, half of the answers being cached; the model here writes capitals."""
    rows = latest(s, d, "title").where(F.col("title").rlike("^[ -~]*$")).select(F.col("title").alias("prompt"))
    model, scratch = calls.Model("stub", "none", "capitals"), Scratch(s, "answers")
    empty = s.createDataFrame([], "key string, answer string")
    half = scratch.save(calls.complete(rows.where(F.pmod(F.xxhash64("prompt"), F.lit(2)) == 0), model, lambda: str.upper, empty)[1])
    asked, new = calls.complete(rows, model, lambda: str.upper, half)
    return calls.answered(asked, half.unionByName(scratch.save(new))).select("prompt", "answer")


@query()
def token_bucket(s, d):
    """Start times under a limit of 20 requests a minute, per source of requests (a stateful scan of each)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, last, out = 20.0, None, []
        for r in pdf.sort_values(["at", "event_id"]).itertuples(index=False):
            at = r.at if last is None or r.at >= last else last
            tokens = 20.0 if last is None else min(20.0, tokens + (at - last) * 20 / 60)
            if tokens < 1:
                at += (1 - tokens) * 3
                tokens = 1.0
            tokens, last = tokens - 1, at
            out.append((r.user_id, r.event_id, at - r.at))
        return pd.DataFrame(out, columns=["user_id", "event_id", "waited"])

    e = table(s, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"))
    e = e.select("user_id", "event_id", (F.col("us") / 1e6).alias("at"))
    return e.groupBy("user_id").applyInPandas(run, "user_id bigint, event_id bigint, waited double")


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows(e).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("""WITH e AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) AS b FROM events), w AS (SELECT event_type, unnest([b, b - INTERVAL 30 MINUTE]) AS start FROM e)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def event_sliding(s, d):
    """Counts of windows of an hour that begin every half hour."""
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    n = e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return n.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(s, d):
    """Sessions of each user, events less than half an hour apart."""
    got = sessions(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return got.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(f"WITH {ITEMS} SELECT DISTINCT batch_id, requested_key FROM item i WHERE requested_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM item j WHERE j.batch_id = i.batch_id AND j.requested_key = i.requested_key AND j.outcome IN ('stored', 'duplicate', 'not_found'))")
def resume_pending(s, d):
    i = items(s, d)
    return resume(i, i).where("requested_key is not null").select("batch_id", "requested_key")


QUERIES, ORACLE = query.queries, query.oracle
