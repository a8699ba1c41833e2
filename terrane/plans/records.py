"""Sources, sinks, string, date, array, map, JSON and hash functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from terrane.functions.ident import CODE_SHAPE, PUB_SHAPE, norm_code, norm_symbol, pub_parts
from terrane.functions.names import NAME_KEY_SQL, name_key, name_steps
from terrane.plans.base import COPIES, ENTRIES, ITEMS, LATEST, PUB, copies, entries, items, latest
from terrane.plans.registry import Registry
from terrane.runtime import Scratch, table
from terrane.sinks import datasets, rawstore, shred
from terrane.sources import files, lookup, pages, titles

query = Registry()

# ---------------------------------------------------------------- sources


_LOOKUP = """stored AS (SELECT pub, min(raw_record_id) AS raw_record_id FROM (SELECT raw_record_id, {PUB} AS pub FROM patent_document) WHERE pub IS NOT NULL GROUP BY 1),
asked AS (SELECT DISTINCT id, requested_key, upper(regexp_replace(upper(requested_key), '[^0-9A-Z]', '', 'g')) AS k FROM ingest_item),
part AS (SELECT id, regexp_extract(k, '{SHAPE}', 1) AS country, regexp_extract(k, '{SHAPE}', 2) AS number, nullif(regexp_extract(k, '{SHAPE}', 3), '') AS kind FROM asked),
fits AS (SELECT id, CASE WHEN country <> '' AND regexp_matches(number, '[0-9]') AND (kind IS NULL OR regexp_matches(number, '[0-9]$') OR (country = 'SG' AND regexp_matches(number, '^[0-9]+.$'))) THEN country || number END AS bare, kind FROM part)"""
_LOOKUP = _LOOKUP.replace("{PUB}", PUB).replace("{SHAPE}", PUB_SHAPE)


@query(f"""WITH {_LOOKUP} SELECT id, bare || coalesce(kind, '') AS key, coalesce(a.raw_record_id, b.raw_record_id) AS raw_record_id,
CASE WHEN bare IS NULL THEN 'invalid_request' WHEN a.pub IS NOT NULL AND a.raw_record_id IS NOT NULL THEN 'ok' WHEN kind IS NOT NULL AND b.raw_record_id IS NOT NULL THEN 'ok_without_kind' ELSE 'not_found' END AS outcome
FROM fits LEFT JOIN stored a ON a.pub = bare || coalesce(kind, '') LEFT JOIN stored b ON kind IS NOT NULL AND b.pub = bare""")
def src_lookup(s, d):
    """Every requested publication looked up among the stored records, once more without its kind if it isn't there."""
    return lookup.lookup(s, d)


_STATUS = "CASE event_type WHEN 'click' THEN 404 WHEN 'view' THEN 200 WHEN 'purchase' THEN 302 WHEN 'signup' THEN 503 ELSE 429 END"


@query(f"""SELECT event_id, CASE WHEN status = 302 THEN 'failed' WHEN status = 404 THEN 'not_found' WHEN status = 429 OR status >= 500 THEN 'retry' WHEN body THEN 'ok' ELSE 'failed' END AS outcome
FROM (SELECT event_id, {_STATUS} AS status, value > 10 AS body FROM events)""")
def src_classify_response(s, d):
    status = F.expr(_STATUS)
    e = table(s, d, "events").select("event_id", status.alias("status"), (F.col("value") > 10).alias("body"))
    outcome = F.when(F.col("status") == 302, "failed").when(F.col("status") == 404, "not_found").when((F.col("status") == 429) | (F.col("status") >= 500), "retry").when(F.col("body"), "ok").otherwise("failed")
    return e.select("event_id", outcome.alias("outcome"))


_PAGE_FIELDS = ("application_number_raw", "earliest_priority_date", "filing_date", "publication_date", "grant_date", "title", "abstract", "claims", "language", "applicants", "inventors", "cpc", "family_members", "legal_status", "backward_citations", "forward_citations")
# The wordings of these sources beside the page's own; the rest is "other".
STATUS = {**pages.STATUS, "In force": "active", "Grant": "granted", "Patent granted": "granted", "Ceased": "lapsed", "Lapsed, fee not paid": "lapsed", "Expired - term ended": "expired", "Refused": "refused", "Examination requested": "pending"}
_STATUS_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " ELSE 'other' END"


def _neat(x: str) -> str:
    """A text as a page shows it: white space as single spaces."""
    return f"nullif(trim(regexp_replace({x}, '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x{{85}}]+', ' ', 'g')), '')"


def _listed(x: str, each: str) -> str:
    return f"nullif(array_to_string(list_filter(list_transform({x}, lambda x: {each}), lambda x: x IS NOT NULL), '|'), '')"


def _number_sql(x: str) -> tuple[str, str]:
    """(whether a raw number is one, its normal form)."""
    k = f"regexp_replace(upper(trim({x})), '[\\s,\\-/.]', '', 'g')"
    part = lambda i: f"regexp_extract({k}, '{PUB_SHAPE}', {i})"
    return f"({part(1)} <> '' AND regexp_matches({part(2)}, '[0-9]') AND ({part(3)} = '' OR regexp_matches({part(2)}, '[0-9]$') OR ({part(1)} = 'SG' AND regexp_matches({part(2)}, '^[0-9]+.$'))))", k


def _pages_sql() -> str:
    fine, norm = _number_sql("x")
    cited_ok, cited = _number_sql(_neat("x.publication_number_raw"))
    member, told = _neat("x"), "list_filter({}, lambda x: x IS NOT NULL)"
    fits = lambda xs, ok: f"coalesce(list_bool_and(list_transform({xs}, lambda x: {ok})), true)"
    fam, pats, npl = told.format("family_members"), "list_filter(backward_citations, lambda x: x.kind = 'patent')", "list_filter(backward_citations, lambda x: x.kind = 'npl')"
    fwd = told.format("forward_citations.citing_publication_numbers")
    fam_list = f"list_filter(list_transform({fam}, lambda x: {_number_sql(member)[1]}), lambda x: x <> pub)"
    origin = "CASE x.origin WHEN 'examiner' THEN 'examiner' WHEN 'third_party' THEN 'third_party' ELSE 'unknown' END"
    return f"""WITH {LATEST}, said AS (SELECT *, {fits(fam, _number_sql(member)[0])} AS fam_ok, {fits(pats, cited_ok)} AS back_ok, {fits(fwd, fine)} AS fwd_ok FROM doc)
SELECT pub, {_neat('application_number_raw')} AS application_number_raw, earliest_priority_date, filing_date, publication_date, grant_date, {_neat('title')} AS title, {_neat('abstract')} AS abstract, {_neat('claims')} AS claims,
  CASE WHEN abstract IS NOT NULL OR claims IS NOT NULL THEN language END AS language, {_listed('applicants', _neat('x.name_raw'))} AS applicants, {_listed('inventors', _neat('x.name_raw'))} AS inventors,
  nullif(array_to_string(list_transform(list_filter(cpc, lambda x: x.code_raw IS NOT NULL), lambda x: x.code), '|'), '') AS cpc,
  CASE WHEN fam_ok THEN nullif(array_to_string(list_sort(list_distinct({fam_list})), '|'), '') END AS family_members,
  {_STATUS_SQL.format(_neat('legal_status.status_raw'))} || ':' || {_neat('legal_status.status_raw')} AS legal_status,
  CASE WHEN back_ok THEN nullif(array_to_string(list_concat(list_transform({pats}, lambda x: {cited} || ':' || {origin}), list_transform({npl}, lambda x: {_neat('x.npl_text')} || ':' || {origin})), '|'), '') END AS backward_citations,
  CASE WHEN fwd_ok THEN nullif(array_to_string(list_transform({fwd}, lambda x: {norm}), '|'), '') END AS forward_citations,
  CAST((NOT fam_ok)::INT + (NOT back_ok)::INT + (NOT fwd_ok)::INT AS INTEGER) AS n_warnings FROM said"""


def _page_docs(s, d):
    doc = latest(s, d, *_PAGE_FIELDS)
    return doc


@query(_pages_sql())
def src_parse_pages(s, d):
    """Every field of the latest copies written as microdata pages and parsed again."""
    got = pages.parse_pages(pages.as_pages(_page_docs(s, d)), STATUS).where("quarantine is null")
    joined = lambda c: F.nullif(F.array_join(c, "|"), F.lit(""))
    cited = F.transform("backward_citations", lambda b: F.concat_ws(":", F.coalesce(b["publication_number"], b["npl_text"]), b["origin"]))
    return got.select(
        F.col("id").alias("pub"), *_PAGE_FIELDS[:9], joined(F.col("applicants.name_raw")).alias("applicants"), joined(F.col("inventors.name_raw")).alias("inventors"), joined(F.col("cpc.code")).alias("cpc"),
        joined(F.array_sort("family_members")).alias("family_members"), F.concat("legal_status.category", F.lit(":"), "legal_status.status_raw").alias("legal_status"), joined(cited).alias("backward_citations"),
        joined(F.col("forward_citations.citing_publication_numbers")).alias("forward_citations"), F.size("warnings").alias("n_warnings"),
    )


@query(f"""WITH {LATEST}, f AS (SELECT unnest({[*_PAGE_FIELDS, 'family_id_simple', 'family_id_extended', 'priorities', 'ipc']}) AS field)
SELECT pub, field, reason FROM (SELECT pub, field, CASE
  WHEN field IN ('family_id_simple', 'family_id_extended', 'priorities', 'ipc') THEN 'not_provided_by_source'
  WHEN field = 'grant_date' AND grant_date IS NULL THEN CASE WHEN publication_date IS NULL THEN 'not_provided_by_source' ELSE 'not_applicable' END
  WHEN field = 'title' AND {_neat('title')} IS NULL THEN 'not_provided_by_source' WHEN field = 'filing_date' AND filing_date IS NULL THEN 'not_provided_by_source'
  WHEN field = 'abstract' AND {_neat('abstract')} IS NULL THEN 'not_provided_by_source' END AS reason
  FROM doc, f WHERE field IN ('family_id_simple', 'family_id_extended', 'priorities', 'ipc', 'grant_date', 'title', 'filing_date', 'abstract')) WHERE reason IS NOT NULL""")
def src_page_reasons(s, d):
    """Why a field of a parsed page is missing."""
    shown = ["family_id_simple", "family_id_extended", "priorities", "ipc", "grant_date", "title", "filing_date", "abstract"]
    got = pages.parse_pages(pages.as_pages(_page_docs(s, d)), STATUS).where("quarantine is null")
    return got.select(F.col("id").alias("pub"), F.explode("missing").alias("field", "reason")).where(F.col("field").isin(*shown))


@query(f"""WITH {ITEMS}, last AS (SELECT requested_key, arg_max(outcome, (created_at IS NOT NULL, coalesce(created_at, TIMESTAMPTZ '0001-01-01'), id)) AS outcome,
  arg_max(struct_pack(r := raw_record_id), (created_at IS NOT NULL, coalesce(created_at, TIMESTAMPTZ '0001-01-01'), id)).r AS raw_record_id FROM item WHERE requested_key IS NOT NULL GROUP BY 1)
SELECT outcome, count(*) AS n FROM last WHERE NOT (coalesce(outcome, '') IN ('stored', 'quarantined', 'duplicate') AND raw_record_id IS NOT NULL) GROUP BY 1""")
def src_replay_skipped(s, d):
    """What a replay of everything leaves out: keys that were never fetched, by their last outcome."""
    i = items(s, d).where("requested_key is not null").withColumn("object_key", F.col("raw_record_id"))
    none = s.createDataFrame([], rawstore.SHAPE + ", retrieved_at timestamp")
    return rawstore.replay(i, none)[1]


@query(f"""WITH {ITEMS}, last AS (SELECT requested_key, arg_max(outcome, (created_at IS NOT NULL, coalesce(created_at, TIMESTAMPTZ '0001-01-01'), id)) AS outcome,
  arg_max(struct_pack(r := raw_record_id), (created_at IS NOT NULL, coalesce(created_at, TIMESTAMPTZ '0001-01-01'), id)).r AS raw_record_id FROM item WHERE requested_key IS NOT NULL GROUP BY 1),
page AS (SELECT raw_record_id, min(pub) AS pub FROM (SELECT raw_record_id, {PUB} AS pub FROM patent_document) WHERE pub IS NOT NULL GROUP BY 1), {COPIES},
doc AS (SELECT pub, {_neat("arg_max(struct_pack(t := title), (retrieved_at IS NOT NULL, coalesce(retrieved_at, TIMESTAMPTZ '0001-01-01'), document_id)).t")} AS title FROM copies GROUP BY pub)
SELECT requested_key, page.pub, title FROM last JOIN page USING (raw_record_id) JOIN doc USING (pub) WHERE outcome IN ('stored', 'quarantined', 'duplicate')""")
def src_replay(s, d):
    """Every fetched key parsed again from the stored page of its record."""
    i = items(s, d).where("requested_key is not null").withColumn("object_key", F.col("raw_record_id"))
    written = pages.as_pages(_page_docs(s, d))
    of = copies(s, d, "raw_record_id").where("raw_record_id is not null").groupBy(F.col("raw_record_id").alias("object_key")).agg(F.min("pub").alias("id"))
    h = F.sha2("page", 256)
    stored = of.join(written, "id").select(F.concat_ws("/", "object_key", h).alias("filed"), "object_key", h.alias("sha256"), F.col("page").alias("content"), "retrieved_at")
    known = stored.select("object_key", "filed")
    i = i.join(known, "object_key", "left").withColumn("object_key", F.coalesce("filed", "object_key")).drop("filed")
    stored = stored.select(F.col("filed").alias("object_key"), "sha256", "content", "retrieved_at")
    docs = rawstore.replay(i, stored, STATUS)[0].where("quarantine is null")
    pub = F.concat("publication.country", "publication.number", F.coalesce("publication.kind", F.lit("")))
    return docs.select(F.col("id").alias("requested_key"), pub.alias("pub"), "title")


@query()
def src_folder_scan(s, d):
    """Name, number, length, hash and problem of the data files themselves, read as binary files."""
    return files.scan_folder(s, d, "*.parquet")


@query(f"""WITH {ENTRIES}, t AS (SELECT scheme_version, pos, symbol, CASE WHEN kind IN ('main_group', 'subgroup') THEN dot_level END AS level, nullif(title, '') AS title FROM entry)
SELECT scheme_version, pos, symbol, level, title, CASE WHEN level < 0 THEN 'level' WHEN NOT regexp_matches(symbol, '^[A-Z]([0-9]{{2}}([A-Z]([0-9]+/[0-9]+)?)?)?$') THEN 'symbol' END AS problem FROM t""")
def cpc_parse(s, d):
    """Classification titles written as tab-separated lines and parsed again."""
    return titles.parse(titles.as_lines(entries(s, d)))


@query(f"WITH {LATEST} SELECT pub, legal_status.status_raw AS status, {_STATUS_SQL.format('legal_status.status_raw')} AS category, {_STATUS_SQL.format('legal_status.status_raw')} IS DISTINCT FROM legal_status.category AS differs FROM doc WHERE legal_status.status_raw IS NOT NULL")
def map_status(s, d):
    """Category of every wording, and whether the source's own category is another."""
    known = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    doc = latest(s, d, "legal_status").select("pub", F.col("legal_status.status_raw").alias("status"), F.col("legal_status.category").alias("told")).where("status is not null")
    category = F.coalesce(known[F.col("status")], F.lit("other"))
    return doc.select("pub", "status", category.alias("category"), (~category.eqNullSafe(F.col("told"))).alias("differs"))


@query("SELECT doc_id, regexp_matches(regexp_replace(text, '([0-9])[.,]([0-9])', '\\1\\2', 'g'), '(^|[^0-9])17([^0-9]|$)') AS hit FROM documents WHERE text IS NOT NULL")
def whole_number_in_text(s, d):
    joined = F.regexp_replace("text", r"([0-9])[.,]([0-9])", "$1$2")
    return table(s, d, "documents").where("text is not null").select("doc_id", joined.rlike(r"(?<![0-9])17(?![0-9])").alias("hit"))


@query("""WITH t AS (SELECT DISTINCT coalesce(source, '') AS source_id, text, text || CASE WHEN doc_id % 97 = 0 THEN '!' ELSE '' END AS now FROM documents WHERE text IS NOT NULL),
o AS (SELECT source_id, sha256(text) AS h, count(*) FILTER (WHERE sha256(now) <> sha256(text)) > 0 AS spoilt FROM t GROUP BY 1, 2) SELECT 'raw/' || source_id || '/' || left(h, 2) || '/' || h AS object_key, NOT spoilt AS intact FROM o""")
def raw_hash_verify(s, d):
    """Texts filed under their hash; some are changed afterwards, which reading them finds."""
    docs = table(s, d, "documents").where("text is not null").select(F.coalesce("source", F.lit("")).alias("source_id"), F.col("text").alias("content"), (F.col("doc_id") % 97 == 0).alias("change"))
    stored = rawstore.objects(docs)
    key = F.concat_ws("/", F.lit("raw"), "source_id", F.substring(F.sha2("content", 256), 1, 2), F.sha2("content", 256))
    spoilt = docs.groupBy(key.alias("object_key")).agg(F.bool_or("change").alias("spoil"))
    changed = stored.join(spoilt, "object_key").withColumn("content", F.when(F.col("spoil"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return rawstore.verified(changed).select("object_key", "intact")


# ---------------------------------------------------------------- sinks

_LISTS = {"applicant": ("applicants", "x.name_raw"), "inventor": ("inventors", "x.name_raw"), "cpc": ("cpc", "x.code"), "ipc": ("ipc", "x.code"), "priority": ("priorities", "x.number_raw"), "family_member": ("family_members", "x"), "backward_citation": ("backward_citations", "coalesce(x.publication_number, x.npl_text)")}
_UNNEST = " UNION ALL ".join(f"SELECT pub, '{child}' AS child, CAST(i AS INTEGER) AS ordinal, {e.replace('x', 'a[i]', 1) if e == 'x' else e.replace('x.', 'a[i].')} AS value FROM (SELECT pub, {c} AS a, unnest(range(1, len({c}) + 1)) AS i FROM doc)" for child, (c, e) in _LISTS.items())


@query(f"WITH {LATEST} {_UNNEST}")
def shred_children(s, d):
    _, children = shred.shred(latest(s, d, *[c for c, _ in _LISTS.values()]), "pub")
    shown = {"applicant": "value.name_raw", "inventor": "value.name_raw", "cpc": "value.code", "ipc": "value.code", "priority": "value.number_raw", "family_member": "value"}
    value = lambda child: F.col(shown[child]) if child in shown else F.coalesce("value.publication_number", "value.npl_text")
    out = [rows.select("pub", F.lit(child).alias("child"), "ordinal", value(child).alias("value")) for child, rows in children.items()]
    return reduce(lambda a, b: a.unionByName(b), out)


_WHOLE = {
    "applicants": "{x.role}/{x.sequence}/{x.name_raw}/{x.country}/{x.country_missing}", "inventors": "{x.role}/{x.sequence}/{x.name_raw}/{x.country}/{x.country_missing}", "cpc": "{x.scheme}/{x.code}/{x.code_raw}", "ipc": "{x.scheme}/{x.code}/{x.code_raw}",
    "priorities": "{x.number_raw}/{x.country}/{x.date}", "family_members": "{x}", "backward_citations": "{x.kind}/{x.publication_number}/{x.publication_number_raw}/{x.npl_text}/{x.origin}",
}


def _whole_sql(c: str) -> str:
    each = " || '/' || ".join(f"coalesce(CAST({p.strip('{}')} AS VARCHAR), '~')" for p in _WHOLE[c].split("/"))
    return f"array_to_string(list_transform({c}, lambda x: {each}), '|') AS {c}"


@query(f"WITH {LATEST} SELECT pub, document_id, title, filing_date, {', '.join(map(_whole_sql, _WHOLE))} FROM doc")
def reassemble_roundtrip(s, d):
    """Every list of the latest copies taken apart into child rows and put together again, beside the parent's own fields."""
    scratch = Scratch(s, "roundtrip")
    parents, children = shred.shred(scratch.save(latest(s, d, "title", "filing_date", *_WHOLE)), "pub")
    back = shred.reassemble(parents, {n: scratch.save(rows) for n, rows in children.items()}, "pub")
    told = lambda x, p: F.coalesce((x if p == "{x}" else x[p.strip("{}").split(".")[1]]).cast("string"), F.lit("~"))
    line = lambda f: lambda x: F.concat_ws("/", *[told(x, p) for p in f.split("/")])
    joined = [F.array_join(F.transform(c, line(f)), "|").alias(c) for c, f in _WHOLE.items()]
    return back.select("pub", "document_id", "title", "filing_date", *joined)


@query(f"""WITH {ITEMS}, picked AS (SELECT DISTINCT batch_id FROM item ORDER BY 1 LIMIT 3), mine AS (SELECT DISTINCT raw_record_id FROM item JOIN picked USING (batch_id) WHERE raw_record_id IS NOT NULL),
docs AS (SELECT c.* FROM (SELECT * FROM patent_document QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY raw_record_id) = 1) c SEMI JOIN mine USING (raw_record_id))
SELECT 'documents' AS table_name, count(*) AS n FROM docs UNION ALL SELECT 'applicants', coalesce(sum(len(applicants)), 0)::BIGINT FROM docs UNION ALL SELECT 'cpc', coalesce(sum(len(cpc)), 0)::BIGINT FROM docs""")
def dataset_write(s, d):
    """The documents of the first three batches written as a dataset of three tables, and read back against its manifest."""
    i, scratch = items(s, d), Scratch(s, "dataset")
    batches = [r.batch_id for r in i.select("batch_id").distinct().orderBy("batch_id").limit(3).collect()]  # the feature: a dataset of these batches
    docs = datasets.inputs(table(s, d, "patent_document"), i, batches)
    parents, children = shred.shred(docs.select("document_id", "title", "applicants", "cpc"), "document_id")
    tables = {"documents": parents, "applicants": children["applicant"], "cpc": children["cpc"]}
    datasets.write(tables, scratch.root, "run-1", {"batches": batches})
    counts = [datasets.read(s, scratch.root, "run-1", n).select(F.lit(n).alias("table_name")).groupBy("table_name").agg(F.count("*").alias("n")) for n in tables]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("SELECT publication, min(document_id) AS document_id FROM dataset_document x WHERE NOT EXISTS (SELECT 1 FROM family_member f WHERE f.publication = x.publication) GROUP BY 1")
def insert_if_absent(s, d):
    new = table(s, d, "dataset_document").groupBy("publication").agg(F.min("document_id").alias("document_id"))
    return new.join(table(s, d, "family_member"), "publication", "left_anti")


# ---------------------------------------------------------------- strings


@query("""WITH t AS (SELECT DISTINCT id, regexp_replace(upper(trim(requested_key)), '[\\s,\\-/.]', '', 'g') AS k FROM ingest_item),
p AS (SELECT id, k, regexp_extract(k, '^([A-Z]{2})([0-9A-Z]+?)([A-Z][0-9]?)?$', 1) AS country, regexp_extract(k, '^([A-Z]{2})([0-9A-Z]+?)([A-Z][0-9]?)?$', 2) AS number, nullif(regexp_extract(k, '^([A-Z]{2})([0-9A-Z]+?)([A-Z][0-9]?)?$', 3), '') AS kind FROM t)
SELECT id, country, number, kind FROM p WHERE country <> '' AND regexp_matches(number, '[0-9]') AND (kind IS NULL OR regexp_matches(number, '[0-9]$') OR (country = 'SG' AND regexp_matches(number, '^[0-9]+.$')))""")
def norm_pubnum(s, d):
    return items(s, d).select("id", pub_parts(F.col("requested_key")).alias("p")).where("p is not null").select("id", "p.*")


_CODE = "regexp_extract(k, '" + CODE_SHAPE.replace("{", "{{").replace("}", "}}") + "', {})"


@query(f"WITH {LATEST} SELECT pub, i, CASE WHEN regexp_matches(k, '{CODE_SHAPE}') THEN {_CODE.format(1)} || CAST(CAST({_CODE.format(2)} AS INTEGER) AS VARCHAR) || '/' || {_CODE.format(3)} END AS code FROM (SELECT pub, CAST(i - 1 AS INTEGER) AS i, upper(regexp_replace(cpc[i].code_raw, '\\s', '', 'g')) AS k FROM (SELECT pub, cpc, unnest(range(1, len(cpc) + 1)) AS i FROM doc))")
def norm_code_query(s, d):
    return latest(s, d, "cpc").select("pub", F.posexplode("cpc.code_raw").alias("i", "raw")).select("pub", "i", norm_code(F.col("raw")).alias("code"))


query.queries["norm_code"], query.oracle["norm_code"] = query.queries.pop("norm_code_query"), query.oracle.pop("norm_code_query")


@query(f"""WITH {ENTRIES}, t AS (SELECT scheme_version, symbol, upper(regexp_replace(parent, '[\\s\\p{{Z}}]', '', 'g')) AS k FROM entry)
SELECT scheme_version, symbol, CASE WHEN regexp_matches(k, '^[A-Z][0-9]{{2}}[A-Z][0-9]+/[0-9]+$') THEN left(k, 4) || CAST(CAST(regexp_extract(k, '^[A-Z][0-9]{{2}}[A-Z]([0-9]+)/', 1) AS BIGINT) AS VARCHAR) || '/' || split_part(k, '/', 2) ELSE nullif(k, '') END AS parent FROM t""", name="norm_symbol")
def _norm_symbol(s, d):
    return entries(s, d).select("scheme_version", "symbol", norm_symbol(F.col("parent")).alias("parent"))


@query(f"SELECT DISTINCT name_id, {NAME_KEY_SQL.format('raw')} AS key FROM name_key")
def name_keys(s, d):
    return table(s, d, "name_key").select("name_id", name_key(F.col("raw")).alias("key")).distinct()


@query(name="name_steps")
def _name_steps(s, d):
    n = table(s, d, "name_key").select("name_id", "raw").distinct()
    return n.select("name_id", "raw", name_steps(F.col("raw")).alias("n")).select("name_id", "raw", "n.*")


@query(f"WITH {COPIES} SELECT document_id, substr(pub, 1, 2) || '|' || CASE WHEN starts_with(k, substr(pub, 1, 2)) THEN substr(k, 3) ELSE k END AS key FROM (SELECT document_id, pub, upper(regexp_replace(application_number_raw, '[^0-9A-Za-z]', '', 'g')) AS k FROM copies) WHERE k IS NOT NULL")
def application_key(s, d):
    k, office = F.upper(F.regexp_replace("application_number_raw", "[^0-9A-Za-z]", "")), F.substring("pub", 1, 2)
    own = F.when(k.startswith(office), F.expr("substring(upper(regexp_replace(application_number_raw, '[^0-9A-Za-z]', '')), 3)")).otherwise(k)
    return copies(s, d, "application_number_raw").where("application_number_raw is not null").select("document_id", F.concat_ws("|", office, own).alias("key"))


@query(f"WITH {ENTRIES} SELECT scheme_version, symbol, array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace(title, '\\([^()]*\\)', ' ', 'g'), '\\([^()]*\\)', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+'), ' ') AS words FROM entry WHERE title IS NOT NULL")
def title_words(s, d):
    bare = F.regexp_replace(F.regexp_replace("title", r"\([^()]*\)", " "), r"\([^()]*\)", " ")
    return entries(s, d).where("title is not null").select("scheme_version", "symbol", F.array_join(F.regexp_extract_all(F.lower(bare), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ").alias("words"))


_CAPTION = r"(?:FIG\.|Fig\.|Figure|Table|Box)\s*[0-9]+"


@query(f"SELECT doc_id, lower(regexp_extract(m, '^[A-Za-z]+')) AS kind, regexp_extract(m, '([0-9]+)$', 1) AS number, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_CAPTION}')) AS m FROM documents) GROUP BY ALL")
def captions(s, d):
    """Figures, tables and boxes a text names, and how often."""
    m = table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_CAPTION), F.lit(0))).alias("m"))
    return m.groupBy("doc_id", F.lower(F.regexp_extract("m", "^[A-Za-z]+", 0)).alias("kind"), F.regexp_extract("m", "([0-9]+)$", 1).alias("number")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT doc_id, section, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, section, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM w)),
t AS (SELECT DISTINCT gram FROM g WHERE section = 'claim')
SELECT doc_id, count(*) AS shared FROM g WHERE section = 'description' AND gram IN (SELECT gram FROM t) GROUP BY 1""")
def shingle_overlap(s, d):
    w = table(s, d, "documents").where("text is not null").select("doc_id", "section", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " ")))
    g = w.where("size(w) >= 8 and section in ('claim', 'description')").select("doc_id", "section", gram.alias("gram"))
    mine = g.where("section = 'description'").select("doc_id", "gram").distinct()
    return mine.join(g.where("section = 'claim'").select("gram"), "gram", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))


@query(f"WITH {ENTRIES} SELECT scheme_version, symbol, slug || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY scheme_version, slug ORDER BY symbol) AS k FROM (SELECT scheme_version, symbol, left(trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_'), 36) AS slug FROM entry WHERE title IS NOT NULL))")
def slugify(s, d):
    from pyspark.sql import Window as W

    slug = F.substring(F.btrim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "_"), F.lit("_")), 1, 36)
    e = entries(s, d).where("title is not null").select("scheme_version", "symbol", slug.alias("slug"))
    k = F.row_number().over(W.partitionBy("scheme_version", "slug").orderBy("symbol"))
    return e.withColumn("k", k).select("scheme_version", "symbol", F.concat("slug", F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise("")).alias("slug"))


@query("""SELECT DISTINCT name_id, CASE WHEN trim(raw) <> raw THEN 'surrounding spaces' WHEN length(raw) < 2 OR length(raw) > 80 THEN 'length' WHEN NOT regexp_matches(raw, '[\\p{L}\\p{N}]') THEN 'no letters or digits' WHEN regexp_matches(raw, '["*?()&/]') THEN 'syntax characters' END AS problem FROM name_key""")
def term_problems(s, d):
    raw = F.col("raw")
    problem = F.when(F.trim(raw) != raw, "surrounding spaces").when((F.length(raw) < 2) | (F.length(raw) > 80), "length").when(~raw.rlike(r"[\p{L}\p{N}]"), "no letters or digits").when(raw.rlike(r'["*?()&/]'), "syntax characters")
    return table(s, d, "name_key").select("name_id", problem.alias("problem")).distinct()


@query(f"WITH {ENTRIES} SELECT scheme_version, symbol, CASE WHEN NOT regexp_matches(title, '[\\p{{L}}\\p{{N}}]') THEN 'has no letters or digits' WHEN regexp_matches(title, '[^\\p{{L}}\\p{{N}}\\s\\-]') THEN 'contains characters that title search ignores' END AS problem FROM entry WHERE title IS NOT NULL")
def title_term_problems(s, d):
    t = F.col("title")
    problem = F.when(~t.rlike(r"[\p{L}\p{N}]"), "has no letters or digits").when(t.rlike(r"[^\p{L}\p{N}\s\-]"), "contains characters that title search ignores")
    return entries(s, d).where("title is not null").select("scheme_version", "symbol", problem.alias("problem"))


@query("SELECT lower(raw) AS folded, arg_min(raw, name_id) AS spelling FROM name_key GROUP BY 1")
def terms_distinct(s, d):
    return table(s, d, "name_key").groupBy(F.lower("raw").alias("folded")).agg(F.min_by("raw", "name_id").alias("spelling"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL")
def collapse_ws(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.trim(F.regexp_replace("text", r"[\s\p{Z}]+", " ")).alias("text"))


@query("SELECT event_id, regexp_replace(props, '(\"k\"\\s*:\\s*)[^,}]+', '\\1\"***\"') AS props FROM events")
def redact_props(s, d):
    return table(s, d, "events").select("event_id", F.regexp_replace("props", r'("k"\s*:\s*)[^,}]+', '$1"***"').alias("props"))


@query("SELECT doc_id, regexp_matches(lower(text), '(?:^|[^\\pL\\pN])(?:rotary[\\s\\-]+encoder(?:s|es)?|memory[\\s\\-]+bank(?:s|es)?)(?:$|[^\\pL\\pN])') AS hit FROM documents WHERE text IS NOT NULL")
def phrase_match(s, d):
    from terrane.operators.search import phrase_pattern

    p = "|".join(phrase_pattern(x) for x in ("rotary encoder", "memory bank"))
    return table(s, d, "documents").where("text is not null").select("doc_id", F.lower("text").rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{p})(?![\p{{L}}\p{{N}}])").alias("hit"))


# ---------------------------------------------------------------- dates, arrays, maps, JSON, hashes


@query(f"WITH {LATEST} SELECT pub, strftime(publication_date, '%Y%m%d') AS compact, try_cast(replace(strftime(publication_date, '%Y-%m-%d'), '-0', '-') AS DATE) IS NOT NULL AS loose, CAST(CAST(retrieved_at AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS retrieved FROM doc WHERE publication_date IS NOT NULL")
def date_formats(s, d):
    doc = latest(s, d, "publication_date").where("publication_date is not null")
    return doc.select("pub", F.date_format("publication_date", "yyyyMMdd").alias("compact"), F.try_to_date(F.date_format("publication_date", "yyyy-MM-dd"), "yyyy-MM-dd").isNotNull().alias("loose"), F.to_date("retrieved_at").cast("string").alias("retrieved"))


@query(f"WITH {LATEST}, m AS (SELECT max(publication_date) AS newest FROM doc) SELECT pub, publication_date > newest - INTERVAL 18 MONTH AS incomplete FROM doc, m WHERE publication_date IS NOT NULL")
def incomplete_flag(s, d):
    doc = latest(s, d, "publication_date").where("publication_date is not null")
    newest = doc.agg(F.max("publication_date").alias("newest"))  # one row
    return doc.crossJoin(F.broadcast(newest)).select("pub", (F.col("publication_date") > F.add_months("newest", -18)).alias("incomplete"))


@query(f"""WITH {LATEST} SELECT pub, publication_date < filing_date AS published_early, grant_date < filing_date AS granted_early, earliest_priority_date > filing_date AS priority_late,
  CASE WHEN priorities IS NOT NULL THEN earliest_priority_date IS DISTINCT FROM list_min(list_transform(priorities, lambda p: p.date)) END AS wrong_earliest FROM doc""")
def date_order_violations(s, d):
    """For every latest copy which rules on the order of its dates it breaks; null where a date is missing."""
    c = F.col
    wrong = F.when(c("priorities").isNotNull(), ~c("earliest_priority_date").eqNullSafe(F.array_min("priorities.date")))
    doc = latest(s, d, "publication_date", "filing_date", "grant_date", "earliest_priority_date", "priorities")
    return doc.select("pub", (c("publication_date") < c("filing_date")).alias("published_early"), (c("grant_date") < c("filing_date")).alias("granted_early"), (c("earliest_priority_date") > c("filing_date")).alias("priority_late"), wrong.alias("wrong_earliest"))


@query(f"WITH {LATEST} SELECT pub, len(family_members) AS n, len(list_distinct(family_members)) AS n_distinct, array_to_string(list_sort(list_distinct(family_members)), ',') AS sorted, list_contains(family_members, pub) AS self FROM doc WHERE family_members IS NOT NULL")
def array_ops(s, d):
    m = F.col("family_members")
    return latest(s, d, "family_members").where(m.isNotNull()).select(
        "pub", F.size(m).cast("bigint").alias("n"), F.size(F.array_distinct(m)).cast("bigint").alias("n_distinct"), F.array_join(F.array_sort(F.array_distinct(m)), ",").alias("sorted"), F.array_contains(m, F.col("pub")).alias("self")
    )


@query(f"WITH {LATEST} SELECT pub, array_to_string(list_sort(list_distinct(list_append(map_keys(missing), 'claims'))), ',') AS keys, missing['claims'] AS claims FROM doc WHERE missing IS NOT NULL")
def map_ops(s, d):
    m = latest(s, d, "missing").where("missing is not null")
    added = F.when(~F.map_contains_key("missing", "claims"), F.map_concat("missing", F.create_map(F.lit("claims"), F.lit("not_requested")))).otherwise(F.col("missing"))
    return m.select("pub", F.array_join(F.array_sort(F.map_keys(added)), ",").alias("keys"), F.element_at("missing", "claims").alias("claims"))


@query(f"WITH {ITEMS} SELECT id, '{{\"batch_id\":\"' || batch_id || '\",\"document_count\":' || document_count || ',\"outcome\":\"' || outcome || '\"}}' AS json FROM item")
def canonical_rows(s, d):
    return items(s, d).select("id", F.to_json(F.struct("batch_id", "document_count", "outcome"), {"ignoreNullFields": "false"}).alias("json"))


_ROW = """'{"batch_id":' || to_json(batch_id) || ',"detail":' || coalesce(to_json(detail), 'null') || ',"document_count":' || coalesce(CAST(document_count AS VARCHAR), 'null') || ',"outcome":' || coalesce(to_json(outcome), 'null') || ',"raw_record_id":' || coalesce(to_json(raw_record_id), 'null') || '}'"""


@query(f"WITH {ITEMS} SELECT id, sha256({_ROW}) AS hash FROM item")
def row_hash(s, d):
    """Hash of the canonical JSON of a row: keys in order, no spaces, nulls written out."""
    row = F.to_json(F.struct("batch_id", "detail", "document_count", "outcome", "raw_record_id"), {"ignoreNullFields": "false"})
    return items(s, d).select("id", F.sha2(row, 256).alias("hash"))


@query(f"WITH {ITEMS} SELECT DISTINCT batch_id, CAST(('0x' || left(md5(batch_id), 15))::BIGINT % 2147483648 AS BIGINT) AS lock FROM item WHERE batch_id IS NOT NULL")
def lock_keys(s, d):
    """A number below 2^31 for each batch, under which only one writer may hold it."""
    n = F.conv(F.substring(F.md5("batch_id"), 1, 15), 16, 10).cast("bigint")
    return items(s, d).where("batch_id is not null").select("batch_id", F.pmod(n, F.lit(2147483648)).alias("lock")).distinct()


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def text_sha256(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))


@query(f"""WITH {COPIES} SELECT document_id, CASE WHEN (title IS NULL) <> (coalesce(element_at(missing, 'title')[1], '') <> '') THEN 'title' ELSE NULL END AS value_or_reason,
  len(list_filter(cpc, lambda c: c.scheme <> 'cpc')) > 0 AS wrong_scheme, CAST(len(applicants) AS BIGINT) <> list_max(list_transform(applicants, lambda a: a.sequence)) AS wrong_sequence FROM copies""")
def record_violations(s, d):
    c = copies(s, d, "title", "missing", "cpc", "applicants")
    told = F.coalesce(F.col("missing")["title"], F.lit("")) != ""
    return c.select(
        "document_id", F.when(F.col("title").isNull() != told, "title").alias("value_or_reason"), F.exists("cpc", lambda x: x["scheme"] != "cpc").alias("wrong_scheme"),
        (F.size("applicants") != F.array_max("applicants.sequence")).alias("wrong_sequence"),
    )


QUERIES, ORACLE = query.queries, query.oracle
