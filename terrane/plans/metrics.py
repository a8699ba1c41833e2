"""The metric catalogue: one function per metric over families, each with its SQL twin.

Choices where the catalogue leaves room: the interval of a precision or recall is Wilson's at 95 %; a year is
complete if it ends two years before the newest publication, the newest one being no later than the last with a family; the recent window is the last five complete
years; "top" means the first ten; a segment is low if it has fewer families than the median segment; a
family's age counts to the newest publication date. Segments are the sections of the classification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.names import NAME_KEY_SQL, name_key
from terrane.plans.base import COPIES, ITEMS, LATEST, copies, items, latest
from terrane.plans.landscape import _COUNTS, _RECORDS, query_counts
from terrane.plans.registry import Registry
from terrane.runtime import Scratch, table

query = Registry()
TOP = 10
Z = 1.959964

_KEY = NAME_KEY_SQL
CTX = f"""{LATEST}, fkey AS (SELECT publication, min(family_key) AS family_key FROM family_member GROUP BY 1),
fd AS (SELECT doc.*, coalesce(family_key, pub) AS fam FROM doc LEFT JOIN fkey ON fkey.publication = pub),
fam AS (SELECT fam, min(coalesce(earliest_priority_date, filing_date)) AS first_date, CAST(year(min(coalesce(earliest_priority_date, filing_date))) AS INTEGER) AS year,
  min(publication_date) AS first_pub, coalesce(bool_or(legal_status.category = 'granted' OR grant_date IS NOT NULL), false) AS granted, count(*) AS members FROM fd GROUP BY fam),
fo AS (SELECT DISTINCT fam, office FROM fd),
fa AS (SELECT DISTINCT fam, {_KEY.format('a.name_raw')} AS applicant, a.country AS country FROM fd, unnest(applicants) AS u(a)),
fi AS (SELECT DISTINCT fam, {_KEY.format('a.name_raw')} AS inventor, a.country AS country FROM fd, unnest(inventors) AS u(a)),
fs AS (SELECT DISTINCT fam, left(c.code, 1) AS segment FROM fd, unnest(cpc) AS u(c)),
lim AS (SELECT CAST(least(year(max(publication_date)) - 2, (SELECT max(year) FROM fam)) AS INTEGER) AS complete, max(publication_date) AS newest FROM doc),
ipf AS (SELECT fam FROM fo WHERE office <> 'WO' GROUP BY fam HAVING count(*) >= 2)"""


class Context:
    """Frames of one run; each is a lazy plan, so a metric reads only the columns it asks for."""

    def __init__(self, s, d):
        self.s, self.d = s, d

    def docs(self, *cols: str) -> DataFrame:
        key = table(self.s, self.d, "family_member").groupBy(F.col("publication").alias("pub")).agg(F.min("family_key").alias("family_key"))
        return latest(self.s, self.d, *cols).join(key, "pub", "left").withColumn("fam", F.coalesce("family_key", "pub"))

    def families(self) -> DataFrame:
        first = F.min(F.coalesce("earliest_priority_date", "filing_date"))
        d = self.docs("earliest_priority_date", "filing_date", "publication_date", "legal_status", "grant_date")
        granted = F.bool_or((F.col("legal_status.category") == "granted") | F.col("grant_date").isNotNull())
        return d.groupBy("fam").agg(
            first.alias("first_date"), F.year(first).alias("year"), F.min("publication_date").alias("first_pub"), F.coalesce(granted, F.lit(False)).alias("granted"), F.count("*").alias("members")
        )

    def offices(self) -> DataFrame:
        return self.docs().select("fam", "office").distinct()

    def _people(self, field: str, name: str) -> DataFrame:
        p = self.docs(field).select("fam", F.explode(field).alias("a"))
        return p.select("fam", name_key(F.col("a.name_raw")).alias(name), F.col("a.country").alias("country")).distinct()

    def applicants(self) -> DataFrame:
        return self._people("applicants", "applicant")

    def inventors(self) -> DataFrame:
        return self._people("inventors", "inventor")

    def segments(self) -> DataFrame:
        return self.docs("cpc").select("fam", F.explode("cpc.code").alias("code")).select("fam", F.substring("code", 1, 1).alias("segment")).distinct()

    def international(self) -> DataFrame:
        return self.offices().where("office <> 'WO'").groupBy("fam").agg(F.count("*").alias("n")).where("n >= 2").select("fam")

    def limits(self) -> DataFrame:
        """One row: the newest complete year that has families, and the newest publication date."""
        newest = latest(self.s, self.d, "publication_date").agg(F.max("publication_date").alias("newest"))
        last = self.families().agg(F.max("year").alias("last"))
        return newest.crossJoin(F.broadcast(last)).select(F.least(F.year("newest") - 2, F.col("last")).alias("complete"), "newest")  # one row each

    def with_limits(self, df: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(self.limits()))  # one row beside every task


def share(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def _n(name: str = "n"):
    return F.count("*").alias(name)


# ---------------------------------------------------------------- run, search and quality


@query("SELECT 'counting_unit' AS name, 'family' AS value UNION ALL SELECT 'time_basis', 'earliest_priority_year' UNION ALL SELECT 'incomplete_period', '18_months' UNION ALL SELECT 'growth_rate', 'cagr_excluding_incomplete'")
def m_run_metadata(s, d):
    rows = [("counting_unit", "family"), ("time_basis", "earliest_priority_year"), ("incomplete_period", "18_months"), ("growth_rate", "cagr_excluding_incomplete")]
    return s.createDataFrame(rows, "name string, value string")


@query(f"WITH RECURSIVE {_RECORDS} {_COUNTS}")
def m_query_hit_counts(s, d):
    return query_counts(s, d)


@query(f"""WITH {COPIES}, known AS (SELECT DISTINCT publication FROM family_member WHERE publication IS NOT NULL), got AS (SELECT DISTINCT pub FROM copies),
r AS (SELECT count(*) AS known, count(pub) AS found, round(CAST(count(pub) AS DOUBLE) / count(*), 6) AS recall FROM known LEFT JOIN got ON pub = publication)
SELECT NULL AS missing, known, found, recall FROM r UNION ALL SELECT publication, known, found, recall FROM known ANTI JOIN got ON pub = publication, r""")
def m_seed_recall(s, d):
    """How many known publications were found, and a row for each that wasn't."""
    known = table(s, d, "family_member").select(F.col("publication").alias("pub")).where("pub is not null").distinct()
    k = known.join(copies(s, d).select("pub").distinct().withColumn("hit", F.lit(1)), "pub", "left")
    k = Scratch(s, "recall").save(k)
    r = k.agg(F.count("*").alias("known"), F.count("hit").alias("found"), share(F.count("hit"), F.count("*")).alias("recall"))
    gone = k.where("hit is null").select(F.col("pub").alias("missing")).crossJoin(F.broadcast(r))  # one row of counts
    return r.select(F.lit(None).cast("string").alias("missing"), "known", "found", "recall").unionByName(gone)


@query(f"WITH {COPIES}, k AS (SELECT pub, row_number() OVER (PARTITION BY pub ORDER BY retrieved_at DESC NULLS LAST, document_id DESC) AS k FROM copies) SELECT CASE WHEN k = 1 THEN 'kept' ELSE 'superseded_copy' END AS step, count(*) AS n FROM k GROUP BY 1")
def m_dataset_reconciliation(s, d):
    per = copies(s, d).groupBy("pub").agg(_n())
    return per.agg(F.count("*").alias("kept"), F.sum(F.col("n") - 1).alias("superseded_copy")).selectExpr("stack(2, 'kept', kept, 'superseded_copy', superseded_copy) AS (step, n)")


@query(f"WITH {ITEMS} SELECT 'ingest' AS step, detail AS warning, count(*) AS n FROM item WHERE detail IS NOT NULL GROUP BY 2")
def m_limitations(s, d):
    return items(s, d).where("detail is not null").groupBy(F.lit("ingest").alias("step"), F.col("detail").alias("warning")).agg(_n())


_FIELDS = ("title", "abstract", "claims", "filing_date", "grant_date", "publication_date", "earliest_priority_date", "language", "applicants", "inventors", "cpc", "legal_status")


@query(f"WITH {CTX} " + " UNION ALL ".join(f"SELECT '{f}' AS field, round(avg(CASE WHEN has THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT fam, bool_or({f} IS NOT NULL) AS has FROM fd GROUP BY fam)" for f in _FIELDS))
def m_field_completeness(s, d):
    has = Context(s, d).docs(*_FIELDS).groupBy("fam").agg(*[F.bool_or(F.col(f).isNotNull()).alias(f) for f in _FIELDS])
    one = has.agg(*[F.round(F.avg(F.col(f).cast("double")), 6).alias(f) for f in _FIELDS])
    return one.unpivot([], list(_FIELDS), "field", "share")


@query(f"WITH {CTX} SELECT count(DISTINCT fam) AS families, count(*) AS publications FROM fd")
def m_families_total(s, d):
    per = Context(s, d).docs().groupBy("fam").agg(_n())
    return per.agg(F.count("*").alias("families"), F.sum("n").alias("publications"))


_WILSON = "round((p + {z2} / (2 * n) {sign} {z} * sqrt(p * (1 - p) / n + {z2} / (4 * n * n))) / (1 + {z2} / n), 6)"


def _wilson_sql(sign: str) -> str:
    return _WILSON.format(z=Z, z2=Z * Z, sign=sign)


def _wilson(p: Column, n: Column, sign: int) -> Column:
    return F.round((p + Z * Z / (2 * n) + sign * Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n), 6)


# The gold set is the earlier run's decision; the rule under test is that a copy has an abstract.
_GOLD = f"WITH {COPIES}, g AS (SELECT document_id, pub, abstract IS NOT NULL AS said, lower(trim(decision)) = 'selected' AS truth, left(pub, 2) AS seg FROM copies JOIN (SELECT document_id, max(decision) AS decision FROM dataset_document GROUP BY 1) USING (document_id))"


def _gold(s, d) -> DataFrame:
    dec = table(s, d, "dataset_document").groupBy("document_id").agg(F.max("decision").alias("decision"))
    c = copies(s, d, "abstract").join(dec, "document_id")
    return c.select(F.substring("pub", 1, 2).alias("seg"), F.col("abstract").isNotNull().alias("said"), (F.lower(F.trim("decision")) == "selected").alias("truth"))


def _quality(g: DataFrame, *by: str) -> DataFrame:
    hit, said, true = (F.count_if(F.col("said") & F.col("truth")), F.count_if("said"), F.count_if("truth"))
    q = g.groupBy(*by).agg(hit.alias("tp"), said.alias("n"), true.alias("pos"))
    q = q.withColumn("p", F.try_divide(F.col("tp").cast("double"), F.col("n").cast("double")))
    f1 = F.try_divide(2 * F.col("tp").cast("double"), (F.col("n") + F.col("pos")).cast("double"))
    return q.select(*by, F.round("p", 6).alias("precision"), share(F.col("tp"), F.col("pos")).alias("recall"), F.round(f1, 6).alias("f1"), _wilson(F.col("p"), F.col("n"), -1).alias("low"), _wilson(F.col("p"), F.col("n"), 1).alias("high"))


_QUAL = "round(p, 6) AS precision, round(CAST(tp AS DOUBLE) / pos, 6) AS recall, round(2.0 * tp / (n + pos), 6) AS f1, {} AS low, {} AS high FROM (SELECT *, CAST(tp AS DOUBLE) / n AS p FROM (SELECT {} count(*) FILTER (WHERE said AND truth) AS tp, count(*) FILTER (WHERE said) AS n, count(*) FILTER (WHERE truth) AS pos FROM g {}))"


@query(f"{_GOLD} SELECT " + _QUAL.format(_wilson_sql("-"), _wilson_sql("+"), "", ""))
def m_relevance_quality(s, d):
    return _quality(_gold(s, d))


@query(f"{_GOLD} SELECT seg, " + _QUAL.format(_wilson_sql("-"), _wilson_sql("+"), "seg,", "GROUP BY seg"))
def m_segment_quality(s, d):
    return _quality(_gold(s, d), "seg")


@query(f"WITH {CTX} SELECT count(*) AS families, count(*) - count(s.fam) AS unclassified, round(CAST(count(*) - count(s.fam) AS DOUBLE) / count(*), 6) AS share FROM fam LEFT JOIN (SELECT DISTINCT fam FROM fs) s USING (fam)")
def m_unclassified_share(s, d):
    c = Context(s, d)
    f = c.docs().select("fam").distinct().join(c.segments().select("fam").distinct().withColumn("has", F.lit(1)), "fam", "left")
    none = F.count("*") - F.count("has")
    return f.agg(F.count("*").alias("families"), none.alias("unclassified"), share(none, F.count("*")).alias("share"))


# ---------------------------------------------------------------- trends

_YEARS = "yr AS (SELECT CAST(unnest(range((SELECT min(year) FROM fam), (SELECT max(year) + 1 FROM fam))) AS INTEGER) AS year)"


@query(f"WITH {CTX}, {_YEARS} SELECT year, count(fam.fam) AS families, count(ipf.fam) AS international, year > complete AS incomplete FROM yr LEFT JOIN fam USING (year) LEFT JOIN ipf USING (fam), lim GROUP BY year, complete")
def m_families_per_year(s, d):
    c = Context(s, d)
    n = c.families().where("year is not null").join(c.international().withColumn("ipf", F.lit(1)), "fam", "left").groupBy("year").agg(_n("families"), F.count("ipf").alias("international"))
    span = n.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    return c.with_limits(span.join(n, "year", "left")).select("year", F.coalesce("families", F.lit(0)).alias("families"), F.coalesce("international", F.lit(0)).alias("international"), (F.col("year") > F.col("complete")).alias("incomplete"))


def _yearly(c: Context) -> DataFrame:
    n = c.families().where("year is not null").groupBy("year").agg(_n())
    span = n.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    return span.join(n, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


_YEARLY = f"{_YEARS}, y AS (SELECT year, count(fam.fam) AS n FROM yr LEFT JOIN fam USING (year) GROUP BY year)"


@query(f"WITH {CTX}, {_YEARLY} SELECT year, n, CASE WHEN lag(n) OVER (ORDER BY year) > 0 THEN round(CAST(n AS DOUBLE) / lag(n) OVER (ORDER BY year) - 1, 6) END AS change FROM y")
def yoy_change(s, d):
    before = F.lag("n").over(W.orderBy("year"))  # a row per year
    return _yearly(Context(s, d)).select("year", "n", F.when(before > 0, F.round(F.col("n") / before - 1, 6)).alias("change"))


_CAGR = f"""c AS (SELECT y.n, z.year AS start_year, z.n AS start_n, y.year AS end_year FROM y, lim, y z WHERE y.year = complete AND z.year IN ((SELECT min(year) FROM y), complete - 5))
SELECT start_year, end_year, start_n, n AS end_n, CASE WHEN start_n > 0 AND end_year > start_year THEN round(pow(CAST(n AS DOUBLE) / start_n, 1.0 / (end_year - start_year)) - 1, 6) END AS cagr, CASE WHEN start_n > 0 THEN 'defined' ELSE 'not defined' END AS status FROM c"""


@query(f"WITH {CTX}, {_YEARLY}, {_CAGR}")
def cagr(s, d):
    c = Context(s, d)
    y = c.with_limits(_yearly(c))
    first = _yearly(c).agg(F.min("year").alias("first"))
    end = y.where("year = complete").select(F.col("year").alias("end_year"), F.col("n").alias("end_n"))
    start = y.crossJoin(F.broadcast(first)).where("year = first or year = complete - 5").select(F.col("year").alias("start_year"), F.col("n").alias("start_n"))
    growth = F.round(F.pow(F.col("end_n").cast("double") / F.col("start_n"), 1 / (F.col("end_year") - F.col("start_year"))) - 1, 6)
    both = start.crossJoin(F.broadcast(end))  # one row beside at most two
    return both.select("start_year", "end_year", "start_n", "end_n", F.when((F.col("start_n") > 0) & (F.col("end_year") > F.col("start_year")), growth).alias("cagr"), F.when(F.col("start_n") > 0, "defined").otherwise("not defined").alias("status"))


@query(f"""WITH {CTX}, {_YEARS}, f2 AS (SELECT 'all' AS basis, fam, year FROM fam UNION ALL SELECT 'international', fam, year FROM fam SEMI JOIN ipf USING (fam)),
y2 AS (SELECT b.basis, yr.year, count(f2.fam) AS n FROM yr CROSS JOIN (SELECT unnest(['all', 'international']) AS basis) b LEFT JOIN f2 ON f2.basis = b.basis AND f2.year = yr.year GROUP BY ALL),
ends AS (SELECT basis, complete, n AS end_n FROM y2, lim WHERE year = complete),
spans AS (SELECT unnest(['full', 'recent']) AS span)
SELECT e.basis, span, s.year AS start_year, complete AS end_year, s.n AS start_n, end_n, CASE WHEN s.n > 0 AND complete > s.year THEN round(pow(CAST(end_n AS DOUBLE) / s.n, 1.0 / (complete - s.year)) - 1, 6) END AS rate, CASE WHEN s.n > 0 AND complete > s.year THEN 'defined' ELSE 'not defined' END AS status
FROM ends e, spans JOIN y2 s ON s.basis = e.basis AND s.year = CASE span WHEN 'full' THEN (SELECT min(year) FROM yr) ELSE greatest(complete - 5, (SELECT min(year) FROM yr)) END
UNION ALL SELECT y2.basis, 'year', p.year, y2.year, p.n, y2.n, CASE WHEN p.n > 0 THEN round(CAST(y2.n AS DOUBLE) / p.n - 1, 6) END, CASE WHEN p.n > 0 THEN 'defined' ELSE 'not defined' END FROM y2 JOIN y2 p ON p.basis = y2.basis AND p.year = y2.year - 1, lim WHERE y2.year <= complete""")
def m_growth_rates(s, d):
    """CAGR over the whole complete period and its last five years, and the change of every complete year, for all and for international families."""
    c = Context(s, d)
    fam, inter = c.families().where("year is not null").select("fam", "year"), c.international()
    n = fam.select(F.lit("all").alias("basis"), "year").unionByName(fam.join(inter, "fam", "left_semi").select(F.lit("international").alias("basis"), "year"))
    n = n.groupBy("basis", "year").agg(_n())  # two rows a year
    ends = n.agg(F.min("year").alias("a"), F.max("year").alias("b"))
    span = ends.select(F.explode(F.sequence("a", "b")).alias("year"), "a").select("year", "a", F.explode(F.array(F.lit("all"), F.lit("international"))).alias("basis"))
    y = c.with_limits(span.join(n, ["basis", "year"], "left").na.fill(0, ["n"])).where("year <= complete")
    end = y.where("year = complete").select("basis", F.col("year").alias("end_year"), F.col("n").alias("end_n"))
    start = y.select("basis", F.col("year").alias("start_year"), F.col("n").alias("start_n"), F.explode(F.array_compact(F.array(F.when(F.col("year") == F.col("a"), "full"), F.when(F.col("year") == F.greatest(F.col("complete") - 5, "a"), "recent")))).alias("span"))
    steps = y.select("basis", F.col("year").alias("end_year"), F.col("n").alias("end_n")).join(y.select("basis", F.col("year").alias("start_year"), F.col("n").alias("start_n")), "basis").where("start_year = end_year - 1")
    both = start.join(end, "basis").unionByName(steps.withColumn("span", F.lit("year")))
    fine = (F.col("start_n") > 0) & (F.col("end_year") > F.col("start_year"))
    rate = F.round(F.pow(F.col("end_n").cast("double") / F.col("start_n"), 1 / (F.col("end_year") - F.col("start_year"))) - 1, 6)
    return both.select("basis", "span", "start_year", "end_year", "start_n", "end_n", F.when(fine, rate).alias("rate"), F.when(fine, "defined").otherwise("not defined").alias("status"))


@query(f"""WITH {CTX}, ap AS (SELECT DISTINCT fam, applicant FROM fa WHERE applicant IS NOT NULL), top AS (SELECT applicant FROM ap GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {TOP}),
v AS (SELECT 'segment' AS basis, segment AS value, fam FROM fs UNION ALL SELECT 'all', NULL, fam FROM fam UNION ALL SELECT 'applicant', applicant, fam FROM ap SEMI JOIN top USING (applicant))
SELECT basis, value, round(CAST(count(*) AS DOUBLE) / 5, 6) AS per_year FROM v JOIN fam USING (fam), lim WHERE year BETWEEN complete - 4 AND complete GROUP BY 1, 2""")
def m_filing_velocity(s, d):
    """Families a year over the last five complete years: overall, per segment and for the top applicants."""
    c = Context(s, d)
    f, ap = c.with_limits(c.families()).where("year between complete - 4 and complete").select("fam"), _ap(c)
    top = ap.groupBy("applicant").count().orderBy(F.desc("count"), "applicant").limit(TOP).select("applicant")
    value = lambda basis, v: [F.lit(basis).alias("basis"), v.cast("string").alias("value")]
    rows = f.select(*value("all", F.lit(None))).unionByName(f.join(c.segments(), "fam").select(*value("segment", F.col("segment"))))
    rows = rows.unionByName(f.join(ap.join(F.broadcast(top), "applicant", "left_semi"), "fam").select(*value("applicant", F.col("applicant"))))
    return rows.groupBy("basis", "value").agg(F.round(F.count("*") / 5, 6).alias("per_year"))


@query(f"WITH {CTX} SELECT year, CAST(floor(year / 5) * 5 AS INTEGER) AS phase, count(DISTINCT fam.fam) AS families, count(DISTINCT applicant) AS applicants, count(DISTINCT CASE WHEN granted THEN fam.fam END) AS granted FROM fam LEFT JOIN fa USING (fam) WHERE year IS NOT NULL GROUP BY year")
def m_maturity_map_points(s, d):
    c = Context(s, d)
    f = c.families().where("year is not null")
    n = f.groupBy("year").agg(_n("families"), F.count_if("granted").alias("granted"))
    a = f.join(c.applicants(), "fam").where("applicant is not null").select("year", "applicant").distinct().groupBy("year").agg(_n("applicants"))
    return n.join(a, "year", "left").select("year", (F.floor(F.col("year") / 5) * 5).cast("int").alias("phase"), "families", F.coalesce("applicants", F.lit(0)).alias("applicants"), "granted")


# ---------------------------------------------------------------- applicants and inventors

_AP = "ap AS (SELECT DISTINCT fam, applicant FROM fa WHERE applicant IS NOT NULL)"
_SECTOR = "CASE WHEN regexp_matches({0}, '(^| )(university|univ|institute|inst|research)( |$)') THEN 'research' WHEN {0} IS NULL THEN 'unknown' ELSE 'company' END"


def _sector(a: Column) -> Column:
    return F.when(a.isNull(), "unknown").when(a.rlike("(^| )(university|univ|institute|inst|research)( |$)"), "research").otherwise("company")


def _ap(c: Context) -> DataFrame:
    return c.applicants().where("applicant is not null").select("fam", "applicant").distinct()


_TOPA = f"SELECT applicant, {_SECTOR.format('applicant')} AS sector, families, recent, CAST(rank_ AS INTEGER) AS rank_ FROM (SELECT applicant, count(*) AS families, count(*) FILTER (WHERE year BETWEEN complete - 4 AND complete) AS recent, row_number() OVER (ORDER BY count(*) DESC, applicant) AS rank_ FROM ap JOIN fam USING (fam), lim GROUP BY applicant) WHERE rank_ <= {TOP}"


@query(f"WITH {CTX}, {_AP} {_TOPA}")
def m_top_applicants(s, d):
    c = Context(s, d)
    a = c.with_limits(_ap(c).join(c.families().select("fam", "year"), "fam"))
    n = a.groupBy("applicant").agg(_n("families"), F.count_if(F.col("year").between(F.col("complete") - 4, F.col("complete"))).alias("recent"))
    top = n.orderBy(F.desc("families"), "applicant").limit(TOP)  # ranks are given to the ten rows only
    return top.select("applicant", _sector(F.col("applicant")).alias("sector"), "families", "recent", F.row_number().over(W.orderBy(F.desc("families"), "applicant")).alias("rank_"))


query.queries["top_applicants"], query.oracle["top_applicants"] = query.queries["m_top_applicants"], query.oracle["m_top_applicants"]


@query(f"WITH {CTX}, v AS (SELECT DISTINCT year, fam.fam, {_SECTOR.format('applicant')} AS sector FROM fam LEFT JOIN fa USING (fam) WHERE year IS NOT NULL) SELECT year, sector, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY year), 6) AS share FROM v GROUP BY 1, 2")
def m_applicant_sector_share(s, d):
    c = Context(s, d)
    v = c.families().where("year is not null").select("fam", "year").join(c.applicants(), "fam", "left").select("year", "fam", _sector(F.col("applicant")).alias("sector")).distinct()
    n = v.groupBy("year", "sector").agg(_n())
    return n.select("year", "sector", "n", share(F.col("n"), F.sum("n").over(W.partitionBy("year"))).alias("share"))


@query(f"WITH {CTX}, {_AP} SELECT applicant, min(year) AS first_year FROM ap JOIN fam USING (fam), lim GROUP BY applicant, complete HAVING min(year) BETWEEN complete - 4 AND complete")
def m_newcomers(s, d):
    c = Context(s, d)
    a = _ap(c).join(c.families().select("fam", "year"), "fam").groupBy("applicant").agg(F.min("year").alias("first_year"))
    return c.with_limits(a).where("first_year between complete - 4 and complete").select("applicant", "first_year")


@query(f"WITH {CTX}, {_AP}, w AS (SELECT applicant, sum(1.0 / k) AS w, count(*) AS n FROM ap JOIN (SELECT fam, count(*) AS k FROM ap GROUP BY fam) USING (fam) GROUP BY 1), t AS (SELECT applicant FROM w ORDER BY n DESC, applicant LIMIT {TOP}) SELECT round((SELECT count(DISTINCT fam) FROM ap SEMI JOIN t USING (applicant)) / CAST((SELECT count(DISTINCT fam) FROM ap) AS DOUBLE), 6) AS top_share, round(sum(pow(w / (SELECT sum(w) FROM w), 2)) * 10000, 4) AS hhi FROM w")
def m_applicant_concentration(s, d):
    c = Context(s, d)
    ap = _ap(c)
    k = ap.groupBy("fam").agg(_n("k"))
    w = ap.join(k, "fam").groupBy("applicant").agg(F.sum(1.0 / F.col("k")).alias("w"), _n())
    total = w.agg(F.sum("w").alias("total"), F.sum(F.pow("w", F.lit(2))).alias("squares"))
    top = w.orderBy(F.desc("n"), "applicant").limit(TOP).select("applicant")
    inside = ap.join(F.broadcast(top), "applicant", "left_semi").select("fam").distinct().agg(_n("inside"))  # ten rows
    out = total.crossJoin(inside).crossJoin(k.agg(_n("families")))  # single rows
    return out.select(share(F.col("inside"), F.col("families")).alias("top_share"), F.round(F.col("squares") / F.pow("total", F.lit(2)) * 10000, 4).alias("hhi"))


@query(f"WITH {CTX}, {_AP}, n AS (SELECT inventor, count(DISTINCT fam) AS families FROM fi WHERE inventor IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {TOP}), p AS (SELECT inventor, applicant, count(DISTINCT fam) AS k FROM (SELECT DISTINCT fam, inventor FROM fi) JOIN ap USING (fam) GROUP BY 1, 2) SELECT inventor, families, (SELECT applicant FROM p WHERE p.inventor = n.inventor ORDER BY k DESC, applicant LIMIT 1) AS applicant FROM n")
def m_top_inventors(s, d):
    c = Context(s, d)
    fi = c.inventors().where("inventor is not null").select("fam", "inventor").distinct()
    top = fi.groupBy("inventor").agg(_n("families")).orderBy(F.desc("families"), "inventor").limit(TOP)
    with_ap = fi.join(F.broadcast(top), "inventor").join(_ap(c), "fam", "left").groupBy("inventor", "families", "applicant").agg(_n("k"))
    return with_ap.groupBy("inventor", "families").agg(F.min_by("applicant", F.when(F.col("applicant").isNotNull(), F.struct(-F.col("k"), F.col("applicant")))).alias("applicant"))


# ---------------------------------------------------------------- geography


@query(f"WITH {CTX} SELECT office, count(*) AS families FROM fo WHERE office <> 'WO' GROUP BY 1")
def m_families_by_filing_office(s, d):
    return Context(s, d).offices().where("office <> 'WO'").groupBy("office").agg(_n("families"))


def _by_country(people: DataFrame, every: DataFrame) -> DataFrame:
    pairs = people.where("country is not null").select("fam", "country").distinct()
    pairs = every.join(pairs, "fam", "left").withColumn("country", F.coalesce("country", F.lit("unknown")))
    k = pairs.groupBy("fam").agg(_n("k"))
    return pairs.join(k, "fam").groupBy("country").agg(_n("families"), F.round(F.sum(1.0 / F.col("k")), 4).alias("fractional"))


_BYC = "p AS (SELECT fam.fam, coalesce(country, 'unknown') AS country FROM fam LEFT JOIN (SELECT DISTINCT fam, country FROM {} WHERE country IS NOT NULL) USING (fam)) SELECT country, count(*) AS families, round(sum(1.0 / k), 4) AS fractional FROM p JOIN (SELECT fam, count(*) AS k FROM p GROUP BY 1) USING (fam) GROUP BY 1"


@query(f"WITH {CTX}, {_BYC.format('fi')}")
def m_families_by_inventor_country(s, d):
    c = Context(s, d)
    return _by_country(c.inventors(), c.docs().select("fam").distinct())


@query(f"WITH {CTX}, {_BYC.format('fa')}")
def m_families_by_applicant_country(s, d):
    c = Context(s, d)
    return _by_country(c.applicants(), c.docs().select("fam").distinct())


@query(f"WITH {CTX}, f AS (SELECT left(arg_min(p.number_raw, (p.date, p.number_raw)), 2) AS country FROM fd, unnest(priorities) AS u(p) GROUP BY fam), a AS (SELECT country, count(*) AS first_filed FROM f GROUP BY 1), b AS (SELECT office AS country, count(*) AS protected FROM fo WHERE office <> 'WO' GROUP BY 1) SELECT coalesce(a.country, b.country) AS country, coalesce(first_filed, 0) AS first_filed, coalesce(protected, 0) AS protected FROM a FULL JOIN b ON a.country = b.country")
def m_priority_vs_protection(s, d):
    c = Context(s, d)
    p = c.docs("priorities").select("fam", F.explode("priorities").alias("p"))
    first = p.groupBy("fam").agg(F.min_by("p.number_raw", F.struct("p.date", "p.number_raw")).alias("n")).groupBy(F.substring("n", 1, 2).alias("country")).agg(_n("first_filed"))
    prot = c.offices().where("office <> 'WO'").groupBy(F.col("office").alias("country")).agg(_n("protected"))
    return first.join(prot, "country", "full").select("country", F.coalesce("first_filed", F.lit(0)).alias("first_filed"), F.coalesce("protected", F.lit(0)).alias("protected"))


_RTA = "a AS (SELECT country, segment, count(*) AS n FROM (SELECT DISTINCT fam, country FROM fa WHERE country IS NOT NULL) JOIN fs USING (fam) GROUP BY 1, 2) SELECT country, segment, n, round((CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY segment)) / (CAST(sum(n) OVER (PARTITION BY country) AS DOUBLE) / sum(n) OVER ()), 6) AS rta FROM a"


@query(f"WITH {CTX}, {_RTA}")
def m_country_specialisation(s, d):
    c = Context(s, d)
    a = c.applicants().where("country is not null").select("fam", "country").distinct().join(c.segments(), "fam").groupBy("country", "segment").agg(_n())
    per = lambda *k: F.sum("n").over(W.partitionBy(*k))  # noqa: E731  a row per country and segment
    return a.select("country", "segment", "n", F.round((F.col("n").cast("double") / per("segment")) / (per("country").cast("double") / per(F.lit(1))), 6).alias("rta"))


query.queries["m_country_segment_matrix"], query.oracle["m_country_segment_matrix"] = query.queries["m_country_specialisation"], query.oracle["m_country_specialisation"]

# ---------------------------------------------------------------- segments


@query(f"WITH {CTX}, k AS (SELECT fam.fam, coalesce(segment, 'unclassified') AS segment, count(segment) OVER (PARTITION BY fam.fam) AS k FROM fam LEFT JOIN fs USING (fam)) SELECT segment, count(*) AS families, count(*) FILTER (WHERE k >= 2) AS shared FROM k GROUP BY 1")
def m_families_per_segment(s, d):
    c = Context(s, d)
    seg = c.segments()
    k = seg.groupBy("fam").agg(_n("k"))
    f = c.docs().select("fam").distinct().join(seg, "fam", "left").join(k, "fam", "left")
    return f.groupBy(F.coalesce("segment", F.lit("unclassified")).alias("segment")).agg(_n("families"), F.count_if(F.col("k") >= 2).alias("shared"))


_TREND = "SELECT segment, count(*) FILTER (WHERE year = complete - 5) AS start_n, count(*) FILTER (WHERE year = complete) AS end_n, CASE WHEN count(*) FILTER (WHERE year = complete - 5) > 0 THEN round(pow(CAST(count(*) FILTER (WHERE year = complete) AS DOUBLE) / count(*) FILTER (WHERE year = complete - 5), 0.2) - 1, 6) END AS cagr FROM fs JOIN fam USING (fam), lim GROUP BY segment"


def _trend(c: Context) -> DataFrame:
    f = c.with_limits(c.segments().join(c.families().select("fam", "year"), "fam"))
    n = f.groupBy("segment").agg(F.count_if(F.expr("year = complete - 5")).alias("start_n"), F.count_if(F.expr("year = complete")).alias("end_n"), _n("all_n"))
    return n.withColumn("cagr", F.when(F.col("start_n") > 0, F.round(F.pow(F.col("end_n").cast("double") / F.col("start_n"), F.lit(0.2)) - 1, 6)))


@query(f"""WITH {CTX}, t AS ({_TREND}), r AS (SELECT *, CASE WHEN cagr IS NOT NULL THEN CAST(rank() OVER (ORDER BY cagr DESC NULLS LAST) AS INTEGER) END AS rank FROM t)
SELECT segment, year, count(*) AS families, start_n, end_n, cagr, rank FROM fs JOIN fam USING (fam) JOIN r USING (segment), lim WHERE year BETWEEN complete - 5 AND complete GROUP BY ALL""")
def m_segment_trends(s, d):
    """Families of each segment in each of the last complete years, with its growth and its rank among the segments."""
    c = Context(s, d)
    t = _trend(c).drop("all_n")  # a row per segment
    t = t.withColumn("rank", F.when(F.col("cagr").isNotNull(), F.rank().over(W.orderBy(F.desc_nulls_last("cagr")))))
    years = c.with_limits(c.segments().join(c.families().select("fam", "year"), "fam")).where("year between complete - 5 and complete")
    return years.groupBy("segment", "year").agg(_n("families")).join(t, "segment").select("segment", "year", "families", "start_n", "end_n", "cagr", "rank")


@query(f"WITH {CTX} SELECT a.segment AS a, b.segment AS b, count(*) AS families FROM fs a JOIN fs b ON a.fam = b.fam AND a.segment < b.segment GROUP BY 1, 2")
def m_segment_cooccurrence(s, d):
    seg = Context(s, d).segments()
    b = seg.select("fam", F.col("segment").alias("b"))
    # A family has at most as many segments as there are sections, nine.
    return seg.select("fam", F.col("segment").alias("a")).join(b, "fam").where("a < b").groupBy("a", "b").agg(_n("families"))


# ---------------------------------------------------------------- families and legal status


@query(f"WITH {CTX}, o AS (SELECT fam, count(*) AS k FROM fo GROUP BY 1) SELECT 'offices' AS basis, k AS size, count(*) AS families FROM o GROUP BY 2 UNION ALL SELECT 'members', members, count(*) FROM fam GROUP BY 2")
def m_family_size_distribution(s, d):
    c = Context(s, d)
    o = c.offices().groupBy("fam").agg(_n("size")).groupBy(F.lit("offices").alias("basis"), "size").agg(_n("families"))
    return o.unionByName(c.docs().groupBy("fam").agg(_n("size")).groupBy(F.lit("members").alias("basis"), "size").agg(_n("families")))


_INTER = "count(*) AS families, round(CAST(count(ipf.fam) AS DOUBLE) / count(*), 6) AS share"


@query(f"""WITH {CTX}, ac AS (SELECT DISTINCT fam, country FROM fa WHERE country IS NOT NULL)
SELECT 'all' AS basis, NULL AS value, {_INTER} FROM fam LEFT JOIN ipf USING (fam) UNION ALL SELECT 'year', CAST(year AS VARCHAR), {_INTER} FROM fam LEFT JOIN ipf USING (fam) WHERE year IS NOT NULL GROUP BY 2
UNION ALL SELECT 'country', country, {_INTER} FROM ac LEFT JOIN ipf USING (fam) GROUP BY 2""")
def m_internationalisation_rate(s, d):
    """Share of families at two offices or more: overall, per year and per country of an applicant."""
    c = Context(s, d)
    ipf = c.international().withColumn("ipf", F.lit(1))
    f = c.families().select("fam", F.col("year").cast("string").alias("year")).join(ipf, "fam", "left")
    ac = c.applicants().where("country is not null").select("fam", "country").distinct().join(ipf, "fam", "left")
    part = lambda df, basis, v: df.groupBy(F.lit(basis).alias("basis"), v.alias("value")).agg(_n("families"), share(F.count("ipf"), F.count("*")).alias("share"))
    per = part(f, "all", F.lit(None).cast("string")).unionByName(part(f.where("year is not null"), "year", F.col("year")))
    return per.unionByName(part(ac, "country", F.col("country")))


@query(f"WITH {CTX} SELECT count(*) AS families, count(w.fam) AS with_wo, round(CAST(count(w.fam) AS DOUBLE) / count(*), 6) AS share FROM fam LEFT JOIN (SELECT fam FROM fo WHERE office = 'WO') w USING (fam)")
def m_pct_usage(s, d):
    per = Context(s, d).docs().groupBy("fam").agg(F.bool_or(F.col("office") == "WO").alias("wo"))
    return per.agg(_n("families"), F.count_if("wo").alias("with_wo"), share(F.count_if("wo"), F.count("*")).alias("share"))


@query(f"WITH {CTX} SELECT year(publication_date) AS year, coalesce(legal_status.category, 'unknown') AS category, count(*) AS n FROM fd WHERE publication_date IS NOT NULL GROUP BY CUBE (year(publication_date), coalesce(legal_status.category, 'unknown'))")
def m_legal_status_distribution(s, d):
    x = Context(s, d).docs("publication_date", "legal_status").where("publication_date is not null")
    x = x.select(F.year("publication_date").cast("bigint").alias("year"), F.coalesce("legal_status.category", F.lit("unknown")).alias("category"))
    return x.cube("year", "category").agg(_n())


_GRANTED = "count(*) AS families, round(avg(CASE WHEN granted THEN 1.0 ELSE 0.0 END), 6) AS granted_share"


@query(f"""WITH {CTX}, {_AP}, top AS (SELECT applicant FROM ap GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {TOP})
SELECT 'office' AS basis, office AS value, {_GRANTED} FROM fo JOIN fam USING (fam) GROUP BY 2 UNION ALL SELECT 'year', CAST(year AS VARCHAR), {_GRANTED} FROM fam WHERE year IS NOT NULL GROUP BY 2
UNION ALL SELECT 'applicant', applicant, {_GRANTED} FROM ap SEMI JOIN top USING (applicant) JOIN fam USING (fam) GROUP BY 2""")
def m_granted_share(s, d):
    """Share of granted families per office, per year and for the top applicants."""
    c = Context(s, d)
    f, ap = c.families().select("fam", "year", "granted"), _ap(c)
    top = ap.groupBy("applicant").count().orderBy(F.desc("count"), "applicant").limit(TOP).select("applicant")
    part = lambda df, basis, v: df.groupBy(F.lit(basis).alias("basis"), F.col(v).cast("string").alias("value")).agg(_n("families"), F.round(F.avg(F.col("granted").cast("double")), 6).alias("granted_share"))
    per = part(c.offices().join(f, "fam"), "office", "office").unionByName(part(f.where("year is not null"), "year", "year"))
    return per.unionByName(part(ap.join(F.broadcast(top), "applicant", "left_semi").join(f, "fam"), "applicant", "applicant"))


# ---------------------------------------------------------------- citations

_CITES = """cite AS (SELECT DISTINCT a.fam AS citing, b.fam AS cited, a.publication_date AS at_ FROM (SELECT fam, publication_date, unnest(backward_citations) AS c FROM fd) a JOIN (SELECT pub, fam FROM fd) b ON b.pub = a.c.publication_number WHERE a.c.kind = 'patent' AND a.fam <> b.fam),
win AS (SELECT DISTINCT citing, cited FROM cite JOIN fam ON fam.fam = cited WHERE at_ BETWEEN first_pub AND first_pub + INTERVAL 60 MONTH),
fwd AS (SELECT citing, cited FROM win w WHERE NOT EXISTS (SELECT 1 FROM fa x JOIN fa y ON x.applicant = y.applicant WHERE x.fam = w.citing AND y.fam = w.cited)),
fc AS (SELECT fam, count(citing) AS n FROM fam LEFT JOIN fwd ON cited = fam GROUP BY fam)"""


def forward(c: Context) -> DataFrame:
    """Windowed forward citations of every family without self-citations: (fam, n)."""
    src = c.docs("publication_date", "backward_citations").select(F.col("fam").alias("citing"), F.col("publication_date").alias("at"), F.explode("backward_citations").alias("c"))
    src = src.where("c.kind = 'patent'").select("citing", "at", F.col("c.publication_number").alias("pub"))
    cite = src.join(c.docs().select("pub", F.col("fam").alias("cited")), "pub").where("citing <> cited").select("citing", "cited", "at").distinct()
    fam = c.families().select(F.col("fam").alias("cited"), "first_pub")
    win = cite.join(fam, "cited").where("at between first_pub and add_months(first_pub, 60)").select("citing", "cited").distinct()
    ap = _ap(c)
    own = win.join(ap.withColumnRenamed("fam", "citing"), "citing").join(ap.withColumnRenamed("fam", "cited"), ["cited", "applicant"], "left_semi").select("citing", "cited")
    n = win.join(own, ["citing", "cited"], "left_anti").groupBy(F.col("cited").alias("fam")).agg(_n())
    return c.docs().select("fam").distinct().join(n, "fam", "left").select("fam", F.coalesce("n", F.lit(0)).alias("n"))


_BIN = "CASE WHEN n <= 2 THEN CAST(n AS VARCHAR) WHEN n <= 4 THEN '3-4' WHEN n <= 10 THEN '5-10' WHEN n <= 50 THEN '11-50' ELSE '>50' END"


@query(f"WITH {CTX}, {_CITES} SELECT {_BIN} AS bin, count(*) AS families FROM fc GROUP BY 1")
def m_forward_citations(s, d):
    n = F.col("n")
    b = F.when(n <= 2, n.cast("string")).when(n <= 4, "3-4").when(n <= 10, "5-10").when(n <= 50, "11-50").otherwise(">50")
    return forward(Context(s, d)).groupBy(b.alias("bin")).agg(_n("families"))


_PRANK = """(SELECT {v}, CASE WHEN t > 1 THEN CAST(below AS DOUBLE) / (t - 1) ELSE 0.0 END AS p FROM (SELECT {v}, coalesce(sum(m) OVER (ORDER BY {v} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(m) OVER () AS t FROM (SELECT {v}, count(*) AS m FROM {t} GROUP BY 1)))"""


def percent_rank(df: DataFrame, value: str) -> DataFrame:
    """(value, p) of every distinct value: percent_rank over the counts of values instead of a sort of all rows in one task."""
    k = df.groupBy(value).agg(_n("rows"))
    below = F.coalesce(F.sum("rows").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("rows").over(W.partitionBy(F.lit(1)))
    return k.select(value, F.when(total > 1, below.cast("double") / (total - 1)).otherwise(0.0).alias("p"))


@query(f"WITH {CTX}, {_CITES}, o AS (SELECT fam.fam, count(office) FILTER (WHERE office <> 'WO') AS k FROM fam LEFT JOIN fo USING (fam) GROUP BY 1), j AS (SELECT fc.fam, n, k FROM fc JOIN o USING (fam)) SELECT fam, round(0.5 * a.p + 0.3 * b.p + 0.2 * CASE WHEN granted THEN 1 ELSE 0 END, 6) AS score FROM j JOIN fam USING (fam) JOIN {_PRANK.format(v='n', t='j')} a USING (n) JOIN {_PRANK.format(v='k', t='j')} b USING (k)", name="key_score")
def key_score(s, d):
    c = Context(s, d)
    o = c.docs().groupBy("fam").agg(F.count_distinct(F.when(F.col("office") != "WO", F.col("office"))).alias("k"))
    j = forward(c).join(o, "fam")
    a, b = percent_rank(j, "n").withColumnRenamed("p", "pa"), percent_rank(j, "k").withColumnRenamed("p", "pb")
    out = j.join(a, "n").join(b, "k").join(c.families().select("fam", "granted"), "fam")
    return out.select("fam", F.round(0.5 * F.col("pa") + 0.3 * F.col("pb") + 0.2 * F.col("granted").cast("int"), 6).alias("score"))


@query("SELECT fam, score, CAST(row_number() OVER (ORDER BY score DESC, first_date NULLS LAST, fam) AS INTEGER) AS rank FROM (" + query.oracle["key_score"].replace("SELECT fam, round(0.5", "SELECT fam, first_date, round(0.5") + f") ORDER BY rank LIMIT {5 * TOP}")
def m_key_patent_score(s, d):
    """The families of highest score; ties go to the earlier first date, then the family key."""
    scored = key_score(s, d).join(Context(s, d).families().select("fam", "first_date"), "fam")
    best = scored.orderBy(F.desc("score"), F.asc_nulls_last("first_date"), "fam").limit(5 * TOP)  # the feature: a ranking
    rank = F.row_number().over(W.orderBy(F.desc("score"), F.asc_nulls_last("first_date"), "fam"))
    return best.select("fam", "score", rank.alias("rank"))


@query(f"WITH {CTX} SELECT office, count(*) AS citations, round(avg(CASE WHEN c.kind = 'npl' THEN 1.0 ELSE 0.0 END), 6) AS npl_share FROM fd, unnest(backward_citations) AS u(c) GROUP BY 1")
def m_npl_citation_share(s, d):
    b = latest(s, d, "backward_citations").select("office", F.explode("backward_citations.kind").alias("kind"))
    return b.groupBy("office").agg(_n("citations"), F.round(F.avg((F.col("kind") == "npl").cast("double")), 6).alias("npl_share"))


@query(f"WITH {CTX}, {_CITES}, {_AP} SELECT applicant, count(*) AS families, round(avg(n), 6) AS citations, round(avg(date_diff('day', first_date, newest) / 365.25), 4) AS age, count(*) FILTER (WHERE granted) AS granted FROM ap JOIN fam USING (fam) JOIN fc USING (fam), lim GROUP BY 1 HAVING count(*) >= 3")
def m_portfolio_strength(s, d):
    c = Context(s, d)
    f = c.with_limits(_ap(c).join(c.families().select("fam", "first_date", "granted"), "fam").join(forward(c), "fam"))
    age = F.round(F.avg(F.datediff("newest", "first_date") / 365.25), 4)
    return f.groupBy("applicant").agg(_n("families"), F.round(F.avg("n"), 6).alias("citations"), age.alias("age"), F.count_if("granted").alias("granted")).where("families >= 3")


# ---------------------------------------------------------------- matrices, codes, white space, map


@query(f"WITH {CTX}, {_AP}, t AS (SELECT applicant, count(*) AS all_n FROM ap GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {TOP}) SELECT applicant, segment, count(*) AS families, round(CAST(count(*) AS DOUBLE) / all_n, 6) AS portfolio_share FROM t JOIN ap USING (applicant) JOIN fs USING (fam) GROUP BY applicant, segment, all_n")
def m_applicant_segment_matrix(s, d):
    c = Context(s, d)
    ap = _ap(c)
    top = ap.groupBy("applicant").agg(_n("all_n")).orderBy(F.desc("all_n"), "applicant").limit(TOP)
    m = ap.join(F.broadcast(top), "applicant").join(c.segments(), "fam").groupBy("applicant", "segment", "all_n").agg(_n("families"))
    return m.select("applicant", "segment", "families", share(F.col("families"), F.col("all_n")).alias("portfolio_share"))


_PAIRS = "SELECT x.applicant AS a, y.applicant AS b, count(*) AS families FROM ap x JOIN ap y ON x.fam = y.fam AND x.applicant < y.applicant GROUP BY 1, 2"


@query(f"WITH {CTX}, {_AP} {_PAIRS}")
def co_occurrence_pairs(s, d):
    ap = _ap(Context(s, d))
    return ap.select("fam", F.col("applicant").alias("a")).join(ap.select("fam", F.col("applicant").alias("b")), "fam").where("a < b").groupBy("a", "b").agg(_n("families"))


@query(f"WITH {CTX}, {_AP} SELECT * FROM ({_PAIRS}) WHERE families >= 2")
def m_co_applicant_network(s, d):
    return co_occurrence_pairs(s, d).where("families >= 2")


@query(f"WITH {CTX}, c AS (SELECT DISTINCT fam, u.c.code AS code FROM fd, unnest(cpc) AS u(c)), n AS (SELECT code, count(*) AS families, count(*) FILTER (WHERE year BETWEEN complete - 4 AND complete) AS recent FROM c JOIN fam USING (fam), lim GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), t AS (SELECT symbol, arg_max(title, scheme_version) AS title FROM cpc_entry WHERE title IS NOT NULL GROUP BY 1) SELECT code, families, recent, title, left(code, 1) = 'A' OR starts_with(code, 'G06N') AS search_code FROM n LEFT JOIN t ON symbol = code")
def m_top_classification_codes(s, d):
    c = Context(s, d)
    code = c.docs("cpc").select("fam", F.explode("cpc.code").alias("code")).distinct()
    f = c.with_limits(code.join(c.families().select("fam", "year"), "fam"))
    top = f.groupBy("code").agg(_n("families"), F.count_if(F.col("year").between(F.col("complete") - 4, F.col("complete"))).alias("recent")).orderBy(F.desc("families"), "code").limit(20)
    titles = table(s, d, "cpc_entry").where("title is not null").groupBy(F.col("symbol").alias("code")).agg(F.max_by("title", "scheme_version").alias("title"))
    return top.join(titles, "code", "left").select("code", "families", "recent", "title", (F.col("code").startswith("A") | F.col("code").startswith("G06N")).alias("search_code"))


@query(f"""WITH {CTX}, {_AP}, t AS ({_TREND}), n AS (SELECT segment, count(*) AS families FROM fs GROUP BY 1),
top AS (SELECT applicant FROM ap GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {TOP}), cov AS (SELECT DISTINCT segment, applicant FROM ap SEMI JOIN top USING (applicant) JOIN fs USING (fam)),
pairs AS (SELECT x.segment AS a, y.segment AS b, count(*) AS k FROM fs x JOIN fs y ON x.fam = y.fam AND x.segment < y.segment GROUP BY 1, 2)
SELECT 'small and growing' AS indicator, segment AS a, NULL AS b, families AS n FROM n JOIN t USING (segment) WHERE families <= (SELECT median(families) FROM n) AND cagr > 0
UNION ALL SELECT 'not covered', segment, applicant, 0 FROM n, top WHERE NOT EXISTS (SELECT 1 FROM cov WHERE cov.segment = n.segment AND cov.applicant = top.applicant)
UNION ALL SELECT 'rare pair', a, b, k FROM pairs WHERE k <= (SELECT quantile_disc(k, 0.25) FROM pairs)""")
def m_white_space_indicators(s, d):
    """Small segments that grow, top applicants missing in a segment, and the rarest quarter of pairs of segments."""
    c = Context(s, d)
    t, ap, seg = Scratch(s, "white").save(_trend(c)), _ap(c), c.segments()  # a row per segment
    mid = t.agg(F.median("all_n").alias("mid"))
    none = F.lit(None).cast("string")
    small = t.crossJoin(F.broadcast(mid)).where("all_n <= mid and cagr > 0").select(F.lit("small and growing").alias("indicator"), F.col("segment").alias("a"), none.alias("b"), F.col("all_n").alias("n"))
    top = ap.groupBy("applicant").count().orderBy(F.desc("count"), "applicant").limit(TOP).select("applicant")
    covered = ap.join(F.broadcast(top), "applicant", "left_semi").join(seg, "fam").select("segment", "applicant").distinct()
    cells = t.select("segment").crossJoin(F.broadcast(top))  # nine segments beside ten applicants
    gaps = cells.join(covered, ["segment", "applicant"], "left_anti").select(F.lit("not covered").alias("indicator"), F.col("segment").alias("a"), F.col("applicant").alias("b"), F.lit(0).cast("bigint").alias("n"))
    pairs = seg.select("fam", F.col("segment").alias("a")).join(seg.select("fam", F.col("segment").alias("b")), "fam").where("a < b").groupBy("a", "b").agg(_n())
    low = pairs.withColumn("k", F.ceil(F.count("*").over(W.partitionBy(F.lit(1))) * 0.25)).withColumn("r", F.row_number().over(W.orderBy("n"))).where("r = greatest(k, 1)").select(F.col("n").alias("low"))  # 36 pairs at most
    rare = pairs.crossJoin(F.broadcast(low)).where("n <= low").select(F.lit("rare pair").alias("indicator"), "a", "b", "n")
    return small.unionByName(gaps).unionByName(rare)


@query()
def m_landscape_map_coordinates(s, d):
    """Two principal components of the embeddings and ten clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(s, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    flat = PCA(k=2, inputCol="v", outputCol="xy").fit(e).transform(e)
    seen = KMeans(k=10, seed=1, featuresCol="v", predictionCol="cluster").fit(flat).transform(flat)
    xy = vector_to_array("xy")
    return seen.select("vec_id", F.round(xy[0], 6).alias("x"), F.round(xy[1], 6).alias("y"), "cluster")


QUERIES, ORACLE = query.queries, query.oracle
