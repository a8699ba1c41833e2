"""Texts cut off before their end, found by word trigrams inside texts versus at ends, in SQL.

Every distinct text becomes lower-case words (a CJK sign is a word, a number is ``0``, a sentence end is
``.``). Over the whole corpus each trigram is counted where the sentence goes on, where a sentence ends, and
where the text ends, per kind of section. The final trigram of a text is then looked up three ways:

whole     it occurs, the sentence nearly always goes on after it, and it hardly ever ends one;
partial   its last word is hardly ever a word there, while longer words that begin with it are;
open      neither is known, but after its first two words no sentence ever ends.

Where the three words before the last two are known (two overlapping trigrams), that longer context decides, else the
trigram alone. Contexts are counted under their 64-bit hash, the words after them as themselves.

Marks a transfer leaves behind a cut (an ellipsis, half a tag or entity, white space, quotes) are taken off
first; what a complete text ends with otherwise is ordinary text and is judged by the same counts.

Defined results: null, empty, blank texts and texts without a word are no cases; a text repeated under other
ids counts once in the statistics and is judged for every id; null source and section are values of their
own; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.runtime import Scratch

# Parameters: least count that decides, and the share of ends up to which a trigram counts as "almost never terminal".
# Titles, which end without a mark and in many ways, need four times the count and a sixth of the share, unless the last
# word alone, over all titles, hardly ever ends one, or is never a word inside one.
LEAST = 5
ENDS = 0.03
OPEN_LEAST = 20

# Possessive throughout: no pattern looks twice at a run of signs, however long it is.
CJK = r"\u3005\u3007\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}"
SIGN_WORD = r"|[.!?](?=[\s\"”»)\]]|$)|[0-9]++(?:[.,][0-9]++)*+|[%;。！？]"
WORD = r"[\p{L}\p{M}]++(?:-[0-9]++)?+" + SIGN_WORD
CJK_WORD = rf"[a-z\p{{L}}\p{{M}}&&[^{CJK}]]++(?:-[0-9]++)?+{SIGN_WORD}|[{CJK}]"
SIGNS = r"\s\"'”»」』)…"
BEHIND = rf"(?<![{SIGNS}])(?:[{SIGNS}]|\.\.\.|\[(?:\.\.\.|…)\]|&#?+[A-Za-z0-9]{{0,31}}+|\\(?:u[0-9A-Fa-f]{{0,4}}+|[nrt])?+|</?+(?:[A-Za-z][^<>]*+)?+)++$"
MARKUP = r"\\[nrt](?![A-Za-z])|&(?:[A-Za-z]++|#[0-9]++);|</?+[A-Za-z][^<>]*+>"

WORDS_SQL = """
WITH said AS (
  SELECT kind, h, n, text, contains(text, '&') OR contains(text, '<') OR contains(text, chr(92)) AS marked FROM {texts}
), plain AS (
  SELECT kind, h, n, marked, lower(CASE WHEN marked THEN regexp_replace(text, :markup, ' ') ELSE text END) AS text FROM said
), bare AS (
  SELECT kind, h, n, CASE WHEN marked OR endswith(text, '...') OR right(text, 1) RLIKE :last THEN regexp_replace(text, :behind, '') ELSE text END AS text FROM plain
), raw AS (
  SELECT kind, h, n, CASE WHEN octet_length(text) > length(text) AND text RLIKE :cjk THEN regexp_extract_all(text, :cjk_word, 0) ELSE regexp_extract_all(text, :word, 0) END AS raw FROM bare
)
SELECT kind, h, n, concat(array('^', '^', '^', '^'), transform(CASE WHEN kind = 'signs' THEN raw ELSE array_remove(raw, ';') END,
         x -> CASE WHEN x IN ('!', '?', '。', '！', '？', ';') THEN '.' WHEN contains(x, '-') THEN '@' WHEN x >= '0' AND x < ':' THEN '0' ELSE x END)) AS w
FROM raw
"""

# The words before a place as hashes: a trigram's, and up to two more, which never reach into the sentence before.
NEAR = "xxhash64(kind, a, b)"
FAR = "xxhash64(kind, CASE WHEN a = '.' OR e = '.' THEN '' ELSE d END, CASE WHEN a = '.' THEN '' ELSE e END, a, b)"

# Every place of every text with the words around it; the last one is the end of the text.
COUNTS_SQL = f"""
WITH place AS (
  SELECT kind, d, e, a, b, c, next FROM (SELECT kind, w, size(w) - 4 AS m FROM {{words}} WHERE size(w) > 4)
  LATERAL VIEW inline(arrays_zip(slice(w, 1, m), slice(w, 2, m), slice(w, 3, m), slice(w, 4, m), slice(w, 5, m), concat(slice(w, 6, m - 1), array('$')))) AS d, e, a, b, c, next
)
SELECT far, near, c, count_if(next <> '.' AND next <> '$') AS goes_on, count_if(next = '.') AS ends, count_if(next = '$') AS last
FROM (SELECT {FAR} AS far, {NEAR} AS near, c, next FROM place) GROUP BY far, near, c
"""

FINAL_SQL = f"""
SELECT kind, h, n, {FAR} AS far, {NEAR} AS near, c, b = '0' AS number
FROM (SELECT kind, h, n, w[size(w) - 5] AS d, w[size(w) - 4] AS e, w[size(w) - 3] AS a, w[size(w) - 2] AS b, w[size(w) - 1] AS c FROM {{words}} WHERE size(w) > 4)
"""

# Only what follows the first words of some final is looked up later.
ASKED_SQL = "SELECT c.* FROM {counts} c LEFT SEMI JOIN {finals} f ON c.near = f.near"
SUMS = "sum(goes_on) AS goes_on, sum(ends) AS ends, sum(last) AS last"
BY_REACH = {
    "near": f"SELECT near AS x, c, {SUMS} FROM {{counts}} GROUP BY near, c",
    "far": "SELECT c.far AS x, c.c, goes_on, ends, last FROM {counts} c LEFT SEMI JOIN {finals} f ON c.far = f.far",
}

# Counts of all words after the first two of a final, and of those that are longer than its last word and begin with it.
OPEN_SQL = f"SELECT x, {SUMS} FROM {{counts}} GROUP BY x"
BEGIN_SQL = f"""
WITH begun AS (SELECT x, explode(transform(sequence(1, length(c) - 1), n -> substring(c, 1, n))) AS c, goes_on, ends, last FROM {{counts}} WHERE length(c) > 1)
SELECT begun.x, begun.c, {SUMS} FROM begun LEFT SEMI JOIN {{finals}} f ON begun.x = f.x AND begun.c = f.c GROUP BY begun.x, begun.c
"""

# How often each word ends a title, whatever stands before it.
TITLE_WORDS_SQL = """
SELECT c, count_if(NOT at_end) AS goes_on, count_if(at_end) AS last
FROM (SELECT inline(transform(slice(w, 5, size(w) - 4), (x, i) -> named_struct('c', x, 'at_end', i = size(w) - 5))) FROM {words} WHERE kind = 'title' AND size(w) > 4)
GROUP BY c
"""

JUDGED_SQL = """
SELECT f.kind, f.x, f.c, w.goes_on + w.ends + w.last - 1 AS known,
  CASE
    WHEN f.c = '.' THEN
      CASE WHEN w.goes_on >= 20 * :least AND f.number AND w.last <= 0.01 * w.goes_on THEN 'whole' END
    WHEN w.goes_on >= CASE f.kind WHEN 'title' THEN 4 ELSE 1 END * :least AND w.ends <= :ends * w.goes_on
         AND w.last - 1 <= CASE f.kind WHEN 'title' THEN :ends / 6 ELSE 4 * :ends END * w.goes_on THEN 'whole'
    WHEN f.kind = 'title' AND w.goes_on >= :least AND w.ends <= :ends * w.goes_on AND w.last - 1 <= 4 * :ends * w.goes_on AND v.last <= :ends * v.goes_on THEN 'whole'
    WHEN f.kind = 'title' AND p.goes_on + p.ends + p.last >= :least AND v.goes_on = 0 AND w.last <= p.goes_on + p.ends + p.last THEN 'partial'
    WHEN p.goes_on + p.ends + p.last >= :least AND w.goes_on + w.ends <= :ends * (p.goes_on + p.ends + p.last)
         AND w.last <= 0.3 * (p.goes_on + p.ends + p.last) THEN 'partial'
    WHEN w.goes_on + w.ends + w.last + coalesce(p.goes_on + p.ends + p.last, 0) < :least AND o.goes_on >= :open_least
         AND o.ends + o.last <= :ends * o.goes_on THEN 'open'
  END AS cut
FROM {finals} f
JOIN {counts} w ON f.x = w.x AND f.c = w.c
LEFT JOIN {begun} p ON f.x = p.x AND f.c = p.c
LEFT JOIN {open} o ON f.x = o.x
LEFT JOIN {title_words} v ON f.c = v.c
"""

KIND_SQL = """
SELECT doc_id, source, text,
       CASE lower(trim(section)) WHEN 'title' THEN 'title' WHEN 'signs' THEN 'signs' WHEN 'claim' THEN 'claim' ELSE 'prose' END AS kind
FROM {documents} WHERE text RLIKE :letter
"""


def judged(documents: DataFrame, least: int = LEAST, ends: float = ENDS, open_least: int = OPEN_LEAST) -> DataFrame:
    """doc_id, source and how the text was seen to be cut (null: complete) of every text with a word."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "cutoff")
    docs = spark.sql(KIND_SQL, {"letter": r"[\p{L}\p{N}]"}, documents=documents.select("doc_id", "source", "text", "section"))
    texts = docs.groupBy("kind", "text").agg(F.count("*").alias("many")).selectExpr("kind", "text", "xxhash64(text) AS h", "length(text) AS n")
    # Written before anything is asked of them: a condition on the words would be computed below the aggregate too.
    patterns = {"word": WORD, "cjk_word": CJK_WORD, "cjk": f"[{CJK}]", "behind": BEHIND, "markup": MARKUP, "last": rf"[{SIGNS}\]]"}
    words = scratch.save(spark.sql(WORDS_SQL, patterns, texts=texts))
    finals = scratch.save(spark.sql(FINAL_SQL, words=words))
    asked = scratch.save(spark.sql(ASKED_SQL, counts=spark.sql(COUNTS_SQL, words=words), finals=finals))
    title_words = scratch.save(spark.sql(TITLE_WORDS_SQL, words=words))
    scratch.drop(words)
    out = finals
    for reach in ("near", "far"):
        counts = scratch.save(spark.sql(BY_REACH[reach], counts=asked, finals=finals))
        final = scratch.save(finals.select("kind", F.col(reach).alias("x"), "c", "number").distinct())
        begun, opened = spark.sql(BEGIN_SQL, counts=counts, finals=final), spark.sql(OPEN_SQL, counts=counts)
        says = spark.sql(JUDGED_SQL, {"least": least, "ends": ends, "open_least": open_least}, finals=final, counts=counts, begun=begun, open=opened, title_words=title_words)
        says = says.select("kind", F.col("x").alias(reach), "c", F.col("cut").alias(f"cut_{reach}"), F.col("known").alias(f"known_{reach}"))
        out = out.join(says, ["kind", reach, "c"])
    # The longer context decides where it is known at all, else the trigram.
    cut = out.selectExpr("kind", "h", "n", f"CASE WHEN cut_far IS NOT NULL THEN cut_far WHEN known_far >= {least} THEN NULL ELSE cut_near END AS cut").where("cut is not null")
    rows = docs.selectExpr("doc_id", "source", "kind", "xxhash64(text) AS h", "length(text) AS n")
    return rows.join(scratch.save(cut), ["kind", "h", "n"], "left").select("doc_id", "source", "cut")


def found(documents: DataFrame) -> DataFrame:
    """p9_found: doc_id."""
    return judged(documents).where("cut is not null").select("doc_id").distinct()


def by_source(documents: DataFrame) -> DataFrame:
    """Share of cut texts for each source; a document counts once."""
    rows = judged(documents).groupBy("source", "doc_id").agg({"cut": "max"}).withColumnRenamed("max(cut)", "cut")
    return rows.selectExpr("source", "cut").groupBy("source").agg({"*": "count", "cut": "count"}).selectExpr(
        "source", "`count(1)` AS n_texts", "`count(cut)` AS n_cut", "`count(cut)` / `count(1)` AS cut_share"
    )
