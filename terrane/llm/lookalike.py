"""One consistent form for text that looks the same but is written in different characters.

A text is brought to compatibility form (full-width and half-width forms, ligatures, mathematical letters,
odd spaces and hyphens become the usual characters, a letter with combining marks becomes the one letter),
signs that can't be seen are deleted, and every token that holds look-alike letters is read as a lattice:
each letter may stand for itself or for the letters of other scripts it looks like. Viterbi finds the reading
of highest score under character bigrams of Latin, Cyrillic, Greek and Armenian tokens written in one script, counted
over the whole corpus (a script that doesn't occur in it is nobody's reading), with a price for each change of script inside a token and for each letter replaced,
and a leaning to the script of the rest of the text.

A token is a run of letters of these scripts, whatever stands beside it. Letters and signs used as themselves stay:
other scripts, superscripts, fractions, circled numbers, the micro sign and other signs that aren't letters or digits, accented letters, Greek letters that stand alone
beside a hyphen, slash, digit or the end of a compound as symbols, full-width punctuation in CJK text.

Defined results: null stays null; empty and blank texts are no cases and stay as they are apart from odd
spaces; texts of any length are read whole; a row delivered twice comes out once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.runtime import Scratch

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝ", "ABESIJKMHOPCTYXaesijopcyxdhqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ", "ABEZHIKMNOPTYXaikvopux"))
ARMENIAN = dict(zip("ՕՍՏԼօսհոցզյ", "OUSLouhngqj"))
SCRIPTS = ("L", "C", "G", "A")
ODD_SPACE = re.compile("[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ODD_HYPHEN = re.compile("[\u2010\u2011\ufe63]")
CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]")
# Kinds of compatibility forms that are read as what they look like; of the general kind only letters and numerals,
# but not those that are the usual letters of their script (Thai and Lao vowels, Korean letters) or the micro sign.
FORM_KINDS = ("<wide>", "<narrow>", "<font>", "<vertical>", "<isolated>", "<initial>", "<medial>", "<final>")
OWN = re.compile("[\u00b5\u0e33\u0eb3\u0edc\u0edd\u3131-\u318e\u1100-\u11ff]")
WIDE_MARKS = re.compile("[\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\u3000]")
WORD = re.compile(r"[^\W\d_]+")
REPLACED, CROSSED, LEANING = 1.5, 14.0, 5.0


def _other_ways() -> dict[str, dict[str, str]]:
    """letter -> script -> the letter of that script it may stand for."""
    ways: dict[str, dict[str, str]] = {}
    for script, pairs in (("C", CYRILLIC), ("G", GREEK), ("A", ARMENIAN)):
        for theirs, latin in pairs.items():
            ways.setdefault(theirs, {script: theirs})["L"] = latin
            ways.setdefault(latin, {"L": latin}).setdefault(script, theirs)
    tables = {"C": CYRILLIC, "G": GREEK, "A": ARMENIAN}
    for script, pairs in tables.items():
        for other, others in tables.items():
            back = {v: k for k, v in others.items()}
            for theirs, latin in pairs.items():
                if other != script and latin in back:
                    ways[theirs].setdefault(other, back[latin])
    return ways


WAYS = _other_ways()


def script(ch: str) -> str:
    c = ord(ch)
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return "L"
    if 0x400 <= c < 0x530:
        return "C"
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return "G"
    if 0x530 <= c < 0x590:
        return "A"
    return "-"


@lru_cache(65536)
def plain_form(ch: str) -> str:
    """What a compatibility form looks like; a sign with a meaning of its own is itself."""
    kind = unicodedata.decomposition(ch).split(" ", 1)[0]
    if not kind.startswith("<") or OWN.match(ch):
        return ch
    plain = unicodedata.normalize("NFKC", ch)
    if kind in FORM_KINDS or kind == "<compat>" and unicodedata.category(ch)[0] in "LN" and plain.isalnum():
        return plain
    return ch


def visible(text: str) -> str:
    """Compatibility form without ignorable signs."""
    wide = len(CJK.findall(text)) > 0
    out = []
    for ch in text:
        cat = unicodedata.category(ch)
        if cat == "Cf" or ch == "\u034f" or "\ufe00" <= ch <= "\ufe0f" or (cat == "Cc" and ch not in "\t\n\r\x0b\x0c"):
            continue
        if wide and WIDE_MARKS.match(ch):
            out.append(ch)
        elif ODD_SPACE.match(ch):
            out.append(" ")
        elif ODD_HYPHEN.match(ch):
            out.append("-")
        else:
            out.append(plain_form(ch) if ch > "\x7f" else ch)
    return unicodedata.normalize("NFC", "".join(out))


class Reader:
    """Reads texts under bigram counts {(first, second): n} of lower-case letters, "^" and "$" at the ends."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.first: dict[str, int] = {}
        self.size: dict[str, int] = {s: 1 for s in SCRIPTS}
        self.pair: dict[tuple[str, str, str], int] = {}
        for (a, b), n in counts.items():
            s = script(b if a == "^" else a)
            if s == "-":
                continue
            self.pair[s, a, b] = self.pair.get((s, a, b), 0) + n
            self.first[s + a] = self.first.get(s + a, 0) + n
        heard = {s for s, _, _ in self.pair}
        self.ways = {ch: {s: w for s, w in ways.items() if s in heard or w == ch} for ch, ways in WAYS.items()}
        self.memory: dict[tuple[str, str], str] = {}

    def score(self, s: str, a: str, b: str) -> float:
        return math.log((self.pair.get((s, a, b), 0) + 0.05) / (self.first.get(s + a, 0) + 5.0))

    def token(self, token: str, lean: str) -> str:
        known = self.memory.get((token, lean))
        if known is not None:
            return known
        best: dict[str, tuple[float, str]] = {}
        for i, ch in enumerate(token):
            ways = self.ways.get(ch) or {script(ch): ch}
            now: dict[str, tuple[float, str]] = {}
            for s, way in ways.items():
                cost = -REPLACED if way != ch else 0.0
                if s == lean:
                    cost += LEANING / len(token)
                low = way.lower()
                if i == 0:
                    now[s] = (cost + self.score(s, "^", low), way)
                    continue
                last = max(
                    ((v - (CROSSED if p != s else 0.0) + self.score(s, r[-1].lower(), low), r) for p, (v, r) in best.items()),
                    key=lambda x: x[0],
                )
                now[s] = (cost + last[0], last[1] + way)
            best = now
        out = max(((v + self.score(s, r[-1].lower(), "$"), r) for s, (v, r) in best.items()), key=lambda x: x[0])[1]
        if len(self.memory) > 200_000:
            self.memory.clear()
        self.memory[token, lean] = out
        return out

    def text(self, text: str) -> str:
        seen = visible(text)
        if seen.isascii():
            return seen
        anchors = {s: 0 for s in SCRIPTS}
        for ch in seen:
            if ch.isalpha() and ch not in WAYS and script(ch) in anchors:
                anchors[script(ch)] += 1
        out, at = [], 0
        for start, word in self._tokens(seen):
            if not any(ch in WAYS for ch in word) or (word.isascii() and not anchors["C"] and not anchors["G"] and not anchors["A"]):
                continue
            if len(word) == 1 and script(word) == "G" and self._symbol(seen, start, start + 1):
                continue
            own = {s: sum(ch.isalpha() and ch not in WAYS and script(ch) == s for ch in word) for s in SCRIPTS}
            rest = {s: anchors[s] - own[s] for s in SCRIPTS}
            lean = max(SCRIPTS, key=lambda s: rest[s]) if any(rest.values()) else ""
            out.append(seen[at:start])
            out.append(self.token(word, lean))
            at = start + len(word)
        out.append(seen[at:])
        return "".join(out)

    @staticmethod
    def _tokens(text: str) -> Iterator[tuple[int, str]]:
        """Runs of letters of the scripts that are read, with where they begin."""
        for m in WORD.finditer(text):
            at = m.start()
            for known, run in groupby(m.group(), key=lambda ch: script(ch) != "-"):
                run = "".join(run)
                if known:
                    yield at, run
                at += len(run)

    @staticmethod
    def _symbol(text: str, a: int, b: int) -> bool:
        """A single Greek letter joined to something by a hyphen, slash or digit."""
        near = (text[a - 1] if a else "") + (text[b] if b < len(text) else "")
        return any(ch in "-–/" or ch.isdigit() for ch in near)


def fields(documents: DataFrame) -> DataFrame:
    """document_id, field_name, position and text of titles and applicants' names that aren't plain ASCII."""
    docs = documents.where("document_id is not null").select("document_id", "title", "applicants.name_raw")
    title = docs.select("document_id", F.lit("title").alias("field_name"), F.lit(0).alias("position"), F.col("title").alias("text"))
    names = docs.select("document_id", F.lit("applicants").alias("field_name"), F.posexplode("name_raw").alias("position", "text"))
    return title.unionByName(names).where(F.col("text").isNotNull())


def bigrams(texts: DataFrame) -> DataFrame:
    """Counts of letter pairs in tokens of one script. At most a row per pair of letters of the four alphabets."""
    token = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}]+"), F.lit(0))).alias("t"))
    token = token.groupBy("t").agg(F.count("*").alias("n")).where(F.col("t").rlike(r"^(\p{IsLatin}+|\p{IsCyrillic}+|\p{IsGreek}+|\p{IsArmenian}+)$"))
    framed = token.select(F.concat(F.lit("^"), F.lower("t"), F.lit("$")).alias("t"), "n")
    pairs = framed.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.col("t").substr(i, F.lit(2)))).alias("g"), "n")
    return pairs.groupBy("g").agg(F.sum("n").alias("n"))


def normalized(documents: DataFrame) -> DataFrame:
    """document_id, field_name, position, text, normal of every text whose normal form differs."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "lookalike")
    all_texts = scratch.save(fields(documents).distinct())
    # The alphabets bound the table: fewer than 1,000 letters, so fewer than 10^6 pairs, a few thousand in practice.
    counts = {(g[0], g[1:]): n for g, n in bigrams(all_texts).collect() if len(g) == 2}
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in batches:
            new = [reader.text(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], [*b.schema.names, "normal"])

    odd = all_texts.where(F.col("text").rlike(r"[^\x00-\x7f]"))
    shape = "document_id string, field_name string, position int, text string, normal string"
    return odd.mapInArrow(run, shape).where("text <> normal")


def found(documents: DataFrame) -> DataFrame:
    """p3_found: document_id, field_name."""
    return normalized(documents).where(F.col("text").rlike(r"[^\s\p{Z}]")).select("document_id", "field_name").distinct()
