"""Variant spellings of the names of persons and organisations, linked by a trie join.

A raw name is cut into words; legal forms, titles, bracketed additions, case, accents and separators go. What the
other words are is learned from the names themselves: a word that stands beside many different words and often with
a legal form tells a trade, one that stands beside many and never with a legal form is a given name. A trade may be
shortened (its beginning, its consonants, another ending of its stem); of several readings the one holds whose
trades occur together most often in full. A name with a legal form or a trade is an organisation, one with a title,
a comma, an initial or a given name a person, one word alone an organisation, and all others are read both ways.

Keys are walked as written and once more with one letter for letters that sound alike. The order of the parts doesn't count: a name is walked in every order of its words (of more than four: each word
first, the others sorted, so that an error within a word is still found), those of a person within surname and given
names if it's told which is which. Trade and legal form aren't part of the key, but names of two trades never link.
Keys of one trade make tries, dealt by length and by two thirds of the key: an error leaves two of the three thirds
whole, so two keys within one error meet in a shard. Each key walks the trie as a Levenshtein automaton (a swap of
neighbours is one error); keys of fewer than MINIMUM letters must be equal. A shard with too many keys is dealt once
more by the keys less one letter, of which two neighbours share one, so a common surname never makes one task.
Names with a shortened word walk the trie as a prefix whose nodes know the least and greatest entity below them, so
nothing is listed; names with initials only are tied to the one person they can mean, by surname, initial and, if
several persons are left, middle initial. Where more than one is left, they are tied to none. Alias groups tie the
entities their names belong to.

Defined results: null and blank names, and names without a letter, form no pair; equal spellings under other
name_ids are pairs; a row delivered twice counts once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import permutations, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm.forest import connected_groups
from terrane.llm.lookalike import CYRILLIC, GREEK, visible
from terrane.runtime import Scratch

# Legal forms, titles and words without meaning in a name, in lower case without points.
LEGAL = set(
    "co company ltd limited inc incorporated corp corporation llc lp llp plc gmbh ag kg kgaa mbh ohg ug se aktiengesellschaft gesellschaft "
    "sa sas sarl srl spa scarl ab aktiebolag hb as asa aps oy oyj nv bv vof naamloze vennootschap besloten kk kabushiki kaisha yk gk "
    "pvt private pte pty sdn bhd jsc ooo oao zao pjsc public ооо оао зао пао ао".split()
)
TITLES = set("dr prof professor dipl ing mr mrs ms phd mag herr frau sir".split())
EMPTY = set("the of and und et de der die das for fuer".split())
# Everyday words of business names. They only help where a corpus is too small to learn from.
TRADES = set(
    "aerospace agriculture automotive aviation bank biosciences biotech brewing cement ceramics chemicals clinic communications computers construction "
    "consulting cosmetics dairy design devices diagnostics electric electronics energy engineering enterprises entertainment finance foods foundation "
    "furniture gas genetics glass global group healthcare holdings hospital industries innovation institute instruments insurance international laboratories "
    "logistics machinery manufacturing marine materials media medical metals mining mobile motors networks nuclear oil optics packaging paper partners "
    "petroleum pharmaceuticals plastics power printing products properties railways research robotics rubber school semiconductors services shipbuilding "
    "software solar solutions sons steel studios systems technologies telecom textiles therapeutics tobacco tools toys transport university ventures works".split()
)
# Common given names and short forms in use for them.
GIVEN = {
    "alexander": "sasha alex alec sandy xander", "andrew": "drew andy", "anthony": "tony", "benjamin": "ben", "catherine": "cathy", "charles": "charlie chuck",
    "christopher": "chris kit", "daniel": "dan danny", "david": "dave", "dorothea": "dora thea dorothy dot", "edward": "ned ted eddie ed", "elizabeth": "liz beth betty lisa eliza",
    "francisco": "paco pancho", "frederick": "fred", "gabriel": "gabe", "george": "", "giuseppe": "beppe peppe", "gregory": "greg", "isabella": "bella izzy", "james": "jim jimmy",
    "johannes": "hans johann", "john": "jack", "joseph": "joe joey", "katherine": "kate katie kathy", "lawrence": "larry", "margaret": "peggy maggie meg", "matthew": "matt",
    "michael": "mike mick", "nicholas": "nick", "nikolaus": "klaus niko", "oliver": "ollie", "patricia": "pat", "peter": "pete", "richard": "dick rick rich", "robert": "bob rob bobby",
    "samuel": "sam", "stephen": "steve", "susanna": "sanne susie sue", "theodore": "theo teddy", "thomas": "tom tommy", "ulrike": "ulli", "veronica": "ronnie vera",
    "victoria": "vicky", "william": "bill will billy", "yevgenia": "zhenya", "ekaterina": "katya", "dmitri": "dima", "vladimir": "volodya", "guillermo": "memo", "jose": "pepe",
}
NICK: dict[str, str] = {}
for _full, _shorts in GIVEN.items():
    for _short in (_full, *_shorts.split()):
        NICK.setdefault(_short, _full)
# "Ted" names more than one: it stays open until the surname decides.
OPEN_NICKS = {"ted": ("theodore", "edward")}
LOOKS = str.maketrans({**CYRILLIC, **GREEK})
PLAIN = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "ø": "oe", "å": "aa", "œ": "oe", "ł": "l", "đ": "d"})
# Letters that sound alike, in the order in which they are replaced; then doubled letters are one.
SOUNDS = (("sch", "sh"), ("ph", "f"), ("ck", "k"), ("ae", "e"), ("oe", "o"), ("ue", "u"), ("ou", "u"), ("w", "v"), ("z", "s"), ("y", "i"), ("q", "k"))
SPLIT = re.compile(r"[\s\-_/;:]+|(?<=,)|(?=,)")
NAME = "uid string, kind string, trade string, key string, short boolean, family string, given string, initial string, middle string, orders array<string>"
WORDS = "uid string, words string, bare string, point string, legal boolean"  # lists as text, which Arrow moves faster
BREAK = "\x1f"
# Parameters. A word is learned from LEAST names and 1 / RARE of all, beside at least EVEN equally frequent beginnings of
# other words; so there are at most RARE times the words of a name of them, whatever the number of names.
LEAST, RARE, EVEN = 8, 2_000, 6.0
TRADE_SHARE, GIVEN_SHARE = 0.2, 0.05
SETS_LEAST, SETS_RARE = 2, 5_000
MINIMUM = 4
HOT = 20_000


def folded(text: str) -> str:
    """Lower case without accents, one spelling for umlauts and x."""
    s = text.lower()
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFD", s.translate(PLAIN)) if not unicodedata.combining(c))
    return s.replace("ks", "x")


def sound(word: str) -> str:
    """One letter for letters that sound alike, single ones for doubled."""
    for theirs, ours in SOUNDS:
        word = word.replace(theirs, ours)
    return re.sub(r"(.)\1+", r"\1", word)


def within_one(a: str, b: str) -> bool:
    """At most one insertion, deletion, replacement or swap of neighbours apart."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def shortens(short: str, full: str, point: bool) -> bool:
    """Whether a word may stand for a longer one: its beginning, another ending of its stem, or letters picked from it."""
    if short == full or len(short) < 2 or short[0] != full[0] or len(full) < 4:
        return False
    same = next((i for i, (x, y) in enumerate(zip(short, full)) if x != y), min(len(short), len(full)))
    if same >= 4 and same >= 0.55 * max(len(short), len(full)):
        return True
    if len(short) >= len(full):
        return False
    if same == len(short) or (short[-1] == "s" and same == len(short) - 1 >= 3):
        return point or same >= 4 or short[-1] == "s"
    rest = iter(full)
    if not all(c in rest for c in short):
        return False
    return point or (len(short) >= 3 and not set(short[same:]) & set("aeiou"))


class Lexicon:
    """What words mean: trades with the sets of them that occur together in full, and given names."""

    def __init__(self, trades: Iterable[str] = (), given: Iterable[str] = (), sets: dict[str, int] | None = None):
        self.learned, self.trades, self.sets = set(trades), TRADES | set(trades), sets or {}
        self.nick = {**{g: g for g in given}, **NICK}
        self.near_trade, self.near_given = self._less({t for t in self.trades if len(t) >= 6}), self._less({g for g in {*GIVEN, *given} if len(g) >= 5})
        self.heads: dict[str, list[str]] = {}
        for t in sorted(self.trades):
            self.heads.setdefault(t[0], []).append(t)
        self.trade, self.given, self.shorts = lru_cache(100_000)(self._trade), lru_cache(100_000)(self._given), lru_cache(100_000)(self._shorts)

    @staticmethod
    def _less(words: set[str]) -> dict[str, list[str]]:
        """Words by themselves and by what is left of them without one letter."""
        out: dict[str, list[str]] = {}
        for w in sorted(words):
            for part in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                out.setdefault(part, []).append(w)
        return out

    @staticmethod
    def _near(word: str, less: dict[str, list[str]]) -> str | None:
        for part in (word, *(word[:i] + word[i + 1 :] for i in range(len(word)))):
            for w in less.get(part, ()):
                if within_one(word, w):
                    return w
        return None

    def _trade(self, word: str) -> str | None:
        return word if word in self.trades else self._near(word, self.near_trade) if len(word) >= 6 else None

    def _given(self, word: str) -> str | None:
        return self.nick.get(word) or (self._near(word, self.near_given) if len(word) >= 4 else None)

    def _shorts(self, word: str, point: bool) -> tuple[str, ...]:
        may = tuple(t for t in self.heads.get(word[0], ()) if shortens(word, t, point))
        return tuple(t for t in may if t.startswith(word)) or may

    def settled(self, trades: set[str], names: list) -> tuple[set[str], list]:
        """Trades and the other words, shortened trades among these being read; at least one word stays."""
        ways = []
        for w, bare, point in names:
            opts = self.shorts(w, point) if len(w) > 1 and "." not in bare and (point or not trades) else ()
            ways.append((None, *opts[:12]))
        if sum(len(w) > 1 for w in ways) > 4 or all(len(w) == 1 for w in ways):
            return trades, names
        best = None
        for pick in product(*ways):
            told = [p for p in pick if p]
            if len(told) == len(names) or (len(names) > 1 and not any(p is None and len(n[0]) > 1 for p, n in zip(pick, names))):
                continue
            n = self.sets.get("+".join(sorted(trades | set(told))), 0)
            if not trades or n or not told:
                rank = (bool(told) and (n > 0 or not trades), n > 0, len(told) if n else -len(told), n, [p or "" for p in pick])
                if best is None or rank > best[0]:
                    best = (rank, pick)
        if best is None:
            return trades, names
        return trades | {p for p in best[1] if p}, [n for n, p in zip(names, best[1]) if p is None]


def orders(words: list[str]) -> list[tuple[str, ...]]:
    """The words in every order; of more than four, as they are and with each word before the others sorted."""
    if len(words) <= 4:
        return list(permutations(words))
    return [tuple(words), *[(w, *sorted(words[:i] + words[i + 1 :])) for i, w in enumerate(words)]]


def words(raw: str | None) -> list[tuple[str, str, bool]]:
    """(letters, as written, has a point) of each word, and commas as words; empty if there is no letter."""
    if not raw:
        return []
    s = raw if raw.isascii() and raw.isprintable() else visible(raw)
    if not s.isascii() and re.search("[A-Za-z]", s):
        s = "".join(w.translate(LOOKS) if re.search("[A-Za-z]", w) else w for w in re.split(r"(\W+)", s))
    s = re.sub(r"\([^)]*\)", " ", s).replace("&", " ")
    out = []
    for w in SPLIT.split(s):
        if w == ",":
            out.append((",", ",", False))
        elif w.isalpha():
            out.append((folded(w), w, False))
        elif re.search(r"[^\W\d_]", bare := re.sub(r"[^\w']", "", w)):
            dotted = re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]?", w)  # initials keep their points
            out.append((folded(bare).replace("'", ""), w if dotted else bare, "." in w or "'" in w.strip("'")))
    return out if any(w != "," for w, _, _ in out) else []


def _legal(word: str) -> bool:
    return len(word) > 1 and word in LEGAL


def read(told: list[tuple[str, str, bool]], lexicon: Lexicon) -> list[tuple]:
    """(kind, trade, key, short, family, given, initial, middle, keys in other orders) of each reading of a name."""
    full = [None if w == "," or _legal(w) or w in TITLES or w in EMPTY else lexicon.trade(w) for w, _, _ in told]
    if any(t in lexicon.learned for t in full):  # beside a word learned as a trade, one only listed is a name
        full = [t if t in lexicon.learned else None for t in full]
    kept, trades, org, person = [], {t for t in full if t}, False, False
    for (word, bare, point), trade in zip(told, full):
        if word == ",":
            kept.append((word, bare, point))
        elif _legal(word):
            org = True
        elif word in TITLES:
            person = True
        elif word not in EMPTY and trade is None:
            kept.append((word, bare, point))
    names = [k for k in kept if k[0] != ","]
    if not names:
        rest = "".join(sorted(trades)) or "".join(w for w, _, _ in told if w != ",")
        return [("o", "+".join(sorted(trades)), "=" + rest, False, None, None, None, None, [])] if rest else []
    trades, left = lexicon.settled(trades, names)
    org = org or bool(trades)
    one = len(left) == 1 and len(left[0][0]) > 1
    if org or one:
        return [_organisation(left, trades)]
    initial = any(len(w) == 1 or "." in b or (p and len(w) <= 3 and b.isupper()) for w, b, p in left)
    upper = sum(b.isupper() and len(b) > 1 for _, b, _ in left)
    sure = person or initial or len(kept) > len(names) or 0 < upper < len(left) or any(lexicon.given(w) for w, _, _ in left)
    out = [_person(kept, names, lexicon)]
    return out if sure else [*out, _organisation(left, trades)]


def _organisation(names: list, trades: set[str]) -> tuple:
    short = any(p and len(w) < 7 or len(w) == 1 for w, _, p in names)
    key = "".join(w for w, _, _ in names)
    others = {"".join(p) for p in orders([w for w, _, _ in names])} - {key}
    return ("o", "+".join(sorted(trades)), key, short, None, None, None, None, sorted(others) if short else _heard(key, others))


def _heard(key: str, others: set[str]) -> list[str]:
    """The other keys and, from six letters on, keys as they sound: both orders of two words, else as written."""
    heard = {"~" + sound(k) for k in ((key, *others) if len(others) < 2 else (key,))}
    return sorted(others | {k for k in heard if len(k) > 6})


def _person(kept: list, names: list, lexicon: Lexicon) -> tuple:
    def initials(w: str, bare: str, point: bool) -> bool:
        return len(w) == 1 or "." in bare or (point and len(w) <= 3 and bare.isupper())

    comma = next((i for i, k in enumerate(kept) if k[0] == ","), None)
    full = [k for k in names if not initials(*k)]
    inits = "".join(k[0] for k in names if initials(*k))
    if not full:
        return ("x", "", inits, False, None, None, None, None, [])
    family, given, told = [], [], True
    before = [k for k in kept[:comma] if not initials(*k)] if comma is not None else []
    if before and len(before) < len(full):
        family, given = before, [k for k in full if k not in before]
    elif len(full) == 1:
        family = full
    else:
        upper = [k for k in full if k[1].isupper()]
        known = [k for k in full if lexicon.given(k[0])]
        if upper and len(upper) < len(full):
            family = upper
        elif known:
            given = known[:1]
        else:
            family, told = [max(full, key=lambda k: len(k[0]))], False
        family = family or [k for k in full if k not in given]
        given = given or [k for k in full if k not in family]
    fam = "".join(k[0] for k in family)
    if given:
        formal = lambda g: g if g in OPEN_NICKS else lexicon.given(g) or g
        first = formal(" ".join(k[0] for k in given))
        key = f"{fam}|{first}"
        if told:
            firsts = {formal(" ".join(p)) for p in orders([k[0] for k in given])}
            others = {f"{''.join(p)}|{g}" for p in orders([k[0] for k in family]) for g in firsts}
        else:  # the surname is guessed: it may be any of the words
            others = {f"{p[0]}|{' '.join(p[1:])}" for p in orders([k[0] for k in full])}
        return ("p", "", key, False, fam, first, first[0], inits[:1] or None, _heard(key, others - {key}))
    return ("i", "", fam, False, fam, None, inits[:1] or None, inits[1:2] or None, [])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string()] * 4 + [pa.bool_()]
    for b in batches:
        rows = []
        for uid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if told := words(raw):
                w, bare, point = zip(*told)
                rows.append((uid, BREAK.join(w), BREAK.join(bare), "".join("01"[p] for p in point), any(map(_legal, w))))
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in WORDS.split(", ")])


def _parse(lexicon: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.bool_()] + [pa.string()] * 4 + [pa.list_(pa.string())]
        lex = Lexicon(*lexicon)
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            told = lambda w, bare, point: list(zip(w.split(BREAK), bare.split(BREAK), (p == "1" for p in point)))
            rows = [(u, *r) for u, w, bare, point in zip(*cols) for r in read(told(w, bare, point), lex)]
            cols = list(zip(*rows)) if rows else [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in NAME.split(", ")])

    return run


def learned(told: DataFrame) -> tuple[set[str], set[str], dict[str, int]]:
    """Trades, given names and sets of trades of all names; few words of many names come to the driver, see the parameters."""
    n = told.count()
    skip = sorted(LEGAL | TITLES | EMPTY)
    plain = F.filter(F.array_distinct(F.split("words", BREAK)), lambda w: (F.length(w) > 2) & ~w.isin(skip))
    own = told.select(plain.alias("w"), "legal")
    pair = own.select(F.explode("w").alias("word"), "w", "legal")
    seen = pair.groupBy("word").agg(F.count("*").alias("n"), F.avg(F.col("legal").cast("int")).alias("legal")).where(F.col("n") >= max(LEAST, n / RARE))
    beside = pair.select("word", F.explode(F.array_distinct(F.transform("w", lambda w: w.substr(1, 2)))).alias("start"))
    beside = beside.where("start <> substring(word, 1, 2)").join(seen.select("word"), "word", "left_semi").groupBy("word", "start").count()
    even = beside.groupBy("word").agg((F.sum("count") * F.sum("count") / F.sum(F.col("count") * F.col("count"))).alias("even"))
    rows = seen.join(even.where(F.col("even") >= EVEN), "word").select("word", "n", "legal").collect()
    found = {r.word: r.n for r in rows if r.legal >= TRADE_SHARE and r.word not in NICK}
    # A word that may stand for a more frequent one is its short form.
    trades = {w for w, n in found.items() if w in TRADES or not any(m > n and shortens(w, t, True) for t, m in found.items())}
    given = {r.word for r in rows if r.legal <= GIVEN_SHARE and r.word not in TRADES}
    sets = own.select(F.array_join(F.array_sort(F.array_intersect("w", F.array(*map(F.lit, sorted(trades | TRADES))))), "+").alias("s")).where("s <> ''")
    sets = sets.groupBy("s").count().where(F.col("count") >= max(SETS_LEAST, n / SETS_RARE))
    return trades, given, {r["s"]: r["count"] for r in sets.collect()}


class Trie:
    """Keys as paths; a node's "" is the key that ends there, its "<<" and ">>" the least and greatest value below it."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: str, value: str | None = None) -> None:
        node = self.root
        for ch in key:
            node = node.setdefault(ch, {})
            if value is not None:
                node["<<"], node[">>"] = min(node.get("<<", value), value), max(node.get(">>", value), value)
        node[""] = key

    def near(self, key: str, bound: int = 1) -> set[str]:
        """Keys within ``bound`` errors: states of the automaton are (node, letters read, errors so far)."""
        out, n, seen = set(), len(key), set()
        stack = [(self.root, 0, 0)]
        while stack:
            node, i, e = stack.pop()
            mark = (id(node), i, e)
            if mark in seen:
                continue
            seen.add(mark)
            if i == n and "" in node:
                out.add(node[""])
            if i < n:
                nxt = node.get(key[i])
                if nxt is not None:
                    stack.append((nxt, i + 1, e))
            if e < bound:
                if i < n:
                    stack.append((node, i + 1, e + 1))
                    if i + 1 < n and key[i] != key[i + 1]:
                        swap = node.get(key[i + 1])
                        swap = swap.get(key[i]) if swap is not None else None
                        if swap is not None:
                            stack.append((swap, i + 2, e + 1))
                for ch, nxt in node.items():
                    if len(ch) == 1:
                        stack.append((nxt, i, e + 1))
                        if i < n and ch != key[i]:
                            stack.append((nxt, i + 1, e + 1))
        return out

    def below(self, prefix: str) -> tuple[str, str] | None:
        """Least and greatest value of the keys that begin with the prefix."""
        node = self.root
        for ch in prefix:
            node = node.get(ch)
            if node is None:
                return None
        return node["<<"], node[">>"]

    def beside(self, prefix: str) -> tuple[str, str] | None:
        """The same of keys whose beginning is one error from the prefix, its last letter being right."""
        ends, n = {}, len(prefix)
        stack = [(self.root, 0, 0)]
        while stack:
            node, i, e = stack.pop()
            if i == n:
                ends[id(node)] = node
                continue
            nxt = node.get(prefix[i])
            if nxt is not None:
                stack.append((nxt, i + 1, e))
            if e == 0 and i < n - 1:
                stack.append((node, i + 1, 1))
                swap = node.get(prefix[i + 1], {}).get(prefix[i])
                if swap is not None:
                    stack.append((swap, i + 2, 1))
                for ch, nxt in node.items():
                    if len(ch) == 1:
                        stack.append((nxt, i, 1))
                        if ch != prefix[i]:
                            stack.append((nxt, i + 1, 1))
        ends = [e for e in ends.values() if "<<" in e]
        return (min(e["<<"] for e in ends), max(e[">>"] for e in ends)) if ends else None


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows (family, shard, ...) that lie together, as (family, shard) and the others."""
    now, rows = None, []
    for b in batches:
        for family, shard, *rest in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            if (family, shard) != now:
                if rows:
                    yield now, rows
                now, rows = (family, shard), []
            rows.append(rest)
    if rows:
        yield now, rows


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) == 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names)
            out = []
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*out)) or [[]] * len(names))], names)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, shard, key, longer): a member, or with ``longer`` a key that looks for members one letter longer."""

    def pairs() -> Iterator[tuple]:
        for (family, _), rows in _grouped(batches):
            trie = Trie()
            for key, longer in rows:
                if not longer:
                    trie.add(key)
            for key, longer in rows:
                yield from ((family, key, other) for other in trie.near(key) if longer or key < other)

    yield from _batches(pairs(), ["family", "a", "b"])


def trie_join(keys: DataFrame, hot: int | None = None) -> DataFrame:
    """(family, a, b), a < b or a a letter shorter, of keys of one family within one error.

    ``keys`` has STRING columns family and key. A key of m letters belongs to shards by its first 2p, last 2p, and first
    and last p letters, p being (m - 1) // 3; it looks for keys of its own length there and one letter longer in theirs.
    Shards of more than ``hot`` members are dealt by their members less one letter.
    """
    keys = Scratch(keys.sparkSession, "triekeys").save(keys.where(F.length("key") >= MINIMUM).distinct())
    want = keys.select("family", "key", F.explode(F.array(F.lit(0), F.lit(1))).alias("d")).withColumn("m", F.length("key") + F.col("d"))
    k, p = F.col("key"), F.floor((F.col("m") - 1) / 3).cast("int")
    left, right = lambda n: k.substr(F.lit(1), n), lambda n: F.right(k, n)
    shards = F.array(F.concat(F.lit("<"), left(2 * p)), F.concat(F.lit(">"), right(2 * p)), F.concat(F.lit("|"), left(p), right(p)))
    rows = want.select("family", "key", (F.col("d") == 1).alias("longer"), "m", F.explode(shards).alias("s"))
    rows = rows.select("family", F.concat_ws(" ", F.col("m").cast("string"), "s").alias("shard"), "key", "longer")
    where, hot = ["family", "shard"], hot or HOT
    # The keys of a shard share length and first or last letter, so only where that many do a shard can be hot.
    ends = F.array(F.concat(F.lit("<"), left(F.lit(1))), F.concat(F.lit(">"), right(F.lit(1))))
    many = keys.select("family", F.length("key").alias("m"), F.explode(ends).alias("e")).groupBy("family", "m", "e").count().where(F.col("count") > hot)
    if not many.isEmpty():
        big = rows.where("not longer").groupBy(*where).count().where(F.col("count") > hot).select(*where)
        less = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.concat(k.substr(F.lit(1), i - 1), k.substr(i + 1, F.length("key")))))
        finer = rows.join(big, where, "left_semi").select("family", "shard", "key", "longer", F.explode(F.when(F.col("longer"), F.array("key")).otherwise(less)).alias("part"))
        rows = rows.join(big, where, "left_anti").unionByName(finer.select("family", F.concat_ws(" ", "shard", "part").alias("shard"), "key", "longer"))
    placed = rows.repartition(*where).sortWithinPartitions(*where)
    # A shard of one key has no pair: it is left out before the rows go to Python.
    alone = W.partitionBy(*where)
    placed = placed.withColumn("x", F.min("key").over(alone)).withColumn("y", F.max("key").over(alone)).where("x <> y").select(*where, "key", "longer")
    return placed.mapInArrow(_walk, "family string, a string, b string").distinct()


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family, shard, key, root): members have a root, prefixes have none."""

    def ends() -> Iterator[tuple]:
        for (family, _), rows in _grouped(batches):
            asks = [key for key, root in rows if root is None]
            if not asks or len(asks) == len(rows):
                continue
            trie = Trie()
            for key, root in rows:
                if root is not None:
                    trie.add(key, root)
            for key in asks:
                exact, near = trie.below(key), trie.beside(key)
                if exact or near:
                    yield (family, key, *(exact or (None, None)), *(near or (None, None)))

    yield from _batches(ends(), ["family", "key", "x", "y", "near_x", "near_y"])


def prefix_join(prefixes: DataFrame, members: DataFrame, hot: int | None = None) -> DataFrame:
    """(family, key, x, y): least and greatest root of the members (family, key, root) that begin with a prefix (family, key).

    Prefixes of five letters or more walk tries of the members with the same first five, in chunks of about ``hot``
    members; if no member begins so, those count whose beginning is one error from the prefix, after the fifth letter.
    Shorter prefixes, below which there may be any number of members, need only the aggregate.
    """
    hot = hot or HOT
    asks = prefixes.distinct()
    few = asks.where(F.length("key") < 5)
    heads = members.select("family", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.length("key"))), lambda i: F.col("key").substr(F.lit(1), i))).alias("head"), "root")
    near = heads.groupBy("family", F.col("head").alias("key")).agg(F.min("root").alias("x"), F.max("root").alias("y")).join(few, ["family", "key"], "left_semi")
    five = F.col("key").substr(1, 5).alias("shard")
    asks, members = asks.where(F.length("key") >= 5).select("family", five, "key"), members.where(F.length("key") >= 5).select("family", five, "key", "root")
    members = members.join(asks.select("family", "shard").distinct(), ["family", "shard"], "left_semi")
    chunks = members.groupBy("family", "shard").agg(F.ceil(F.count("*") / hot).cast("int").alias("chunks"))
    salted = lambda df, salt: df.join(chunks, ["family", "shard"]).withColumn("salt", salt)
    members = salted(members, F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    asks = salted(asks, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("root", F.lit(None).cast("string"))
    rows = members.unionByName(asks).select("family", F.concat_ws(" ", "shard", F.col("salt").cast("string")).alias("shard"), "key", "root")
    placed = rows.repartition("family", "shard").sortWithinPartitions("family", "shard")
    ends = placed.mapInArrow(_below, "family string, key string, x string, y string, near_x string, near_y string")
    ends = ends.groupBy("family", "key").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.min("near_x").alias("near_x"), F.max("near_y").alias("near_y"))
    return near.unionByName(ends.select("family", "key", F.coalesce("x", "near_x").alias("x"), F.coalesce("y", "near_y").alias("y")))


def groups(name_key: DataFrame, alias_group: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """(name_id, entity) of every name; entity is a label that all names of one person or organisation share.

    With documents, their applicants' spellings are names too: (name_id, spelling, entity), name_id being null for these.
    """
    scratch = Scratch(name_key.sparkSession, "names")
    raw = name_key.where("name_id is not null and raw is not null").select(F.concat(F.lit("n"), F.col("name_id").cast("string")).alias("uid"), "raw").distinct()
    listed = raw.withColumnRenamed("raw", "spelling")
    if alias_group is not None:
        said = F.concat(F.array("canonical"), F.coalesce("variants", F.array().cast("array<string>")))
        alias = alias_group.where("group_id is not null").select(F.col("group_id").alias("g"), F.posexplode(said).alias("k", "raw")).where("raw is not null")
        raw = raw.unionByName(alias.select(F.concat_ws("_", F.lit("g"), F.col("g"), "k").alias("uid"), "raw").distinct())
    if documents is not None:
        said = documents.select(F.explode("applicants.name_raw").alias("raw")).where("raw is not null").distinct()
        raw = raw.unionByName(said.select(F.concat(F.lit("s"), "raw").alias("uid"), "raw"))
    told = scratch.save(raw.mapInArrow(_cut, WORDS))
    names = scratch.save(told.mapInArrow(_parse(learned(told)), NAME))
    family = F.concat_ws(":", "kind", "trade")
    node = lambda fam, key: F.concat(F.lit("k"), fam, F.lit("|"), key)

    whole, short = names.where("kind in ('o', 'x', 'p') and not short"), names.where("short")
    every_order = lambda df: df.select("uid", family.alias("family"), "key", F.explode(F.array_append("orders", F.col("key"))).alias("form"))
    forms, short_forms = every_order(whole), every_order(short)
    surnames = names.where("family is not null").select(F.lit("s:").alias("family"), F.col("family").alias("key"))
    # Each form is stood for by its least name; the combining of names with one form is done before the shuffle.
    reps = scratch.save(forms.groupBy("family", "form").agg(F.min("uid").alias("rep"), F.bool_or(F.col("form") == F.col("key")).alias("written")))
    near = scratch.save(trie_join(reps.where("family <> 'x:'").select("family", F.col("form").alias("key")).unionByName(surnames)))
    links = forms.join(reps, ["family", "form"]).where("uid <> rep").select(F.col("uid").alias("a"), F.col("rep").alias("b"))
    end = lambda c: reps.select("family", F.col("form").alias(c), F.col("rep").alias(f"rep_{c}"))
    beside = near.where("family <> 's:'").join(end("a"), ["family", "a"]).join(end("b"), ["family", "b"])
    links = links.unionByName(beside.where("rep_a <> rep_b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct())
    first = scratch.save(connected_groups(links, scratch))
    root_of = lambda df: df.join(first.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))

    # Names with a shortened word: tied to the one entity that has keys below the prefix; if none has, words may change
    # places. For prefixes, names as written and names in any order are families of their own.
    members = root_of(reps.where("form not like '~%'").select(F.col("rep").alias("uid"), "family", F.col("form").alias("key"), "written")).drop("uid")
    loose = lambda df: df.withColumn("family", F.concat(F.lit("~"), "family"))
    asks = short.select(family.alias("family"), "key").unionByName(loose(short_forms.select("family", F.col("form").alias("key"))))
    below = scratch.save(prefix_join(asks, members.where("written").drop("written").unionByName(loose(members.drop("written")))))
    one = below.where("family not like '~%'")
    moved = below.where("family like '~%'").select(F.expr("substring(family, 2)").alias("family"), F.col("key").alias("form"), "x", "y")
    moved = short_forms.select("family", "key", "form").distinct().join(moved, ["family", "form"])
    moved = moved.groupBy("family", "key").agg(F.min("x").alias("x2"), F.max("y").alias("y2"))
    shorts = short.select("uid", family.alias("family"), "key", "orders").join(one, ["family", "key"], "left").join(moved, ["family", "key"], "left")
    shorts = shorts.join(reps.select("family", F.col("form").alias("key"), "rep"), ["family", "key"], "left")
    to = F.when(F.col("x") == F.col("y"), F.col("x")).when(F.col("x").isNull() & (F.col("x2") == F.col("y2")), F.col("x2"))
    more = shorts.select(F.col("uid").alias("a"), F.coalesce(to, "rep", node(F.col("family"), F.col("key"))).alias("b"))
    same_words = node(F.concat(F.lit("~"), "family"), F.array_min(F.array_append("orders", F.col("key"))))
    more = more.unionByName(shorts.select(F.col("uid").alias("a"), same_words.alias("b")))

    # Initials and nicknames of several names: candidates are persons of the same or a neighbouring surname.
    persons = root_of(names.where("kind = 'p'").select("uid", "family", "given", "initial", "middle"))
    lit_nicks = F.create_map(*[x for k, v in OPEN_NICKS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    is_open = F.col("given").isin(*OPEN_NICKS)
    settled = persons.where(~is_open).select(F.col("family").alias("fam2"), F.col("given").alias("given2"), F.col("initial").alias("initial2"), F.col("middle").alias("middle2"), "root")
    settled = settled.groupBy("fam2", "given2", "initial2", "middle2").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    unsure = names.where("kind = 'i'").select("uid", "family", "initial", "middle", F.lit(None).cast("array<string>").alias("may"))
    unsure = unsure.unionByName(names.where(F.col("kind") == "p").where(is_open).select("uid", "family", "initial", "middle", lit_nicks[F.col("given")].alias("may")))
    asked = unsure.select("family", "initial", "middle", "may").distinct()
    beside = near.where("family = 's:'").select(F.explode(F.array(F.struct(F.col("a").alias("family"), F.col("b").alias("fam2")), F.struct(F.col("b").alias("family"), F.col("a").alias("fam2")))).alias("s"), F.lit(1).alias("apart")).select("s.*", "apart")
    beside = beside.unionByName(asked.select("family").distinct().select("family", F.col("family").alias("fam2"), F.lit(0).alias("apart")))
    meets = F.when(F.col("may").isNotNull(), F.array_contains("may", F.col("given2"))).otherwise(F.col("initial").isNull() | (F.col("initial") == F.col("initial2")))
    cand = asked.join(beside, "family").join(settled, "fam2").where(meets)
    same_middle = F.col("middle") == F.col("middle2")
    level = lambda root: [F.when((F.col("apart") == 0) & same_middle, root), F.when(F.col("apart") == 0, root), F.when(same_middle, root), root]
    levels = list(zip(level(F.col("least")), level(F.col("most"))))
    aggs = [f(c).alias(f"{n}{i}") for i, both in enumerate(levels) for n, f, c in zip("xy", (F.min, F.max), both)]
    chosen = cand.groupBy("family", "initial", "middle", "may").agg(*aggs)
    pick = F.coalesce(*[F.when(F.col(f"x{i}") == F.col(f"y{i}"), F.col(f"x{i}")) for i in range(len(levels))])
    chosen = chosen.select("family", "initial", "middle", "may", pick.alias("to"), F.lit(1).alias("any"))
    same = lambda c: F.col(f"u.{c}").eqNullSafe(F.col(f"c.{c}"))
    tied = unsure.alias("u").join(chosen.alias("c"), (F.col("u.family") == F.col("c.family")) & same("initial") & same("middle") & same("may"), "left")
    lone = node(F.lit("i:"), F.concat_ws("|", "u.family", "u.initial"))
    tied = tied.select(F.col("u.uid").alias("a"), F.when(F.col("to").isNotNull(), F.col("to")).when(F.col("any").isNull() & F.col("u.may").isNull(), lone).alias("b")).where("b is not null")

    # Alias groups: their names lead to entities, the group ties those together.
    ring = names.where("uid like 'g%'").select(F.col("uid").alias("a"), F.concat(F.lit("x"), F.split("uid", "_")[1]).alias("b"))
    stars = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    final = connected_groups(stars.unionByName(more).unionByName(tied).unionByName(ring), scratch)
    every = names.where("substring(uid, 1, 1) in ('n', 's')").select("uid")
    told = every.join(final, every["uid"] == final["node"], "left").select("uid", F.coalesce("root", "uid").alias("entity"))
    name_id = F.when(F.col("uid").startswith("n"), F.expr("try_cast(substring(uid, 2) AS bigint)")).alias("name_id")
    if documents is None:
        return told.select(name_id, "entity")
    typed = told.where("uid like 's%'").select(name_id, F.expr("substring(uid, 2)").alias("spelling"), "entity")
    listed = listed.join(told.dropDuplicates(["uid"]), "uid")
    return listed.select(name_id, "spelling", "entity").unionByName(typed)


def found(name_key: DataFrame, alias_group: DataFrame, hot: int = 1_000) -> DataFrame:
    """p5_found: name_id_a, name_id_b. Entities of more than ``hot`` names are dealt out, every part beside the whole."""
    scratch = Scratch(name_key.sparkSession, "namepairs")
    g = scratch.save(groups(name_key, alias_group))
    parts = g.groupBy("entity").agg(F.ceil(F.count("*") / hot).cast("int").alias("parts"))
    g = scratch.save(g.join(parts, "entity"))
    a = g.select(F.col("name_id").alias("name_id_a"), "entity", F.pmod(F.xxhash64("name_id"), F.col("parts")).cast("int").alias("part"))
    b = g.select(F.col("name_id").alias("name_id_b"), "entity", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["entity", "part"]).where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
