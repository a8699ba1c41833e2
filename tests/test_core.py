"""Core operators against brute force, truth tables and the oracle."""

import json
import random
from dataclasses import replace

import pytest
from compare import compare, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terrane.functions.ident import norm_code, norm_symbol, pub_parts, pub_text
from terrane.functions.names import LEGAL_SUFFIXES, name_key, steps_of
from terrane.operators import audit, search
from terrane.operators.graph import bfs, connected_components
from terrane.operators.hierarchy import descendants, hierarchy
from terrane.runtime import Scratch

SF = "/root/testdata/sf0.001"
CORE = ["filter_in", "join_left", "latest_copy", "copy_decisions", "copy_conflicts", "name_keys", "query_counts", "families", "asof_parent", "p2_found", "p2_paths", "m_families_per_year", "m_top_applicants", "set_symdiff", "audit_chain", "norm_pubnum"]


@pytest.mark.parametrize("name", CORE)
def test_query_equals_oracle(spark, name):
    said = compare(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert said.startswith("ok"), said


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _numbers():
    """Spellings built from parts, with what they should read as; and texts that are no publication number."""
    yes = [(f"{c}{sep}{n}{sep}{k}", f"{c}{n}{k}") for c, n, k in (("DE", "77001234", "C5"), ("AU", "9988776", "B"), ("NZ", "5500", ""), ("HK", "R1234", "A9")) for sep in ("", " ", "-", "/", ". ", ",")]
    yes += [("de 77,001,234 c5", "DE77001234C5"), ("SG55667788MB", "SG55667788MB"), ("\tNZ 5500\n", "NZ5500")]
    return yes + [(t, None) for t in ("", "   ", "5500", "Z5500", "DEC", "none given", "DE55667788MB", "D\u00c95500", None)]


def test_publication_numbers(spark):
    got = spark.createDataFrame(_numbers(), "raw string, want string").select("raw", "want", pub_text(pub_parts(F.col("raw"))).alias("got")).collect()
    assert [(r.raw, r.got) for r in got] == [(r.raw, r.want) for r in got]


def test_codes(spark):
    whole = [(f"{sub}{gap}{zeros}{group}/{rest}", f"{sub}{group}/{rest}") for sub in ("B65D", "Y02P") for gap in ("", " ", "  ") for zeros in ("", "0") for group, rest in (("81", "3453"), ("7", "00"))]
    part = [(t, None) for t in ("B65D", "B65D81", "B65D 81/", "B65D 81/3", "B65D 81345/00", "I65D81/00", "65D81/00", "")]
    got = spark.createDataFrame(whole + part, "raw string, want string").select("raw", "want", norm_code(F.col("raw")).alias("got"), norm_symbol(F.col("raw")).alias("s")).collect()
    assert [(r.raw, r.got) for r in got] == whole + part
    assert {r.s for r in got if r.want} == {w for _, w in whole}


@pytest.mark.parametrize("raw,key,steps", [
    ("Brundage & Fils S.A.", "brundage and fils", ["casefold", "ampersand", "punctuation", "suffix:s a"]), ("GmbH", "gmbh", ["casefold"]), ("kiln ltd pty ltd", "kiln", ["suffix:pty ltd", "suffix:ltd"]),
    ("Ｋｉｌｎ １", "kiln 1", ["casefold"]), ("ＫＩＬＮ-works", "kiln works", ["casefold", "punctuation"]), ("...", None, ["punctuation"]), (None, None, []),
])
def test_name_steps(raw, key, steps):
    assert steps_of(raw) == (key, steps)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["kiln", "south", "ø", *LEGAL_SUFFIXES[:12]]), min_size=1, max_size=5).map(" ".join))
def test_name_key_is_idempotent(name):
    key = steps_of(name)[0]
    assert steps_of(key)[0] == key


def test_name_key_column_equals_steps(spark):
    names = ["Brundage & Fils S.A.", "Kiln Works Pty Ltd.", "Föhr GmbH & Co. KG", "LLC", "  ", None, "kiln kg kg"]
    got = spark.createDataFrame([(n,) for n in names], "raw string").select("raw", name_key(F.col("raw")).alias("k")).collect()
    assert {r.raw: r.k for r in got} == {n: steps_of(n)[0] for n in names}


# ---------------------------------------------------------------- three-valued search

Q = search.LogicalQuery("q", "2001-03-01", "2009-08-31", ("NZ", "AU"), ("gate valve", "hydraulic ram"), ("F16K3/00", "E03B", "F16K31/12"))
# F16K3/00 and F16K31/12 are groups of the edition, E03B is a subclass; paths are from the section down.
SCHEME = search.Scheme("E7", {"F16K3/00": 0, "E03B": None, "F16K31/12": 2}, {"F16K3/00": ("F16K3/00", "F16K3/02"), "F16K31/12": ("F16K31/12", "F16K31/122"), "E03B": ("E03B7/00",)})
FOUND = ("F16K3/02", ["F", "F16", "F16K", "F16K3/00", "F16K3/02"])
BASE = {"office": "NZ", "at": "2005-06-07", "title": "Hydraulic-ram pump", "abstract": "Lifts water.", "codes": [FOUND]}
GONE = lambda code: (code, None)
AWAY = ("F16K5/00", ["F", "F16", "F16K", "F16K5/00"])
TABLE = [
    ({}, True, None),
    # office and date
    ({"office": "FR"}, False, None), ({"office": None}, False, None), ({"office": "FR", "at": None, "codes": []}, False, None), ({"at": "2009-09-01"}, False, None), ({"at": "2009-08-31"}, True, None), ({"at": None}, False, "no publication date"),
    # text
    ({"title": "Two gate  valves"}, True, None), ({"title": "Gates valve"}, False, None), ({"title": "Hydraulic", "abstract": "ram"}, False, None), ({"title": "A gate\u2010valve"}, False, None), ({"title": "Agate valve"}, False, None),
    ({"title": "\u00d6gate valve"}, False, None), ({"title": "gate valve\u00e9"}, False, None), ({"title": "None", "abstract": "(gate valve)"}, True, None), ({"title": None}, False, "no title"), ({"title": "Pump", "abstract": " "}, False, "no abstract"),
    ({"title": "", "abstract": None}, False, "no title or abstract"), ({"title": None, "abstract": "a gate valve"}, True, None), ({"title": None, "at": "2020-01-01"}, False, None), ({"title": "Pump", "at": None}, False, None),
    # codes the edition has
    ({"codes": [AWAY]}, False, None), ({"codes": [AWAY, FOUND]}, True, None), ({"codes": []}, False, "no CPC codes"), ({"codes": None}, False, "no CPC codes"),
    # codes it lacks: another subclass or main group is no, a queried main group or subclass is yes, the rest is open
    ({"codes": [GONE("G01F1/00")]}, False, None), ({"codes": [GONE("F16K99/00")]}, False, None), ({"codes": [GONE("F16K3/9999")]}, True, None), ({"codes": [GONE("E03B11/00")]}, True, None),
    ({"codes": [GONE("F16K31/9999")]}, False, "CPC codes not in E7"), ({"codes": [GONE("F16K2003/00")]}, False, "CPC codes not in E7"), ({"codes": [GONE("F16K2031/44")]}, False, "CPC codes not in E7"), ({"codes": [GONE("F16K31/9999"), FOUND]}, True, None),
    ({"codes": [GONE("F16K31/9999")], "at": None}, False, "no publication date; CPC codes not in E7"), ({"codes": [GONE("F16K31/9999")], "at": "1999-01-01"}, False, None),
]


def _verdicts(spark, q, changes):
    rows = [(i, *{**BASE, **change}.values()) for i, change in enumerate(changes)]
    df = spark.createDataFrame(rows, "i int, office string, at string, title string, abstract string, codes array<struct<code:string,path:array<string>>>")
    hit, why = search.evaluate(q, F.col("office"), F.to_date("at"), F.col("title"), F.col("abstract"), F.col("codes"), SCHEME)
    return {r.i: (r.hit, r.why) for r in df.select("i", hit.alias("hit"), why.alias("why")).collect()}


def test_truth_table(spark):
    assert _verdicts(spark, Q, [c for c, _, _ in TABLE]) == {i: (m, u) for i, (_, m, u) in enumerate(TABLE)}


def test_conditions_that_are_not_asked(spark):
    every = search.LogicalQuery("q", "2001-03-01", "2009-08-31", ())
    assert _verdicts(spark, every, [{"office": "FR"}, {"office": None}, {"codes": [], "title": None}, {"at": None}]) == {0: (True, None), 1: (True, None), 2: (True, None), 3: (False, "no publication date")}


def test_renderings():
    assert search.to_cql(Q) == '(ta="gate valve" or ta="hydraulic ram") and (cpc=/low F16K3/00 or cpc=/low E03B or cpc=/low F16K31/12) and pd within "20010301 20090831" and (pn=NZ or pn=AU)'
    assert search.to_cql(search.LogicalQuery("q", "2001-03-01", "2009-08-31", (), None, ("E03B",))) == 'cpc=/low E03B and pd within "20010301 20090831"'
    body = json.loads(search.to_json_body(Q, SCHEME))
    text, codes, date, office = body["query"]["bool"]["must"]
    assert body["size"] == 0 and len(text["bool"]["should"]) == 4 and office == {"terms": {"jurisdiction": ["NZ", "AU"]}}
    assert codes == {"terms": {"class_cpc.symbol": ["F16K3/00", "F16K3/02", "E03B7/00", "F16K31/12", "F16K31/122"]}} and date == {"range": {"date_published": {"gte": "2001-03-01", "lte": "2009-08-31"}}}
    sql = search.to_sql(Q, SCHEME)
    assert "SUBSTR(c.code, 1, 4) = 'E03B' OR c.code IN ('F16K3/00', 'F16K3/02', 'F16K31/12', 'F16K31/122')" in sql and "BETWEEN 20010301 AND 20090831" in sql and "p.country_code IN ('NZ', 'AU')" in sql
    assert "country_code" not in search.to_sql(search.LogicalQuery("q", "2001-03-01", "2009-08-31", ()), SCHEME)


@pytest.mark.parametrize("change", [{"phrases": ("o'ring",)}, {"phrases": ("a\\b",)}, {"offices": ("nz",)}, {"offices": ("N`",)}, {"cpc": ('E03B"',)}, {"cpc": ("E03B99/00",)}])
def test_renderings_refuse_what_they_cannot_say(change):
    with pytest.raises(search.QueryError):
        search.to_sql(replace(Q, **change), SCHEME)


def test_guards():
    with pytest.raises(search.QueryError):
        search.phrase_pattern(" -- ")
    with pytest.raises(search.QueryError, match="E6"):
        search.check_scheme("E6", "E7")
    for asked, states, sizes in ((["b"], {}, {}), (["b"], {"b": "running"}, {"b": 3}), (["b"], {"b": "finished"}, {"b": 0}), ([], {}, {})):
        with pytest.raises(search.QueryError):
            search.check_universe(asked, states, sizes)
    search.check_universe(["b", "c"], {"b": "finished", "c": "finished"}, {"b": 2})


# ---------------------------------------------------------------- graphs and hierarchies


def _components(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in up}


def test_connected_components(spark):
    r = random.Random(3)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(45)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(20)]
    edges = [e for e in edges if e[0] != e[1]]
    got = connected_components(spark.createDataFrame(edges, "a string, b string"), Scratch(spark, "t")).collect()
    assert {x.node: x.component for x in got} == _components(edges)


def test_bfs_accounts_for_every_candidate(spark):
    links = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "b"), ("s", "t"), ("b", "c"), ("a", "x")], "document string, target string")
    seeds = spark.createDataFrame([("s",), ("t",)], "node string")
    allowed = spark.createDataFrame([("a",), ("b",), ("c",)], "target string")
    reached, counts = bfs(seeds, links, allowed, hops=2, cap=1)
    assert {(r.node, r.hop) for r in reached.collect()} == {("s", 0), ("t", 0), ("b", 1), ("c", 2)}
    assert {(r.hop, r.reason): r.n for r in counts.collect()} == {(1, "requested"): 1, (1, "over_cap"): 1, (1, "already_requested"): 1, (2, "requested"): 1}


CPC = "scheme_version string, pos int, symbol string, kind string, dot_level int, title string, parent string"


def _tree_rows(seed):
    r = random.Random(seed)
    rows = []
    for v in ("e1", "e2"):
        names = [f"A01B1/{i}" for i in range(10, 60)]
        for i, s in enumerate(names):
            p = None if i < 3 else r.choice([names[r.randrange(len(names))], names[r.randrange(i)], names[r.randrange(i)], f"a01b 0001/{10 + r.randrange(i)}", "A99Z9/99"])
            rows.append((v, i, s, "subgroup", 1, None, p))
    return rows + rows[:5] + [("e1", 99, None, None, None, None, "A01B1/10"), (None, 1, "X", None, None, None, None), ("e1", 100, "A01B1/99", None, None, "t", " ")]


def _brute(rows):
    import re

    up = {}
    for v, _, s, _, _, _, p in rows:
        if v and s:
            p = re.sub(r"\s", "", p or "").upper() or None
            up[v, s] = re.sub(r"^([A-Z]\d\d[A-Z])0+(\d)", r"\1\2", p) if p else None
    out = {}
    for v, s in up:
        path, x = [s], s
        while True:
            p = up[v, x]
            if p is None or (v, p) not in up:
                out[v, s] = ("tree" if p is None else "orphan", tuple(reversed(path)))
                break
            if p in path:
                out[v, s] = ("cycle", None)
                break
            path.append(p)
            x = p
    return out


@pytest.mark.parametrize("seed,bound", [(1, 50_000), (2, 50_000), (1, 4), (3, 7)])
def test_hierarchy_equals_brute_force(spark, seed, bound):
    rows = _tree_rows(seed)
    df = spark.createDataFrame(rows, CPC).withColumn("comp", F.lit("clash")).withColumn("up", F.lit("clash"))
    want = _brute(rows)
    got = hierarchy(df, bound).collect()
    assert len(got) == len(want)
    assert {(r.scheme_version, r.symbol): (r.status, tuple(r.path) if r.path else None) for r in got} == want
    below = {(r.scheme_version, r.symbol, r.descendant, r.distance) for r in descendants(df, bound).collect()}
    assert below == {(v, p[i], s, len(p) - 1 - i) for (v, s), (_, p) in want.items() if p for i in range(len(p) - 1)}
    loops = {(r.scheme_version, r.symbol) for r in got if r.on_loop}
    assert loops <= {k for k, (status, _) in want.items() if status == "cycle"}
    edges = {(r.scheme_version, r.back_to): r.symbol for r in got if r.back_to is not None}
    assert set(edges) <= loops and {(v, s) for (v, _), s in edges.items()} <= loops and bool(edges) == bool(loops)


@pytest.mark.parametrize("bound", [50, 100_000])
def test_deep_chains_and_large_loops(spark, bound):
    rows = [("e", k, f"C{k:05d}", "x", None, None, f"C{k - 1:05d}" if k else None) for k in range(3000)]
    rows += [("e", k, f"L{k:03d}", "x", None, None, f"L{(k + 1) % 200:03d}") for k in range(200)] + [("e", k, f"M{k:03d}", "x", None, None, "L007" if k == 0 else f"M{k - 1:03d}") for k in range(300)]
    rows += [("e", 0, "OWN", "x", None, None, "OWN"), ("e", 0, "O1", "x", None, None, "GONE"), *[("e", k, f"O{k}", "x", None, None, f"O{k - 1}") for k in range(2, 90)]]
    got = {r.symbol: r for r in hierarchy(spark.createDataFrame(rows, CPC), bound).collect()}
    assert len(got) == len(rows) and got["C02999"].depth == 2999 and got["C02999"].path[0] == got["C02999"].root == "C00000" and got["C02999"].path[1500] == "C01500"
    assert {s for s, r in got.items() if r.on_loop} == {f"L{k:03d}" for k in range(200)} | {"OWN"} and {s for s, r in got.items() if r.status == "cycle"} == {f"L{k:03d}" for k in range(200)} | {f"M{k:03d}" for k in range(300)} | {"OWN"}
    assert {(s, r.back_to) for s, r in got.items() if r.back_to} == {("L001", "L000"), ("OWN", "OWN")}
    assert got["O89"].status == "orphan" and got["O89"].depth == 88 and got["O89"].root == "O1"


def test_hierarchy_of_an_empty_table(spark):
    assert hierarchy(spark.createDataFrame([], CPC)).collect() == []


# ---------------------------------------------------------------- provenance


def test_chain_and_tampering(spark):
    rows = [("r1", i, f"p{i}") for i in range(6)] + [("r2", i, f"q{i}") for i in range(3)]
    c = Scratch(spark, "chain").save(audit.chain(spark.createDataFrame(rows, "run_id string, seq bigint, payload string")))
    assert {r.run_id: r.first_bad for r in audit.verify(c).collect()} == {"r1": None, "r2": None}
    bad = c.withColumn("payload", F.when((F.col("run_id") == "r1") & (F.col("seq") == 3), "x").otherwise(F.col("payload")))
    assert {r.run_id: r.first_bad for r in audit.verify(bad).collect()} == {"r1": 3, "r2": None}


def test_canonical_json_refuses_floats():
    assert audit.canonical_json({"b": 1, "a": ["é"]}) == '{"a":["é"],"b":1}'
    with pytest.raises(TypeError):
        audit.canonical_json({"a": 1.0})


def test_streams(spark, tmp_path):
    from terrane.streaming import events

    assert events.replay(spark, SF, str(tmp_path)).count() > 0


@pytest.mark.parametrize("block", [4096, 7])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, block):
    import difflib

    from terrane.operators import similar

    monkeypatch.setattr(similar, "BLOCK", block)
    r = random.Random(block)
    keys = ["andrew braeshoxnoxglus", "andtew braeshoxnoxglus", "deixge rgleis optics", "deixgergleis optics", "kiln", "kiln group", "kiln group holding", "kilna", "戻り配管機", "戻り配管器", "ab" * 150, "ab" * 149 + "a"]
    base = ["".join(r.choice("abcdeé ") for _ in range(r.randrange(3, 40))) for _ in range(40)]
    keys += [" ".join(k.split()) for b in base for k in (b, b[1:], b[:5] + "x" + b[6:], b[3:] + b[:3], "zz" + b)]
    keys = sorted({k for k in keys if k})
    want = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            ratio = difflib.SequenceMatcher(None, a, b).ratio()
            if ratio >= 0.88 or b.split()[: len(a.split())] == a.split():
                want.add((a, b, round(ratio, 3)))
    got = [tuple(x) for x in similar.similar(spark.createDataFrame([(k,) for k in [*keys, keys[0], None, ""]], "key string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {("andrew braeshoxnoxglus", "andtew braeshoxnoxglus"), ("deixge rgleis optics", "deixgergleis optics"), ("kiln", "kiln group holding")} <= {(a, b) for a, b, _ in got}


def test_all_events_are_chained(spark):
    import hashlib

    rows = sorted((r.user_id, r.event_id, r.event_type) for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", "event_type").collect())
    want, last, nth, bad = set(), {}, {}, {}
    for user, seq, kind in rows:
        run, payload = f"user_{user}", f"{kind}:{seq}"
        prev = last.get(run, audit.GENESIS)
        last[run] = hashlib.sha256(f"{prev}|{payload}".encode()).hexdigest()
        want.add((run, seq, payload, prev, last[run]))
        nth[run] = nth.get(run, 0) + 1
        if (nth[run], run[-1]) in ((3, "7"), (4, "8")):
            bad[run] = (seq, "content" if run[-1] == "7" else "link")
    assert {tuple(r) for r in entry.queries()["audit_chain"](spark, SF).collect()} == want and len(want) == len(rows)
    assert {tuple(r) for r in entry.queries()["chain_verify"](spark, SF).collect()} == {(r, n, *bad.get(r, (None, None))) for r, n in nth.items()}


def test_name_prefix_pairs(spark, tmp_path):
    raws = ["Kiln Corp.", "Kiln Group", "KILN group holding Ltd", "Kilna", "Group", None, "Kiln"]
    spark.createDataFrame([(r,) for r in raws], "raw string").write.parquet(f"{tmp_path}/name_key.parquet")
    got = sorted(tuple(r) for r in entry.queries()["name_prefix_pairs"](spark, str(tmp_path)).collect())
    assert got == [("kiln", "kiln group"), ("kiln", "kiln group holding"), ("kiln group", "kiln group holding")]
    said = compare(spark, duck(str(tmp_path)), "name_prefix_pairs", entry.queries()["name_prefix_pairs"], entry.oracle_sql()["name_prefix_pairs"], str(tmp_path))
    assert said.startswith("ok"), said


@pytest.mark.parametrize("hot", [100_000, 4])
def test_components_with_hubs_and_chains(spark, monkeypatch, hot):
    from terrane.operators import graph

    monkeypatch.setattr(graph, "HOT", hot)
    r = random.Random(hot)
    edges = [("hub", f"h{k:03d}") for k in range(300)] + [(f"h{k:03d}", f"leaf{k}") for k in range(0, 300, 7)]
    edges += [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(150)] + [(f"z{r.randrange(40)}", f"z{r.randrange(40)}") for _ in range(25)] + [("own", "own")]
    r.shuffle(edges)
    rows = edges + [(None, "x"), ("y", None)] + edges[:20]
    got = connected_components(spark.createDataFrame(rows, "a string, b string").repartition(5), Scratch(spark, "t")).collect()
    assert {x.node: x.component for x in got} == _components(edges) and len(got) == len({x.node for x in got})
    assert connected_components(spark.createDataFrame([], "a string, b string"), Scratch(spark, "t")).collect() == []
