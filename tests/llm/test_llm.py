"""Training-data operators against brute force, round trips and the defined results of odd inputs."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import bpe, collapse, consensus, cutoff, forest, lookalike, mixture, nametrie
from terrane.runtime import Scratch

DOC = "document_id string, retrieved_at timestamp, source_id string, publication struct<country:string,number:string,kind:string>, publication_number_raw string, family_id_simple string, family_members array<string>, title string, abstract string, applicants array<struct<name_raw:string,country:string>>, filing_date date, grant_date date, legal_status struct<category:string,status_raw:string>, value string, node string, salt int"


def docs(spark, rows):
    full = [{**dict.fromkeys(["retrieved_at", "source_id", "publication", "family_id_simple", "family_members", "title", "abstract", "applicants", "filing_date", "grant_date", "legal_status"]), **r, "value": "clash", "node": "clash", "salt": 1} for r in rows]
    names = [x.split()[0] for x in DOC.replace("struct<country:string,number:string,kind:string>", "x").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], DOC)


# ---------------------------------------------------------------- 1 survivors


def test_survivor_is_the_latest_copy_that_has_the_field(spark):
    t = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [
        {"document_id": "a", "publication_number_raw": "US 1 A", "retrieved_at": t(1), "title": "one", "abstract": "x y z"},
        {"document_id": "b", "publication_number_raw": "us-1-a", "retrieved_at": t(2), "title": "  ", "abstract": "x y q"},
        {"document_id": "c", "publication_number_raw": "US1A", "retrieved_at": None, "title": "three", "filing_date": datetime.date(2020, 1, 1)},
        {"document_id": "c", "publication_number_raw": "US1A", "retrieved_at": None, "title": "three", "filing_date": datetime.date(2020, 1, 1)},
        {"document_id": "d", "publication_number_raw": "EP2", "title": "alone"},
        {"document_id": "e", "publication_number_raw": "EP3", "retrieved_at": t(5), "title": "tie"},
        {"document_id": "f", "publication_number_raw": "EP 3", "retrieved_at": t(5), "title": "tied"},
        {"document_id": None, "publication_number_raw": "EP3", "title": "x"}, {"document_id": "g", "publication_number_raw": None, "title": "x"},
    ]
    got = {tuple(r) for r in consensus.found(docs(spark, rows)).collect()}
    assert got == {("US1A", "title", "a"), ("US1A", "abstract", "b"), ("US1A", "filing_date", "c"), ("EP3", "title", "f")}


def test_large_group_is_decided_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(consensus, "BLOCK", 4)
    rows = [{"document_id": f"d{i:03d}", "publication_number_raw": "US1A", "retrieved_at": datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=(i * 37) % 101), "title": f"title {i}"} for i in range(60)]
    best = max(rows, key=lambda r: (r["retrieved_at"], r["document_id"]))
    assert [r.document_id for r in consensus.found(docs(spark, rows)).collect()] == [best["document_id"]]


def test_majority_consensus_by_tokens():
    values = ["a red valve and seal", "a red valve with seal", "a blue valve with seal"]
    assert consensus.nearest(values, [1, 1, 1], False) == 1
    assert consensus.nearest(values, [3, 2, 1], True) == 0
    assert consensus.nearest(["x " * 3000, "x " * 2999 + "y"], [1, 1], False, cells=100) in (0, 1)


def test_rule_of_the_latest_copy_runs_no_alignment(spark):
    e = docs(spark, [{"document_id": k, "publication_number_raw": "EP1", "title": f"title {k}"} for k in "ab"])
    for d, rows in ((consensus.found(e), [("EP1", "title", "b")]), (consensus.survivors(e), [("EP1", "title", "title b", None, "b", 2)])):
        assert "MapInArrow" not in d._jdf.queryExecution().toString() and [tuple(r) for r in d.collect()] == rows


def test_alignment_decides_where_the_latest_copy_has_several_values(spark):
    texts = ["a red value", "a red valve", "a big valve"]
    assert consensus.nearest(texts, [2, 2, 1], True) == 1 and consensus.nearest(texts[1::-1] + texts[2:], [2, 2, 1], True) == 0
    assert consensus.nearest(["a b", "c d", "a d"], [2, 2, 1], True) == 0  # an earlier value is never chosen
    at = datetime.datetime(2024, 1, 1)
    rows = []
    for pub, when in (("EP1", at), ("EP2", None)):
        twice = [{"document_id": "z", "publication_number_raw": pub, "retrieved_at": when, "title": t} for t in texts[:2]]
        old = [{"document_id": f"k{k:03d}", "publication_number_raw": pub, "title": f"a big valve {k}"} for k in range(300)]
        rows += [*twice, *old] if when else [*old, *twice[::-1], twice[0]]
    e = docs(spark, rows)
    assert {tuple(r) for r in consensus.survivors(e).collect()} == {("EP1", "title", "a red valve", at, "z", 302), ("EP2", "title", "a red valve", None, "z", 303)}
    assert {tuple(r) for r in consensus.found(e).collect()} == {("EP1", "title", "z"), ("EP2", "title", "z")}
    assert {r.title for r in consensus.records(e).collect()} == {"a red valve"}


def test_latest_values_equal_counting_with_whole_numbers():
    r, moved = random.Random(27), 0
    for _ in range(500):
        texts = list({" ".join(r.choice("abcd") for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(2, 12))})
        levels = sorted([5, *(r.randrange(1, 6) for _ in texts[1:])], reverse=True)
        columns = []
        for k, seq in enumerate(t.split() for t in texts):
            ids = {t: n for n, t in enumerate("abcd")}
            lead = [ids[next(t for t in c if t)] for c in columns]
            columns = [(columns[i] if i is not None else [None] * k) + [None if j is None else seq[j]] for i, j in consensus._place(lead, [ids[t] for t in seq], 10**6)]
        far = [0] * levels.count(5)
        for c in columns:
            count = {}
            for t, level in zip(c, levels):
                count[t] = count.get(t, 0) + 100**level
            far = [f + (t != max(count, key=count.get)) for f, t in zip(far, c)]
        want = far.index(min(far))
        assert consensus.nearest(texts, levels, True) == want and consensus.nearest_of_latest(zip(texts, levels)) == (want, texts[want])
        moved += want > 0
    assert moved > 50


def _consensus_by_hand(values, votes):
    """Every column of the same progressive alignment decided by counting, one after another."""
    seqs, columns = [consensus.TOKEN.findall(v) for v in values], []
    for k, seq in enumerate(seqs):
        lead = [next(c[q] for q in range(k) if c[q] is not None) for c in columns]
        best = [[0] * (len(seq) + 1) for _ in range(len(lead) + 1)]
        for i in range(len(lead)):
            for j in range(len(seq)):
                best[i + 1][j + 1] = best[i][j] + 1 if lead[i] == seq[j] else max(best[i][j + 1], best[i + 1][j])
        numbers = {t: n for n, t in enumerate(dict.fromkeys(lead + seq))}
        pairs = consensus._match([numbers[t] for t in lead], np.array([numbers[t] for t in seq], dtype=np.int64)) if lead and seq else []
        assert len(pairs) == best[-1][-1] and all(lead[i] == seq[j] for i, j in pairs) and all(p < q and x < y for (p, x), (q, y) in zip(pairs, pairs[1:]))
        new, i, j = [], 0, 0
        for pi, pj in [*pairs, (len(lead), len(seq))]:
            n = min(pi - i, pj - j)
            new += [columns[i + m][:k] + [seq[j + m]] for m in range(n)] + [columns[m][:k] + [None] for m in range(i + n, pi)] + [[None] * k + [seq[m]] for m in range(j + n, pj)]
            if pi < len(lead):
                new.append(columns[pi][:k] + [seq[pj]])
            i, j = pi + 1, pj + 1
        columns = new
    far = [0] * len(values)
    for c in columns:
        count = {}
        for token, v in zip(c, votes):
            count[token] = count.get(token, 0) + v
        chosen = max(count, key=lambda t: count[t])
        far = [f + (t != chosen) for f, t in zip(far, c)]
    return far.index(min(far))


def test_consensus_equals_counting_by_hand():
    r = random.Random(21)
    for _ in range(1000):
        texts = list({" ".join(r.choice("abcd") for _ in range(r.randrange(1, 10))) for _ in range(r.randrange(2, 9))})
        votes = sorted((r.randrange(1, 4) for _ in texts), reverse=True)
        assert consensus.nearest(texts, votes, False) == _consensus_by_hand(texts, votes)


def test_majority_of_many_equals_one_alignment():
    r = random.Random(9)
    for _ in range(150):
        texts = list({" ".join(r.choice("abcd") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(2, 14))})
        votes = sorted((r.randrange(1, 4) for _ in texts), reverse=True)
        want = consensus.nearest(texts, votes, False)
        assert consensus.nearest_of_many(zip(texts, votes), iter(texts)) == want and (want == 0 or 2 * votes[0] < sum(votes))


def test_majority_of_a_large_group_counts_every_value(spark, monkeypatch):
    monkeypatch.setattr(consensus, "BLOCK", 4)  # for the driver; workers keep theirs, so the group is larger than that too
    r = random.Random(11)
    texts = [" ".join(r.choice(("red", "blue", "big")) if i in (1, 4, 6) else f"w{i}" for i in range(8)) + f" x{k}" * (k % 3) for k in range(300)]
    rows = [{"document_id": f"d{k:03d}", "publication_number_raw": "US1A", "title": t} for k, t in enumerate(texts)]
    rows += [{"document_id": f"e{k}", "publication_number_raw": "EP2", "title": t} for k, t in enumerate(["one", "two", "two"])] + [{"document_id": "e0", "publication_number_raw": "EP2", "title": "one"}] * 5
    votes = {}
    for k, t in enumerate(texts):
        votes.setdefault(t, []).append(f"d{k:03d}")
    order = sorted(votes, key=lambda t: (len(votes[t]), max(votes[t])), reverse=True)
    best = order[consensus.nearest(order, [len(votes[t]) for t in order], False)]
    got = {x.publication_number: (x.value, x.document_id, x.votes) for x in consensus.survivors(docs(spark, rows), "majority").collect()}
    assert got == {"US1A": (best, max(votes[best]), 300), "EP2": ("two", "e2", 3)}


def test_long_texts_are_aligned_too():
    r = random.Random(13)
    for _ in range(60):
        a, b = ([r.randrange(6) for _ in range(r.randrange(30))] for _ in range(2))
        part = consensus._aligned(a, np.array(b, dtype=np.int64), 20)
        assert all(a[i] == b[j] for i, j in part) and all(p < q and x < y for (p, x), (q, y) in zip(part, part[1:]))
        assert len(part) == len(consensus._match(a, np.array(b, dtype=np.int64)) if a and b else [])
    words = [f"w{i}" for i in range(60)]
    odd = lambda k: " ".join([*words[:k], "new", *words[k:]])
    changed = [*words[:50], "no", *words[51:]]
    texts = [" ".join(changed), odd(5), odd(7), odd(9)]
    assert consensus.nearest(texts, [1] * 4, False) == consensus.nearest(texts, [1] * 4, False, cells=100)


def test_empty_documents(spark):
    e = docs(spark, [])
    for f in (consensus.found, lookalike.found, forest.family_groups, forest.family_keys):
        assert f(e).collect() == []


# ---------------------------------------------------------------- 3 look-alikes


@pytest.mark.parametrize("text,want", [
    ("Ｄｅｖｉｃｅ", "Device"), ("élan", "élan"), ("ze​ro", "zero"), ("a b", "a b"), ("ﬁlter", "filter"), ("ordinary", "ordinary"), ("naïve", "naïve"), ("", ""),
    ("戻り配管（第二）　を", "戻り配管（第二）　を"),
])
def test_visible_form(text, want):
    assert lookalike.visible(text) == want


@pytest.mark.parametrize("text,want", [
    ("m² ½ ① ™ … µm № 5℃", "m² ½ ① ™ … µm № 5℃"), ("ⅷ", "viii"), ("𝐁𝐨𝐥𝐭", "Bolt"), ("ﷲ", "الله"), ("ำ", "ำ"), ("ㄱ", "ㄱ"), ("ĳ", "ij"), ("Ångström", "Ångström"), ("\u212bngström", "Ångström"),
])
def test_forms_and_signs(text, want):
    assert lookalike.visible(text) == want


def test_tokens_beside_other_scripts_and_repeats(spark):
    clean = ["the device for the seal", "method for the valve", "нашел способ обнаружение засора", "հօսանք հոս հոսք"] * 5
    rows = [{"document_id": f"c{i}", "title": t} for i, t in enumerate(clean)] + [{"document_id": "1", "title": "装置thе装置"}] * 3 + [{"document_id": "2", "title": "the vаlve هذا"}, {"document_id": "3", "title": "tհe seal device method"}, {"document_id": "4", "title": "հօսանք"}]
    got = [(r.document_id, r.normal) for r in lookalike.normalized(docs(spark, rows)).collect()]
    assert sorted(got) == [("1", "装置the装置"), ("2", "the valve هذا"), ("3", "the seal device method")]


def test_lookalikes_in_context(spark):
    clean = ["the device for the seal", "method for the valve", "способ обнаружение засора", "устройство возврат тепла", "β-glucan coating", "γ-ray shield", "THE SEAL"] * 4
    odd = [("1", "thе sеal"), ("2", "ТНЕ SEAL"), ("3", "спoсоб засора"), ("4", "Β-GLUCAN COATING"), ("5", "the seal"), ("6", None), ("7", "  "), ("8", "способ")]
    rows = [{"document_id": f"c{i}", "title": t} for i, t in enumerate(clean)] + [{"document_id": i, "title": t} for i, t in odd]
    rows.append({"document_id": "9", "title": None, "applicants": [("Аcme device", None), ("the seal", None)]})
    df = docs(spark, rows)
    assert {tuple(r) for r in lookalike.found(df).collect()} == {("1", "title"), ("2", "title"), ("3", "title"), ("9", "applicants")}
    normal = {r.document_id: r.normal for r in lookalike.normalized(df).collect()}
    assert normal["1"] == "the seal" and normal["2"] == "THE SEAL" and normal["3"] == "способ засора"


# ---------------------------------------------------------------- 4 collapse


def test_collapse(spark):
    raws = ["US1A", "us 1-A", "US1A", " (us) 1.a\n", "cc=US; num=1; kind=A", "KIND: a, CC: us, NUM: 1", "", None, "--", "US:2", "US2", "x" * 200_000, "X" * 200_000]
    df = spark.createDataFrame([(f"i{k:02d}", r, 1) for k, r in enumerate(raws)] + [("i00", "US1A", 1), (None, "US1A", 1)], "id string, raw string, n int")
    got = {tuple(r) for r in collapse.copies(df.select("id", "raw"), Scratch(spark, "t")).collect()}
    assert got == {("i00", "i01"), ("i00", "i02"), ("i00", "i03"), ("i04", "i05"), ("i09", "i10"), ("i11", "i12")}


def test_text_before_labels_and_labels_with_digits(spark):
    raws = ["Acme cc: US; num: 5", "Zeta cc: US; num: 5", "cc: US; num: 5", "ACME -- NUM = 5, CC = us", "p1=a;p2=b", "P2: B, P1: A", "p1=b;p2=a", "[cc=US num=5]"]
    df = spark.createDataFrame([(f"i{k}", r) for k, r in enumerate(raws)], "id string, raw string")
    assert {tuple(r) for r in collapse.copies(df, Scratch(spark, "t")).collect()} == {("i0", "i3"), ("i4", "i5"), ("i2", "i7")}
    records = collapse.collapse(collapse.delivered(df), Scratch(spark, "t"))[0].collect()
    assert len(records) == 5 and sum(r.n_copies for r in records) == 8


def test_collapse_with_a_hot_spelling(spark, monkeypatch):
    monkeypatch.setattr(collapse, "HOT", 5)
    df = spark.createDataFrame([(f"i{k:03d}", "US1A" if k % 3 else f"us{k}") for k in range(300)], "id string, raw string")
    assert collapse.copies(df, Scratch(spark, "t")).count() == 199


# ---------------------------------------------------------------- 5 names


def test_trie_walk_equals_brute_force():
    r = random.Random(5)
    words = list({"".join(r.choice("abc") for _ in range(r.randrange(1, 7))) for _ in range(150)})
    trie = nametrie.Trie()
    for w in words:
        trie.add(w)
    for w in words:
        assert trie.near(w) == {x for x in words if nametrie.within_one(w, x)}


@pytest.mark.parametrize("hot", [None, 3])
def test_trie_join_loses_no_neighbour(spark, hot):
    r = random.Random(7)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(4, 18))) for _ in range(120)]
    words += [w[:-2] + w[-1] + w[-2] for w in words[:40]] + [w[1:] for w in words[40:80]]
    words = sorted(set(words))
    rows = spark.createDataFrame([("f", w) for w in words * 2], "family string, key string")
    got = [(x.a, x.b) for x in nametrie.trie_join(rows, hot).collect()]
    assert {tuple(sorted(p)) for p in got} == {(a, b) for a in words for b in words if a < b and min(len(a), len(b)) >= nametrie.MINIMUM and nametrie.within_one(a, b)}
    assert len(got) == len(set(got))


@pytest.mark.parametrize("hot", [None, 2])
def test_prefixes_know_the_ends_below(spark, hot):
    members = [("f", "abcdefgh", "r3"), ("f", "abcdefxx", "r1"), ("f", "abcdzz", "r9"), ("f", "xy", "r5"), ("f", "xyz", "r4"), ("g", "abcdefgh", "r0")]
    asks = [("f", "abcdef"), ("f", "abcdexgh"), ("f", "abc"), ("f", "xy"), ("f", "q"), ("f", "qqqqqq")]
    got = nametrie.prefix_join(spark.createDataFrame(asks * 2, "family string, key string"), spark.createDataFrame(members, "family string, key string, root string"), hot).collect()
    assert {(x.key, x.x, x.y) for x in got} == {("abcdef", "r1", "r3"), ("abcdexgh", "r3", "r3"), ("abc", "r1", "r9"), ("xy", "r4", "r5")} and len(got) == 4


def test_shortened_words():
    yes = [("instr", "instruments", False), ("intl", "international", False), ("mfg", "manufacturing", False), ("labs", "laboratories", False), ("technology", "technologies", False), ("vlc", "volcanoworks", False), ("zor", "zorbing", True)]
    no = [("zor", "zorbing", False), ("optics", "optics", True), ("o", "optics", True), ("mining", "metals", True), ("pro", "optics", True)]
    assert all(nametrie.shortens(*y) for y in yes) and not any(nametrie.shortens(*n) for n in no)


def test_words_of_names_are_learned(spark):
    r = random.Random(8)
    made = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4)).capitalize()
    raws = [f"{made()} {made()} {t}{r.choice([' Ltd', ' AG', ''])}" for t in ("Zorbing", "Quillery") for _ in range(60)] + [f"{r.choice(['Xanthippus', 'Yoruk'])} {made()}" for _ in range(80)]
    raws += ["Kaluto Merigo Zorbing", "Kaluto Merigo Zorb. Ltd", "Merigo Kaluto Zrbng", "Kaluto Merigo Quillery"]
    names = spark.createDataFrame(list(enumerate(raws)), "name_id bigint, raw string")
    told = names.selectExpr("concat('n', name_id)", "raw").mapInArrow(nametrie._cut, nametrie.WORDS)
    trades, given, sets = nametrie.learned(told)
    assert trades == {"zorbing", "quillery"} and given == {"xanthippus", "yoruk"} and set(sets) >= {"zorbing", "quillery"}
    entity = {r.name_id: r.entity for r in nametrie.groups(names).collect()}
    a, b, c, d = (entity[i] for i in range(len(raws) - 4, len(raws)))
    assert a == b == c != d


def test_names(spark):
    same = [
        ["Voltaekzaem Flourtirfom Robotics Corporation", "ROBOTICS, VOLTAEKZAEM FLOURTIRFOM", "Volt aekzaem Flourtirfom Robot. Corp.", "Voltaekzaem F. Robotics", "The Robotics of Voltaekzaem Flourtirfmo"],
        ["Oliver Saxlorveljoun", "Ollie Saxlorveljoun", "Saxlorveljoun, O.J.", "SAXLORVELJOUN Oliver", "Oluver Saxlorveljoun"], ["Margaret Saxlorveljoun", "Peggy Saxlorveljoun"],
        ["Pimbräestek Feinveixleik Foods AB", "Pimbraestek Feinveixleik Fds."],
    ]
    rows, n = [], 0
    for g in same:
        for raw in g:
            rows.append((n, raw, "clash"))
            n += 1
    rows += [(n, None, "x"), (n + 1, " ", "x"), (n + 2, "Kondolbrous Laerflerfun Optics", "x"), (0, rows[0][1], "clash")]
    alias = spark.createDataFrame([(1, "Kondolbrous Laerflerfun Optics", ["PIMBRÄESTEK FEINVEIXLEIK FOODS"], "r"), (2, None, None, "r")], "group_id int, canonical string, variants array<string>, reason string")
    got = {tuple(r) for r in nametrie.found(spark.createDataFrame(rows, "name_id bigint, raw string, entity string"), alias).collect()}
    want, at = set(), 0
    for g in same:
        ids = list(range(at, at + len(g))) + ([n + 2] if g[0].startswith("Pim") else [])
        want |= {(a, b) for a in ids for b in ids if a < b}
        at += len(g)
    assert got == want


def test_names_in_another_order(spark):
    same = [
        ["Alpha Beta Optics GmbH", "Beta Alpha Optics GmbH", "Optics, Betta Alpha"], ["Aiko Sato", "Sato Aiko"], ["Sato, Mai Rin", "Sato, Rin Mai"],
        ["Gorvalum Tessik Brantor Foods AB", "Brantor Gorvalum Tesik Foods", "Tessik Brantorgorvalum Foods"], ["Nordholm Vinstrand Robotics", "Vin. Nordholm Robotics", "Nordholm Vin. Robotics"],
        ["Aa Bbbb Cccc Dddd Eeee Foods AB", "Eeee Dddd Ccc Bbbb Aa Foods AB"],
    ]
    rows = [(i, raw) for i, raw in enumerate(r for g in same for r in g)]
    got = {tuple(r) for r in nametrie.groups(spark.createDataFrame(rows, "name_id bigint, raw string")).collect()}
    entity, at, seen = dict(got), 0, []
    for g in same:
        assert len({entity[at + i] for i in range(len(g))}) == 1, g
        seen.append(entity[at])
        at += len(g)
    assert len(got) == len(rows) and len(set(seen)) == len(same)


def test_names_of_words_never_heard_of(spark):
    same = [
        ["Brundage", "Brundige", "Brundage AG", "BRUNDAGE gmbh"], ["Kern Adler Optics", "Adler Kern Optics"], ["Volta Mueller Quxing", "Volta Mueller Quxing Inc", "Quxing Mueller Volta"],
        ["Apex Widget Holdings", "Widget Holdings Apex"], ["Phoxwick Trane", "Foxwick Trane"], ["IBX"], ["IBY"],
    ]
    rows = [(i, raw) for i, raw in enumerate(r for g in same for r in g)]
    entity, at, seen = {r.name_id: r.entity for r in nametrie.groups(spark.createDataFrame(rows, "name_id bigint, raw string")).collect()}, 0, []
    for g in same:
        assert len({entity[at + i] for i in range(len(g))}) == 1, g
        seen.append(entity[at])
        at += len(g)
    assert len(set(seen)) == len(same)


def test_pairs_of_a_large_entity_are_dealt_out(spark):
    rows = spark.createDataFrame([(i, "Brundage AG") for i in range(40)], "name_id bigint, raw string")
    got = nametrie.found(rows, spark.createDataFrame([], "group_id int, canonical string, variants array<string>"), hot=7).collect()
    assert sorted(map(tuple, got)) == [(a, b) for a in range(40) for b in range(a + 1, 40)]


def test_spellings_of_applicants_are_grouped(spark):
    names = spark.createDataFrame([(1, "Gorvalum Tessik Optics GmbH"), (2, "Aiko Brantorsen")], "name_id bigint, raw string")
    rows = [{"document_id": "a", "applicants": [("GORVALUM TESIK OPT.", "DE"), ("Gorvalum Tessik Optics GmbH", None), (None, None), (" ", None)]}, {"document_id": "b", "applicants": [("Nordholm Foods AB", None)] * 2}, {"document_id": "c"}]
    got = nametrie.groups(names, None, docs(spark, rows)).collect()
    entity = {(r.name_id, r.spelling): r.entity for r in got}
    assert len(got) == 5 and set(entity) == {(1, "Gorvalum Tessik Optics GmbH"), (2, "Aiko Brantorsen"), (None, "Gorvalum Tessik Optics GmbH"), (None, "GORVALUM TESIK OPT."), (None, "Nordholm Foods AB")}
    assert entity[1, "Gorvalum Tessik Optics GmbH"] == entity[None, "GORVALUM TESIK OPT."] == entity[None, "Gorvalum Tessik Optics GmbH"]
    assert len(set(entity.values())) == 3


# ---------------------------------------------------------------- 6 groups


@pytest.mark.parametrize("chunk", [100_000, 3])
def test_groups_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(forest, "CHUNK", chunk)
    monkeypatch.setattr(forest, "EDGES_PER_PART", 20)
    r = random.Random(chunk)
    edges = [(f"n{r.randrange(80):02d}", f"n{r.randrange(80):02d}") for _ in range(50)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(25)] + [("hub", f"h{i:02d}") for i in range(40)] + [("n00", None)]
    up = forest.UnionFind()
    for a, b in edges:
        if b and a != b:
            up.link(a, b)
    got = forest.connected_groups(spark.createDataFrame(edges, "x string, y string").repartition(6), Scratch(spark, "t")).collect()
    assert {(x.node, x.root) for x in got} == {(n, up.find(n)) for n in list(up.up) if up.find(n) != n}


def test_families(spark):
    rows = [
        {"document_id": "a", "publication_number_raw": "US2A", "source_id": "s", "family_id_simple": "77", "family_members": ["us 9 b", "US2A", None]},
        {"document_id": "b", "publication_number_raw": "US3A", "source_id": "s", "family_id_simple": " 77"}, {"document_id": "c", "publication_number_raw": "US4A", "source_id": "t", "family_id_simple": "77"},
        {"document_id": "d", "publication_number_raw": "EP5", "family_members": ["US9B"]}, {"document_id": "e", "publication_number_raw": "EP6", "source_id": "s", "family_id_simple": "0"},
        {"document_id": "f", "publication_number_raw": "EP7", "source_id": "s", "family_id_simple": "UNKNOWN"}, {"document_id": "g", "publication_number_raw": "EP8", "source_id": "s", "family_id_simple": "0"},
    ]
    assert {tuple(r) for r in forest.family_groups(docs(spark, rows)).collect()} == {("EP5", "US2A"), ("EP5", "US3A")}


# ---------------------------------------------------------------- 7 encoding


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = ["", None, " ", "Hello  world's\n\n  42", "<|endoftext|>", "戻り配管を備える", "ab" * 3000, "a" * 2000, "é́ 🙂"]
    r = random.Random(1)
    texts += ["".join(r.choice("abeé 戻1'\n<🙂") for _ in range(r.randrange(200))) for _ in range(100)]
    tok = Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    got = bpe.encode_corpus(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")).collect()
    assert {x.doc_id: x.ids for x in got} == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


# ---------------------------------------------------------------- 8 mixture


def test_flight_keeps_the_totals():
    r = np.random.default_rng(2)
    x = r.integers(1, 500, 400).astype(float)
    p = np.full(400, 0.3)
    q = mixture.flight(p, np.column_stack([x, np.ones(400)]), r.random(400))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs((x * q).sum() - (x * p).sum()) < 1e-6 and abs(q.sum() - p.sum()) < 1e-6


def test_large_documents_keep_their_probability():
    """Draws of one source by the plan's two strata, and by one flight over all: totals and how often each document comes."""
    import pandas as pd

    r = np.random.default_rng(5)
    size, p, draws = np.concatenate([r.integers(20, 200, 400), [20_000, 15_000, 9_000]]), 0.3, 400
    goal, large = p * size.sum(), size > mixture.LARGE * p * size.sum()
    came, totals, plain = np.zeros(len(size)), [], []
    for seed in range(draws):
        frame = lambda keep, q: pd.DataFrame({"source": "s", "block": 0, "doc_id": np.flatnonzero(keep), "n_tokens": size[keep], "p": q})  # noqa: E731, B023
        drawn = lambda keep, q: mixture._fly(seed, True)(frame(keep, q)).set_index("doc_id")["p"].reindex(range(len(size)), fill_value=0).to_numpy()  # noqa: E731, B023
        first = drawn(large, p)
        got = first + drawn(~large, min(1, max(0, (goal - first @ size) / size[~large].sum())))
        came += got
        totals.append(got @ size)
        plain.append(drawn(size > 0, p) @ size)
    assert np.abs(came / draws - p).max() < 0.12 and abs((came / draws)[large].mean() - p) < 0.06
    assert np.abs(np.array(totals) - goal).mean() < 0.35 * np.abs(np.array(plain) - goal).mean()


def test_mixture_reaches_its_shares(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK", 60)
    r = random.Random(4)
    rows = [(i, "word " * r.randrange(1, 40), "abc"[min(2, i % 5)], 1) for i in range(1500)] + [(9000, None, "a", 1), (9001, "x", None, 1), (None, "x", "a", 1), (0, "word", "a", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 1), ("none", 0.1, 2), ("z", None, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = {x.source: x for x in mixture.shares(d, t).collect()}
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(got[s].actual_share - want) < 0.01 and got[s].most_copies <= got[s].max_repeats
    assert got["none"].tokens == 0
    assert mixture.shares(d.limit(0), t).count() == 4


# ---------------------------------------------------------------- 9 cut-offs


def test_cut_texts(spark):
    r = random.Random(6)
    nouns = ["valve", "seal", "sleeve", "spring", "nozzle", "bracket"]
    sentence = lambda: f"The {r.choice(nouns)} is fixed to the {r.choice(nouns)} by means of a clamping ring."
    whole = [" ".join(sentence() for _ in range(4)) for _ in range(150)]
    rows = [(i, t, "src", "abstract", 0) for i, t in enumerate(whole)]
    cut = ["The valve is fixed to the seal by means", "The seal is fixed to the spring by me", "The nozzle is fixed to the […]", "The seal is fixed to the spring by means of a cla</b"]
    fine = ["The seal is fixed to the spring by means of a clamping ring", "The valve is fixed to the seal by means of a clamping ring.\n\n", "", None, "  "]
    rows += [(1000 + i, whole[0] + " " + t, "src", "abstract", 0) for i, t in enumerate(cut)] + [(2000 + i, t, None, None if i else "abstract", 0) for i, t in enumerate(fine)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, section string, h int")
    assert {x.doc_id for x in cutoff.found(df).collect()} == {1000, 1001, 1002, 1003}
    many = [(5000, whole[0] + " The nozzle is fixed to the <" + "a" * 100_000, "src", "abstract", 0), (5001, whole[0] + ' " )' * 50_000, "src", "abstract", 0), (5002, "The seal is fixed" + " \n" * 100_000 + "to the", None, "abstract", 0)]
    long = spark.createDataFrame(rows + many, df.schema)
    assert {x.doc_id for x in cutoff.found(long).collect()} == {1000, 1001, 1002, 1003, 5000, 5002}
    by = {x.source: x for x in cutoff.by_source(df).collect()}
    assert by["src"].n_cut == 4 and by[None].n_cut == 0
    assert cutoff.found(df.where(F.lit(False))).count() == 0


def test_title_words_decide_where_trigrams_are_few(spark):
    ends = [f"a {x} {y}" for x in ("red", "blue", "green", "wide") for y in ("valve", "seal")] + ["two pumps"]
    titles = [f"Device for metering {x} using {y}" for x in ends for y in ends]
    titles = titles[:78] + ["Device for metering two pumps using a", "Device for metering a red seal using a"]
    df = spark.createDataFrame([(i, t, "s", "title") for i, t in enumerate(titles)], "doc_id bigint, text string, source string, section string")
    assert {x.doc_id for x in cutoff.found(df).collect()} == {78, 79}
