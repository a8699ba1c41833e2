"""Pages, lookups, files, stored payloads, datasets and versions."""

import datetime
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from terrane.sinks import datasets, rawstore, shred, versions
from terrane.sources import files, lookup, pages

DAY = datetime.date(2021, 5, 6)


def page(body="", number="NZ5500A1", country="NZ", kind="A1", article="itemscope"):
    return (
        f'<!doctype html><html><head><meta charset="utf-8"><link rel=x></head><body><article {article}><meta itemprop="publicationNumber" content="{number}"><br>'
        f'<span itemprop="countryCode">{country}</span><span itemprop="kindCode">{kind}</span>{body}</article></body></html>'
    )


def row(prop, *parts):
    return f'<tr itemprop="{prop}" itemscope>' + "".join(f'<td itemprop="{n}">{v}</td>' for n, v in parts) + "</tr>"


# ---------------------------------------------------------------- pages


def test_a_page_with_every_field():
    body = """<h1 itemprop="title"> Pump &amp;
      ram </h1><span itemprop="applicationNumber">NZ 1/2</span><time itemprop="priorityDate" datetime="2001-02-03">3 Feb</time><time itemprop="filingDate" datetime="2002-02-03">x</time>
      <meta itemprop="publicationDate" content="2003-02-03">
      <section itemprop="abstract"><h2>Abstract</h2><abstract load-source="docdb" source="national office" lang="EN">Lifts <b>water</b>.</abstract></section>
      <section itemprop="claims"><div class="big claims" load-source="patent-office" lang="en">1. A ram.<br>2. A pump.</div></section>
      <dd itemprop="assigneeOriginal">Kiln Ltd</dd><dd itemprop="assigneeOriginal"> </dd><dd itemprop="assigneeOriginal">Works AG</dd><dd itemprop="inventor">Ada Ohm</dd>"""
    body += row("events", ("type", "granted"), ("date", "2003-02-03")) + row("events", ("type", "publication"), ("title", "Publication of NZ5500A1"), ("date", "2003-02-03"))
    body += row("classifications", ("Code", "F16K 03/02"), ("Leaf", "true"), ("IsCPC", "true")) + row("classifications", ("Code", "F16K"), ("Leaf", "false"), ("IsCPC", "true")) + row("classifications", ("Code", "F16K1/00"), ("Leaf", "true"), ("IsCPC", "false"))
    body += row("docdbFamily", ("publicationNumber", "AU 77 B")) + row("docdbFamily", ("publicationNumber", "NZ5500A1")) + row("docdbFamily", ("publicationNumber", "AU77B"))
    body += row("backwardReferences", ("publicationNumber", "DE12 C"), ("examinerCited", "*")) + row("backwardReferences", ("publicationNumber", "DE13C"), ("examinerCited", "†")) + row("detailedNonPatentLiterature", ("title", "A book"))
    body += row("forwardReferences", ("publicationNumber", "AU88B")) + row("legalStatusIfi", ("status", "Expired - Fee Related"))
    body += '<div itemprop="similar" itemscope><span itemprop="title">another</span><meta itemprop="publicationNumber" content="ZZ1"></div>'
    got = pages.parse_page(page(body), DAY)
    assert got["quarantine"] is None and got["warnings"] == [] and got["publication"] == {"country": "NZ", "number": "5500", "kind": "A1"}
    assert (got["title"], got["abstract"], got["claims"], got["language"], got["application_number_raw"]) == ("Pump & ram", "Lifts water.", "1. A ram.2. A pump.", "en", "NZ 1/2")
    assert [got[f] for f in ("earliest_priority_date", "filing_date", "publication_date", "grant_date")] == [datetime.date(y, 2, 3) for y in (2001, 2002, 2003, 2003)]
    assert [(p["role"], p["sequence"], p["name_raw"]) for p in got["applicants"] + got["inventors"]] == [("applicant", 1, "Kiln Ltd"), ("applicant", 2, "Works AG"), ("inventor", 1, "Ada Ohm")]
    assert [(c["code"], c["code_raw"]) for c in got["cpc"]] == [("F16K3/02", "F16K 03/02")] and got["family_members"] == ["AU77B"]
    assert [(b["publication_number"] or b["npl_text"], b["origin"]) for b in got["backward_citations"]] == [("DE12C", "examiner"), ("DE13C", "third_party"), ("A book", "unknown")]
    assert got["forward_citations"] == {"citing_publication_numbers": ["AU88B"], "as_of": DAY} and got["legal_status"] == {"category": "lapsed", "status_raw": "Expired - Fee Related", "as_of": DAY}
    assert dict(got["missing"]) == dict.fromkeys(["family_id_simple", "family_id_extended", "priorities", "ipc"], "not_provided_by_source")


@pytest.mark.parametrize("html,reason", [
    (None, "0 article items"), ("", "0 article items"), ("plain text", "0 article items"), (page(article=""), "0 article items"), (page() + page(), "2 article items"), (page(number="junk"), "not a publication number: 'junk'"),
    (page(country="AU"), "NZ5500A1 disagrees with country AU and kind A1"), (page(kind="A2"), "NZ5500A1 disagrees with country NZ and kind A2"), (page(number=""), "page without publicationNumber"),
    *[(page(f'<time itemprop="filingDate" datetime="{d}">'), f"filingDate: not an ISO date: '{d}'") for d in ("20020203", "2002-W05-7", "2002-02-30", "3.2.2002")],
    (page(row("classifications", ("Code", "F16K3"), ("Leaf", "true"), ("IsCPC", "true"))), "not a classification code: 'F16K3'"), (page(row("docdbFamily", ("x", "y"))), "family row without publicationNumber"),
    (page(row("detailedNonPatentLiterature", ("x", "y"))), "citation row without text"),
])
def test_pages_in_quarantine(html, reason):
    got = pages.parse_page(html, DAY)
    assert got["quarantine"] == reason and all(got[f] is None for f in pages.FIELDS)


@pytest.mark.parametrize("body,field,reason", [
    ('<span itemprop="title">Pump</span><span itemprop="translatedLanguage">x</span>', "title", "unparseable"), ('<section itemprop="abstract"><abstract load-source="WIPO-OCR">x</abstract></section>', "abstract", "unparseable"),
    ('<section itemprop="abstract"><abstract load-source="docdb">x</abstract></section>', "abstract", "unparseable"), ('<section itemprop="abstract"></section>', "abstract", "not_provided_by_source"),
    (row("events", ("type", "granted"), ("date", "2003-02-03")), "grant_date", "not_provided_by_source"), (row("events", ("type", "publication"), ("title", "Publication of NZ5500A1"), ("date", "2003-02-03")), "grant_date", "not_applicable"),
    (row("docdbFamily", ("publicationNumber", "junk")), "family_members", "unparseable"), (row("backwardReferences", ("publicationNumber", "junk")), "backward_citations", "unparseable"), (row("forwardReferences", ("publicationNumber", "junk")), "forward_citations", "unparseable"),
    (row("docdbFamily", ("publicationNumber", "NZ5500A1")), "family_members", "not_provided_by_source"), ('<section itemprop="claims"><div class="claims" load-source="patent-office" lang="english">1.</div></section>', "language", "not_provided_by_source"),
])
def test_fields_of_a_page_that_are_missing(body, field, reason):
    got = pages.parse_page(page(body), DAY)
    assert got["quarantine"] is None and got[field] is None and dict(got["missing"])[field] == reason
    assert bool(got["warnings"]) == ("junk" in body)


def test_very_long_and_deep_pages():
    got = pages.parse_page(page('<span itemprop="title">' + "<b>" * 20_000 + "x" * 200_000 + "</b>" * 20_000 + "</span></nothing>"), DAY)
    assert len(got["title"]) == 200_000


# ---------------------------------------------------------------- lookup


@pytest.mark.parametrize("answers,outcome,waits", [
    ([lookup.Response(200, page=page())], "ok", []), ([lookup.Response(200, page="<p>")], "failed", []), ([lookup.Response(200, "/sorry", page())], "failed", []), ([lookup.Response(403)], "failed", []),
    ([lookup.Response(429), lookup.Response(503), lookup.Response(0, broken="timeout"), lookup.Response(200, page=page())], "ok", [2, 4, 8]), ([lookup.Response(500)] * 6, "failed", [2, 4, 8, 16, 30]),
])
def test_retries(answers, outcome, waits):
    left, slept = list(answers), []
    got = lookup.fetch("NZ5500", lambda path: left.pop(0), slept.append, retries=len(waits) if outcome == "failed" else 5)
    assert (got["outcome"], slept, left) == (outcome, waits, []) and (got["page"] is not None) == (outcome == "ok")


def test_a_kind_that_is_not_there():
    asked = []

    def get(path):
        asked.append(path)
        return lookup.Response(200, path, page()) if path == "/patent/NZ5500/" else lookup.Response(404, path)

    got = lookup.fetch("nz 5500 b", get)
    assert asked == ["/patent/NZ5500B/", "/patent/NZ5500/"] and got["outcome"] == "ok" and got["kind_fallback"] and got["detail"] == "kind B not found; looked up NZ5500"
    assert lookup.fetch("NZ77", get)["outcome"] == "not_found" and lookup.fetch("NZ77B", get)["detail"].startswith("kind B not found; looked up NZ77: ")
    assert lookup.fetch("junk", get)["outcome"] == "invalid_request"


def test_stored_pages_as_a_data_source(spark, tmp_path):
    store = str(tmp_path / "pages")
    spark.createDataFrame([("NZ5500A1", page()), ("NZ77", page(number="NZ77", kind=""))], "id string, page string").write.parquet(store)
    spark.dataSource.register(lookup.StoredPages)
    keys = ["NZ 5500 A1", "NZ77B", "NZ99", "junk"]
    got = spark.read.format("stored_pages").option("keys", json.dumps(keys)).option("store", store).option("chunk", "2").load()
    assert {r.requested_key: (r.outcome, r.kind_fallback) for r in got.collect()} == {"NZ 5500 A1": ("ok", False), "NZ77B": ("ok", True), "NZ99": ("not_found", False), "junk": ("invalid_request", False)}


# ---------------------------------------------------------------- files


def test_records_of_three_kinds(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "t": "x"}\nnot json\n')
    (tmp_path / "a.csv").write_text('id,t\n1,"x"\n')
    (tmp_path / "a.xml").write_text("<rs><record><id>1</id><t>x</t></record></rs>")
    for kind in ("json", "csv", "xml"):
        rows = files.records(spark, str(tmp_path / f"a.{kind}"), kind, "id int, t string").collect()
        assert (rows[0].id, rows[0].t) == (1, "x") and (kind != "json" or rows[1][files.BAD] == "not json")
    with pytest.raises(files.SourceError):
        files.records(spark, "x", "pdf", "id int")


def test_folder_with_problems(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in (("NZ5500A1.txt", "text"), ("sub/nz 5500 a1.txt", "text"), ("notes.txt", "text"), ("AU7.txt", ""), ("AU8.txt", " -- ")):
        (tmp_path / name).write_text(content)
    scanned = files.scan_folder(spark, str(tmp_path))
    assert {(r.file.replace("%20", " "), r.publication, r.problem) for r in scanned.collect()} >= {("NZ5500A1.txt", "NZ5500A1", None), ("notes.txt", None, "no number in the name"), ("AU8.txt", "AU8", "no text")}
    total = files.folder_summary(scanned).first()
    assert (total.files, total.contents, total.problems) == (4, 2, 2)


def test_folder_is_read_in_pieces(spark, tmp_path):
    late = b" " * (5 << 19) + b"x"
    (tmp_path / "NZ5500A1 100%20.bin").write_bytes(late)
    for b in range(1, 256):
        (tmp_path / f"{b}.sign").write_bytes(bytes([b]))
    signs = {f"{b}.sign" for b in range(256) if chr(b).isalnum()}
    most = "spark.sql.sources.binaryFile.maxLength"  # What Spark would read whole, it refuses beyond this.
    spark.conf.set(most, "1")
    try:
        got = {r.file: r for r in files.scan_folder(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(most)
    assert len(got) == 256 and {n for n, r in got.items() if n.endswith(".sign") and r.problem != "no text"} == signs
    large = got["NZ5500A1 100%20.bin"]
    assert (large.length, large.sha256, large.problem) == (len(late), hashlib.sha256(late).hexdigest(), "no number in the name")


def test_settings(tmp_path):
    f = tmp_path / "s.yaml"
    f.write_text("a: 1\nb: [x]\n")
    assert files.settings(str(f), {"a": int, "b": list}) == {"a": 1, "b": ["x"]}
    for needed in ({"a": int}, {"a": int, "b": list, "c": str}, {"a": str, "b": list}):
        with pytest.raises(files.SourceError):
            files.settings(str(f), needed)


def zipped(**texts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in texts.items():
            z.writestr(n, t)
    return out.getvalue()


F_LIST = ["F\t\tMachines", "F16\t\tElements", "F16K\t\tValves", "F16K3/00\t0\tGate valves", "F16K3/02\t1\tSliding", "F16K2003/022\t2\tIndexing", "", "F16K5/00\t0\tPlug valves"]


def test_title_lists():
    edition, rows = files.title_lists(zipped(**{"cpc-section-F_20260801.txt": "\n".join(F_LIST)}))
    assert edition == "2026.08" and [(r[1], r[2], r[3], r[5]) for r in rows] == [
        ("F", "section", None, None), ("F16", "class", None, "F"), ("F16K", "subclass", None, "F16"), ("F16K3/00", "main_group", 0, "F16K"), ("F16K3/02", "subgroup", 1, "F16K3/00"), ("F16K2003/022", "subgroup", 2, "F16K3/02"), ("F16K5/00", "main_group", 0, "F16K"),
    ]


@pytest.mark.parametrize("change", [(1, "F17\t\tx"), (3, "F16K3/00\t-1\tx"), (3, "F16K3/00\tx\tx"), (3, "F16K3/00\t0"), (4, "F16K3/02\t2\tx"), (4, "F16K4/02\t1\tx"), (4, "G16K3/02\t1\tx"), (5, "F16K1003/022\t2\tx"), (7, "F16K3/00\t0\tx"), (2, "F16K\t0\tx"), (0, "F")])
def test_title_lists_with_errors(change):
    lines = list(F_LIST)
    lines[change[0]] = change[1]
    with pytest.raises(files.SourceError):
        files.title_lists(zipped(**{"cpc-section-F_20260801.txt": "\n".join(lines)}))


@pytest.mark.parametrize("content", [b"no zip", zipped(), zipped(**{"readme.txt": "x"}), zipped(**{"cpc-section-F_20260801.txt": "F\t\tx", "cpc-section-A_20260802.txt": "A\t\tx"}), zipped(**{"cpc-section-F_20261301.txt": "F\t\tx"})])
def test_zips_that_are_no_title_lists(content):
    with pytest.raises(files.SourceError):
        files.title_lists(content)


# ---------------------------------------------------------------- stored payloads, datasets, versions


def test_payloads_are_stored_once_and_verified(spark, tmp_path):
    root = str(tmp_path / "raw")
    rows = spark.createDataFrame([("s", "one"), ("s", "one"), ("t", "one"), ("s", None)], "source_id string, content string")
    assert rawstore.put(rows, root).count() == 2 and rawstore.put(rows, root).count() == 2
    stored = rawstore.read(spark, root)
    assert stored.count() == 2 and rawstore.verified(stored).where("not intact").isEmpty()
    assert rawstore.verified(stored.withColumn("content", F.lit("two"))).where("intact").isEmpty()


def test_replay(spark):
    t = datetime.datetime(2021, 5, 6)
    stored = spark.createDataFrame([("raw/s/a/" + h, h, c, t) for h, c in ((versions.digest(page()), page()), ("0" * 64, page()))], "object_key string, sha256 string, content string, retrieved_at timestamp")
    keys = [r.object_key for r in stored.collect()]
    items = [("k1", "failed", None, t, "1"), ("k1", "stored", keys[0], t, "2"), ("k2", "duplicate", keys[1], None, "3"), ("k3", "not_found", None, t, "4"), ("k4", "invalid_request", None, t, "5"), ("k5", "not_found", None, t, "6")]
    docs, left = rawstore.replay(spark.createDataFrame(items, "requested_key string, outcome string, object_key string, created_at timestamp, id string"), stored)
    assert {r.id: (r.publication and r.publication.number, r.quarantine) for r in docs.collect()} == {"k1": ("5500", None), "k2": (None, "stored page is corrupt")}
    assert {r.outcome: r.n for r in left.collect()} == {"not_found": 2, "invalid_request": 1}


def test_shredded_documents_come_back(spark):
    shape = "id int, t string, applicants array<struct<name:string>>, family_members array<string>"
    rows = [(1, "x", [("b",), ("a",), None], ["m", None, "m"]), (2, None, [], None), (3, "z", None, [])]
    docs = spark.createDataFrame(rows, shape)
    back = shred.reassemble(*shred.shred(docs, "id"), "id").select(docs.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))


def test_datasets_are_whole_or_not_there(spark, tmp_path):
    root, df = str(tmp_path / "sets"), spark.createDataFrame([(1, ["a"]), (2, None)], "id int, x array<string>")
    made = datasets.write({"a": df, "b": df.limit(0)}, root, "run", {"rule": "latest"})
    assert made["tables"]["a"]["rows"] == 2 and datasets.manifest(spark, root, "run") == made and datasets.read(spark, root, "run", "a").count() == 2
    with pytest.raises(datasets.DatasetError, match="exists"):
        datasets.write({"a": df}, root, "run", {})
    with pytest.raises(Exception):
        datasets.write({"a": df, "bad": df.select(F.raise_error(F.lit("no")).alias("x"))}, root, "other", {})
    with pytest.raises(datasets.DatasetError, match="no dataset"):
        datasets.read(spark, root, "other", "a")
    df.limit(1).write.mode("append").parquet(f"{root}/run/a")
    with pytest.raises(datasets.DatasetError, match="changed"):
        datasets.read(spark, root, "run", "a")


def test_inputs_of_a_dataset(spark):
    items = spark.createDataFrame([("b", "stored", "r1"), ("c", None, None), ("d", "not_found", None)], "batch_id string, outcome string, raw_record_id string")
    docs = spark.createDataFrame([("d1", "r1"), ("d1", "r1"), ("d2", "r2")], "document_id string, raw_record_id string")
    assert [r.document_id for r in datasets.inputs(docs, items, ["b"]).collect()] == ["d1"]
    for batches in ([], ["x"], ["b", "c"], ["d"]):
        with pytest.raises(datasets.DatasetError):
            datasets.inputs(docs, items, batches)
    batch = datasets.start_batch(["NZ 1", "nz1", "AU2"], "s", {"type": "list"}, "2021-05-06", lambda: "id", lambda k: k.replace(" ", "").upper())
    assert batch["requested"] == ["NZ 1", "AU2"] and batch["repeated"] == 1 and batch["provenance"] == '{"type":"list"}'
    assert datasets.report("Run", {"Outcomes": {"stored": 1200}}).endswith("| stored | 1,200 |\n")


def test_versions(spark, tmp_path):
    s = versions.Store(spark, str(tmp_path / "store"))
    assert s.add("scope", {"a": 1}, "ada") == 1 and s.add("scope", {"a": 2}, "ada", parent=1) == 2
    for parent in (None, 1, 3):
        with pytest.raises(datasets.DatasetError):
            s.add("scope", {"a": 3}, "bob", parent=parent)
    assert versions.parsed(s.get("scope")) == {"a": 2} and versions.parsed(s.get("scope", 1)) == {"a": 1}
    assert s.load_once("edition", ["x"], "ada") == s.load_once("edition", ["x"], "bob") == 1
    with pytest.raises(datasets.DatasetError, match="other content"):
        s.load_once("edition", ["y"], "bob")
    s.decide("scope", 1, "approved", "eve")
    s.decide("scope", 2, "approved", "eve")
    s.decide("scope", 2, "rejected", "eve")
    for bad in (("scope", 2, "approved", " "), ("scope", 9, "approved", "eve")):
        with pytest.raises(datasets.DatasetError):
            s.decide(*bad)
    assert [(r["name"], r.version) for r in versions.approved(s.versions(), s.decisions()).collect()] == [("scope", 1)]
    assert versions.broken(s.versions()).isEmpty() and versions.broken(s.versions().withColumn("content", F.lit("x"))).count() == 3
    scope = {"date_from": "2001-01-01", "date_to": "2000-01-01", "countries": ["NZ", "nz"], "known_relevant": ["NZ5500A1", "NZ5500B2"], "confirmed_by": ""}
    assert len(versions.scope_problems(scope)) == 4 and versions.scope_problems({"date_from": "2000", "date_to": "2001"}) == []
