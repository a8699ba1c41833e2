"""Microdata pages of single publications: written from documents, and parsed back to documents with reasons and warnings.

Parsing goes in three steps: HTML to a tree, the tree to items (an item has properties, whose values are texts or items), and
items to fields by a table of readers. A field that can't be read is null with the reason in ``missing``; where an entry of a
list can't be read, the list is null and the entry is named in ``warnings``; what makes the whole record unreliable puts it into
quarantine, with the reason and no fields.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.ident import CODE_SHAPE, read_number

# Tags without an end, wordings of a legal status and what they stand for, markers of who cited, what makes
# a text official, and the reasons of a missing field.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
STATUS = {
    "Pending": "pending", "Granted": "granted", "Active": "active", "Expired - Lifetime": "expired", "Expired - Fee Related": "lapsed",
    "Abandoned": "withdrawn", "Withdrawn": "withdrawn", "Revoked": "revoked",
}
ORIGIN = {"*": "examiner", "†": "third_party"}
OFFICIAL = {("patent-office", None), ("docdb", "national office")}
NOT_PROVIDED, UNPARSEABLE, NOT_APPLICABLE = "not_provided_by_source", "unparseable", "not_applicable"


class Node:
    """An element with its attributes and children, which are nodes or texts."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def all(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return " ".join("".join(out).split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):  # an end without a beginning is passed over
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(page: str) -> Node:
    t = _Tree()
    t.feed(page)
    t.close()
    return t.root


class Item:
    """The properties of an item: name to (node, item or None) in order. Those of an item inside belong to that."""

    def __init__(self, scope: Node):
        self.props: dict[str, list[tuple[Node, Item | None]]] = {}
        stack = [c for c in reversed(scope.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            inner = Item(node) if "itemscope" in node.attrs else None
            for name in (node.attrs.get("itemprop") or "").split():
                self.props.setdefault(name, []).append((node, inner))
            if inner is None:
                stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def items(self, name: str) -> list[Item]:
        return [item if item is not None else Item(node) for node, item in self.props.get(name, ())]

    def texts(self, name: str) -> list[str]:
        return [value(node) for node, _ in self.props.get(name, ())]

    def first(self, name: str) -> str | None:
        return (self.texts(name) or [None])[0] or None


def value(node: Node) -> str:
    if node.tag in ("meta", "time"):
        said = next((node.attrs[a] for a in ("content", "datetime") if node.attrs.get(a) is not None), None)
        if said is not None:
            return said.strip()
    return node.text()


class Quarantine(Exception):
    """The page as a whole can't be relied on."""


class Unreadable(Exception):
    """An entry of a list can't be read."""


def iso_date(text: str | None, field: str) -> datetime.date | None:
    if text is None:
        return None
    try:
        if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
            raise ValueError
        return datetime.date.fromisoformat(text)
    except ValueError:
        raise Quarantine(f"{field}: not an ISO date: {text!r}") from None


def number(raw: str | None, what: str) -> str:
    if raw is None:
        raise Quarantine(f"{what} without publicationNumber")
    parts = read_number(raw)
    if parts is None:
        raise Unreadable(f"not a publication number: {raw!r}")
    return "".join(p or "" for p in parts)


# ---------------------------------------------------------------- readers


def _official(item: Item, section: str, is_block: Callable[[Node], bool]) -> tuple[str | None, str | None, str]:
    """Text, language, and the reason if there is none."""
    for node, _ in item.props.get(section, ())[:1]:
        for block in node.all():
            if block is not node and is_block(block):
                source, office = block.attrs.get("load-source"), block.attrs.get("source")
                if (source, office) not in OFFICIAL and (source, None) not in OFFICIAL:
                    return None, None, UNPARSEABLE
                return block.text() or None, (block.attrs.get("lang") or "").lower() or None, NOT_PROVIDED
    return None, None, NOT_PROVIDED


def _grant(item: Item, pub: str) -> tuple[datetime.date | None, str]:
    """A grant counts if its day is that of this very publication; events belong to the whole application."""
    granted = own = None
    for event in item.items("events"):
        if event.first("type") == "granted":
            granted = iso_date(event.first("date"), "events.granted.date")
        elif event.first("type") == "publication" and event.first("title") == f"Publication of {pub}":
            own = iso_date(event.first("date"), "events.publication.date")
    if own is None:
        return None, NOT_PROVIDED
    return (granted, NOT_PROVIDED) if granted == own else (None, NOT_APPLICABLE)


def _family(item: Item, pub: str) -> list[str] | None:
    rows = item.items("docdbFamily")
    told = dict.fromkeys(number(r.first("publicationNumber"), "family row") for r in rows)
    return [n for n in told if n != pub] if rows else None


def _parties(item: Item, prop: str, role: str) -> list[dict]:
    names = [t for t in item.texts(prop) if t]
    return [{"role": role, "sequence": k, "name_raw": n, "country": None, "country_missing": NOT_PROVIDED} for k, n in enumerate(names, 1)]


def _codes(scope: Node) -> list[dict]:
    out = []
    for node in scope.all():
        if node.attrs.get("itemprop") == "classifications" and "itemscope" in node.attrs:
            item = Item(node)
            raw = item.first("Code")
            if raw and item.first("Leaf") == item.first("IsCPC") == "true":
                m = re.fullmatch(CODE_SHAPE.strip("^$"), re.sub(r"\s", "", raw.upper()))
                if m is None:
                    raise Quarantine(f"not a classification code: {raw!r}")
                out.append({"scheme": "cpc", "code": f"{m[1]}{int(m[2])}/{m[3]}", "code_raw": raw})
    return out


def _backward(item: Item) -> list[dict] | None:
    patents, others = item.items("backwardReferences"), item.items("detailedNonPatentLiterature")
    out = []
    for row in patents:
        raw = row.first("publicationNumber")
        out.append({"kind": "patent", "publication_number": number(raw, "citation row"), "publication_number_raw": raw, "npl_text": None, "origin": ORIGIN.get(row.first("examinerCited") or "", "unknown")})
    for row in others:
        if (text := row.first("title")) is None:
            raise Quarantine("citation row without text")
        out.append({"kind": "npl", "publication_number": None, "publication_number_raw": None, "npl_text": text, "origin": ORIGIN.get(row.first("examinerCited") or "", "unknown")})
    return out if patents or others else None


def _forward(item: Item, as_of: datetime.date | None) -> dict | None:
    rows = item.items("forwardReferences")
    return {"citing_publication_numbers": [number(r.first("publicationNumber"), "citing row") for r in rows], "as_of": as_of} if rows else None


FIELDS = {
    "publication": pa.struct([("country", pa.string()), ("number", pa.string()), ("kind", pa.string())]), "publication_number_raw": pa.string(), "application_number_raw": pa.string(),
    "family_id_simple": pa.string(), "family_id_extended": pa.string(), "family_members": pa.list_(pa.string()), "earliest_priority_date": pa.date32(),
    "priorities": pa.list_(pa.struct([("number_raw", pa.string()), ("country", pa.string()), ("date", pa.date32())])), "filing_date": pa.date32(), "publication_date": pa.date32(), "grant_date": pa.date32(),
    "title": pa.string(), "abstract": pa.string(), "claims": pa.string(), "language": pa.string(),
    **{f: pa.list_(pa.struct([("role", pa.string()), ("sequence", pa.int32()), ("name_raw", pa.string()), ("country", pa.string()), ("country_missing", pa.string())])) for f in ("applicants", "inventors")},
    **{f: pa.list_(pa.struct([("scheme", pa.string()), ("code", pa.string()), ("code_raw", pa.string())])) for f in ("cpc", "ipc")},
    "legal_status": pa.struct([("category", pa.string()), ("status_raw", pa.string()), ("as_of", pa.date32())]),
    "backward_citations": pa.list_(pa.struct([("kind", pa.string()), ("publication_number", pa.string()), ("publication_number_raw", pa.string()), ("npl_text", pa.string()), ("origin", pa.string())])),
    "forward_citations": pa.struct([("citing_publication_numbers", pa.list_(pa.string())), ("as_of", pa.date32())]),
}
OPTIONAL = [f for f in FIELDS if f not in ("publication", "publication_number_raw")]
OUT = {**FIELDS, "missing": pa.map_(pa.string(), pa.string()), "warnings": pa.list_(pa.string()), "quarantine": pa.string()}


def parse_page(page: str | None, as_of: datetime.date | None = None, status: dict[str, str] | None = None) -> dict:
    """The document of one page (see FIELDS), with ``missing``, ``warnings`` and ``quarantine``."""
    out = dict.fromkeys(OUT)
    try:
        return {**out, **_document(page or "", as_of, STATUS if status is None else status)}
    except (Quarantine, Unreadable) as e:
        return {**out, "quarantine": str(e)}


def _document(page: str, as_of: datetime.date | None, status: dict[str, str]) -> dict:
    scopes = [n for n in tree(page).all() if n.tag == "article" and "itemscope" in n.attrs]
    if len(scopes) != 1:
        raise Quarantine(f"{len(scopes)} article items")
    item = Item(scopes[0])
    raw = item.first("publicationNumber")
    pub = number(raw, "page")
    country, _, kind = parts = read_number(raw)
    if (item.first("countryCode"), item.first("kindCode")) != (country, kind):
        raise Quarantine(f"{raw} disagrees with country {item.first('countryCode')} and kind {item.first('kindCode')}")
    why: dict[str, str] = {}
    abstract, lang, why["abstract"] = _official(item, "abstract", lambda n: n.tag == "abstract")
    claims, claims_lang, why["claims"] = _official(item, "claims", lambda n: "claims" in (n.attrs.get("class") or ""))
    language = lang or claims_lang
    granted, why["grant_date"] = _grant(item, pub)
    translated = any(n.attrs.get("itemprop") == "translatedLanguage" for n in scopes[0].all())
    why["title"] = UNPARSEABLE if translated else NOT_PROVIDED
    said = (item.items("legalStatusIfi") or [None])[0]
    said = said.first("status") if said else None
    got = {
        "application_number_raw": item.first("applicationNumber"), "title": None if translated else item.first("title"), "abstract": abstract, "claims": claims,
        "language": language if re.fullmatch("[a-z]{2}", language or "") else None, "grant_date": granted,
        **{f: iso_date(item.first(p), p) for f, p in (("earliest_priority_date", "priorityDate"), ("filing_date", "filingDate"), ("publication_date", "publicationDate"))},
        "applicants": _parties(item, "assigneeOriginal", "applicant"), "inventors": _parties(item, "inventor", "inventor"), "cpc": _codes(scopes[0]),
        "legal_status": {"category": status.get(said, "other"), "status_raw": said, "as_of": as_of} if said else None,
    }
    warnings = []
    for field, reader in (("family_members", lambda: _family(item, pub)), ("backward_citations", lambda: _backward(item)), ("forward_citations", lambda: _forward(item, as_of))):
        try:
            got[field] = reader() or None
        except Unreadable as e:
            warnings.append(f"{field}: {e}")
            why[field] = UNPARSEABLE
    got = {f: v if v or isinstance(v, datetime.date) else None for f, v in got.items()}
    missing = {f: why.get(f, NOT_PROVIDED) for f in OPTIONAL if got.get(f) is None}
    return {**got, "publication": dict(zip(("country", "number", "kind"), parts)), "publication_number_raw": raw, "missing": list(missing.items()), "warnings": warnings}


def parse_pages(pages: DataFrame, status: dict[str, str] | None = None) -> DataFrame:
    """(id STRING, page STRING, retrieved_at TIMESTAMP) to documents; pages are parsed in batches of Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows = [parse_page(p, t and t.date(), status) for p, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[f] for r in rows], t) for f, t in OUT.items()]], ["id", *OUT])

    from pyspark.sql.pandas.types import from_arrow_schema

    shape = from_arrow_schema(pa.schema([("id", pa.string()), *OUT.items()]))
    return pages.select("id", "page", "retrieved_at").mapInArrow(run, shape)


# ---------------------------------------------------------------- writing


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def _span(prop: str, c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(f'<span itemprop="{prop}">'), _escaped(c.cast("string")), F.lit("</span>")))


def _meta(prop: str, c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(f'<meta itemprop="{prop}" content="'), _escaped(c.cast("string")), F.lit('">')))


def _rows(c: Column, prop: str, *parts: Callable[[Column], Column]) -> Column:
    row = lambda x: F.concat_ws("", F.lit(f'<li itemprop="{prop}" itemscope>'), *[p(x) for p in parts], F.lit("</li>"))
    return F.array_join(F.transform(F.coalesce(c, F.array().cast(c_type(prop))), row), "")


def c_type(prop: str) -> str:
    names = {"docdbFamily": "array<string>", "forwardReferences": "array<string>", "classifications": "array<struct<scheme:string,code:string,code_raw:string>>"}
    return names.get(prop, "array<struct<kind:string,publication_number:string,publication_number_raw:string,npl_text:string,origin:string>>")


def as_pages(docs: DataFrame) -> DataFrame:
    """Documents (of the shape of patent_document, with pub and office) as pages (id, page, retrieved_at)."""
    kind = F.nullif(F.regexp_extract("pub", r"([A-Z][0-9]?)$", 1), F.lit(""))
    mark = lambda x: F.when(x["origin"] == "examiner", F.lit('<span itemprop="examinerCited">*</span>')).when(x["origin"] == "third_party", F.lit('<span itemprop="examinerCited">†</span>'))
    names = lambda c, prop: F.array_join(F.transform(F.coalesce(F.col(f"{c}.name_raw"), F.array().cast("array<string>")), lambda n: F.coalesce(_span(prop, n), F.lit(""))), "")
    block = lambda tag, c, attrs: F.when(c.isNotNull(), F.concat(F.lit(f'<section itemprop="{attrs}"><{tag} load-source="patent-office"'), F.coalesce(F.concat(F.lit(' lang="'), "language", F.lit('"')), F.lit("")), F.lit(f' class="{attrs}">'), _escaped(c), F.lit(f"</{tag}></section>")))
    event = lambda t, date, title: F.when(date.isNotNull(), F.concat(F.lit('<dd itemprop="events" itemscope><span itemprop="type">'), F.lit(t), F.lit('</span><time itemprop="date" datetime="'), date.cast("string"), F.lit('">on that day</time><span itemprop="title">'), title, F.lit("</span></dd>")))
    of_kind = lambda k: F.filter("backward_citations", lambda b: b["kind"] == k)
    page = F.concat_ws(
        "", F.lit("<!doctype html><html><body><br><article itemscope>"), _meta("publicationNumber", F.col("pub")), _span("countryCode", F.col("office")), _span("kindCode", kind), _span("title", F.col("title")),
        _span("applicationNumber", F.col("application_number_raw")), *[_meta(p, F.col(c)) for c, p in (("earliest_priority_date", "priorityDate"), ("filing_date", "filingDate"), ("publication_date", "publicationDate"))],
        block("abstract", F.col("abstract"), "abstract"), block("div", F.col("claims"), "claims"), names("applicants", "assigneeOriginal"), names("inventors", "inventor"),
        event("granted", F.col("grant_date"), F.lit("granted")), event("publication", F.coalesce("grant_date", "publication_date"), F.concat(F.lit("Publication of "), "pub")),
        F.lit("<ul>"), _rows(F.filter("cpc", lambda c: c["code_raw"].isNotNull()), "classifications", lambda c: _span("Code", c["code_raw"]), lambda c: F.lit('<meta itemprop="Leaf" content="true"><meta itemprop="IsCPC" content="true">')),
        _rows(F.filter("family_members", lambda m: m.isNotNull()), "docdbFamily", lambda m: _span("publicationNumber", m)),
        _rows(of_kind("patent"), "backwardReferences", lambda b: _span("publicationNumber", b["publication_number_raw"]), mark), _rows(of_kind("npl"), "detailedNonPatentLiterature", lambda b: _span("title", b["npl_text"]), mark),
        _rows(F.col("forward_citations.citing_publication_numbers"), "forwardReferences", lambda n: _span("publicationNumber", n)),
        F.lit("</ul>"), F.when(F.col("legal_status.status_raw").isNotNull(), F.concat(F.lit('<div itemprop="legalStatusIfi" itemscope>'), _span("status", F.col("legal_status.status_raw")), F.lit("</div>"))),
        F.lit('<div itemscope itemprop="similarDocuments"><span itemprop="title">another</span><meta itemprop="publicationNumber" content="ZZ1"></div></article></body></html>'),
    )
    return docs.select(F.col("pub").alias("id"), page.alias("page"), "retrieved_at")
