"""Report templates: every name used is defined, every definition used, sections in order and drawing on sources they may."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

# What a metric must list when it uses a definition (one of each group), and the sources a section may use.
NEEDS = {
    "time_basis": [{"priority_date"}], "incomplete_period": [{"priority_date"}], "growth_rate": [{"priority_date"}], "international_family": [{"filing_office"}],
    "applicant_normalization": [{"applicants"}], "legal_status_basis": [{"legal_status"}], "self_citation": [{"applicants"}, {"forward_citations"}],
    "forward_citation_window": [{"forward_citations"}, {"publication_date"}], "country_attribution": [{"applicant_countries", "inventor_countries"}],
    "key_patent_formula": [{"forward_citations"}, {"filing_office"}, {"legal_status"}],
}
SOURCES = {"patent_data": {"patent_data"}, "classification": {"patent_data", "classification"}}


def sections(template: dict) -> Iterator[dict]:
    stack = list(reversed(template.get("sections", [])))
    while stack:
        s = stack.pop()
        yield s
        stack.extend(reversed(s.get("subsections", [])))


def uses(template: dict) -> Iterator[tuple[str, str, str]]:
    """(who, kind, name) of every name that one part of the template takes from another."""
    for m in template.get("metrics", []):
        yield from ((f"metric {m['id']}", "definition", d) for d in m.get("uses_definitions", []))
        yield from ((f"metric {m['id']}", "reference", r) for r in m.get("reference_practice", []))
    for c in template.get("chart_types", []):
        yield from ((f"chart type {c['id']}", "reference", r) for r in c.get("reference_practice", []))
    for s in sections(template):
        who = f"section {s['id']}"
        yield from ((who, "metric", f) for f in s.get("required_facts", []))
        yield from ((who, "reference", r) for r in s.get("reference_practice", []))
        for part in (*s.get("charts", []), *s.get("tables", [])):
            yield from ((f"{who}, {part['id']}", "metric", m) for m in part.get("metrics", []))
            if "chart_type" in part:
                yield f"{who}, {part['id']}", "chart type", part["chart_type"]
    for a in template.get("appendices", []):
        yield from ((f"appendix {a['id']}", "metric", f) for f in a.get("required_facts", []))


def problems(template: dict, required: tuple[str, ...] = ()) -> list[str]:
    """Everything that is wrong with a template; ``required`` are its top sections in their order."""
    every = list(sections(template))
    ids = {
        "metric": [m["id"] for m in template.get("metrics", [])], "definition": [d["id"] for d in template.get("definitions", [])], "reference": [r["id"] for r in template.get("references", [])],
        "chart type": [c["id"] for c in template.get("chart_types", [])], "section": [s["id"] for s in every] + [a["id"] for a in template.get("appendices", [])],
        "chart or table": [p["id"] for s in every for p in (*s.get("charts", []), *s.get("tables", []))],
    }
    out = [f"{kind} {name} is there {n} times" for kind, names in ids.items() for name, n in Counter(names).items() if n > 1]
    used = list(uses(template))
    out += [f"{who}: no {kind} {name}" for who, kind, name in used if name not in ids[kind]]
    taken = {(kind, name) for _, kind, name in used}
    out += [f"{kind} {name} is never used" for kind in ("metric", "definition", "reference", "chart type") for name in ids[kind] if (kind, name) not in taken]
    top = [s["id"] for s in template.get("sections", [])]
    out += [f"section {r} is missing" for r in required if r not in top]
    if [t for t in top if t in required] != [r for r in required if r in top]:
        out.append("sections are out of order")
    source = {m["id"]: m.get("source") for m in template.get("metrics", [])}
    for s in every:
        may = SOURCES.get(s.get("source_type"))
        facts = {*s.get("required_facts", []), *(m for p in (*s.get("charts", []), *s.get("tables", [])) for m in p.get("metrics", []))}
        out += [f"section {s['id']} of {s['source_type']} uses {f} of {source[f]}" for f in sorted(facts) if may is not None and f in source and source[f] not in may]
    return out + [p for m in template.get("metrics", []) for p in _metric(m)]


def _metric(m: dict) -> Iterator[str]:
    fields, used = set(m.get("requires_fields", [])), m.get("uses_definitions", [])
    if m.get("source") in SOURCES and not fields:
        yield f"metric {m['id']} lists no fields"
    for d in used:
        yield from (f"metric {m['id']} uses {d} without any of {sorted(group)}" for group in NEEDS.get(d, []) if not fields & group)
    if "priority_date" in fields and "time_basis" not in used:
        yield f"metric {m['id']} has a date and no time_basis"
    if m.get("excludes_incomplete_periods") and "incomplete_period" not in used:
        yield f"metric {m['id']} leaves out periods without incomplete_period"
    if "segment_labels" in used and m.get("source") != "classification":
        yield f"metric {m['id']} uses segment_labels and isn't of classification"


def definitions_document(template: dict) -> str:
    """The definitions and metrics as a Markdown document."""
    out = ["# Definitions", *(f"\n## {d.get('name', d['id'])}\n\n{' '.join(str(d.get('definition', '')).split())}" for d in template.get("definitions", []))]
    rows = [f"| {m['id']} | {m.get('unit') or ''} | {', '.join(m.get('uses_definitions', []))} |" for m in template.get("metrics", [])]
    return "\n".join([*out, "\n## Metrics\n\n| metric | unit | definitions |\n|-|-|-|", *rows]) + "\n"
