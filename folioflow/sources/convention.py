"""Convention evidence of Word packages: counts and histograms over twelve categories, as `evidence` rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .docx import DC, M, WP, Package, W, _canonical, _per_package, field_codes

DOC = "word/document.xml"
Fact = tuple[str, object]


def _value(element, path: str, attribute: str = "val"):
    found = element.find(path) if element is not None else None
    return found.get(W + attribute) if found is not None else None


def chain_depth(parents: dict[str, str | None], most: int = 50) -> int:
    """Longest chain of parents; a cycle ends at its first repeat, and no chain counts beyond most + 1."""
    deepest = 0
    for start in parents:
        at, seen, n = start, set(), 0
        while parents.get(at) and at not in seen and n <= most:
            seen.add(at)
            at, n = parents[at], n + 1
        deepest = max(deepest, n)
    return deepest


def styles(p: Package) -> Iterator[Fact]:
    root = p.xml("word/styles.xml")
    if root is None:
        yield "styles.xml", None
        return
    found = root.findall(W + "style")
    yield "style_count_by_type", dict(Counter(s.get(W + "type", "unknown") for s in found))
    yield "max_inheritance_depth", chain_depth({s.get(W + "styleId"): _value(s, W + "basedOn") for s in found})
    base = root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr")
    yield "default_font", _value(base, W + "rFonts", "ascii")
    yield "default_size", _value(base, W + "sz")
    latent = root.find(W + "latentStyles")
    yield "latent_count", None if latent is None else int(latent.get(W + "count") or 0)
    if latent is not None:
        yield "latent_locked", latent.get(W + "defLockedState")


def numbering(p: Package) -> Iterator[Fact]:
    root = p.xml("word/numbering.xml")
    yield "uses_numbering", root is not None
    if root is not None:
        yield "formats_by_level", dict(Counter(x.get(W + "val", "unknown") for x in root.findall(f"{W}abstractNum/{W}lvl/{W}numFmt")))
        yield "instances", len(root.findall(W + "num"))
        yield "abstract_instances", len(root.findall(W + "abstractNum"))


def sections(p: Package) -> Iterator[Fact]:
    found = list(p.xml(DOC).iter(W + "sectPr"))
    yield "section_count", len(found)
    sizes = [x for s in found if (x := s.find(W + "pgSz")) is not None]
    margins = [x for s in found if (x := s.find(W + "pgMar")) is not None]
    yield "page_size", [[x.get(W + "w"), x.get(W + "h")] for x in sizes]
    yield "orientation", [x.get(W + "orient", "portrait") for x in sizes]
    yield "margins", [[x.get(W + a) for a in ("top", "bottom", "left", "right", "header", "footer", "gutter")] for x in margins]


def headers_footers(p: Package) -> Iterator[Fact]:
    tops, ends = p.matching("word/header"), p.matching("word/footer")
    yield "header_parts", len(tops)
    yield "footer_parts", len(ends)
    codes = (c.split()[0].upper() for n in tops + ends if (root := p.xml(n)) is not None for c in field_codes(root) if c)
    yield "field_codes", dict(Counter(codes)) or None


def captions(p: Package) -> Iterator[Fact]:
    words = (c.split() for c in field_codes(p.xml(DOC), simple=False) if c.upper().startswith("SEQ "))
    yield "sequence_labels", dict(Counter(w[1] for w in words if len(w) > 1)) or None


def tables(p: Package) -> Iterator[Fact]:
    found = list(p.xml(DOC).iter(W + "tbl"))
    yield "table_count", len(found)
    if found:
        yield "with_grid", sum(t.find(W + "tblGrid") is not None for t in found)
        yield "styles", dict(Counter(s for t in found if (s := _value(t, f"{W}tblPr/{W}tblStyle")))) or None


def equations(p: Package) -> Iterator[Fact]:
    yield "equation_count", sum(1 for _ in p.xml(DOC).iter(M + "oMath"))


def revisions(p: Package) -> Iterator[Fact]:
    settings = p.xml("word/settings.xml")
    yield "track_changes", settings is not None and settings.find(W + "trackChanges") is not None
    for name in ("ins", "del"):
        yield f"{name}_count", sum(1 for _ in p.xml(DOC).iter(W + name))


def anchors(p: Package) -> Iterator[Fact]:
    names = [b.get(W + "name") for b in p.xml(DOC).iter(W + "bookmarkStart")]
    yield "bookmarks", len(names)
    yield "user_named", sum(bool(n) and not n.startswith("_") for n in names)
    yield "internal_links", sum(h.get(W + "anchor") is not None for h in p.xml(DOC).iter(W + "hyperlink"))


def fonts_language(p: Package) -> Iterator[Fact]:
    yield "languages", dict(Counter(v for x in p.xml(DOC).iter(W + "lang") if (v := x.get(W + "val")))) or None
    if (fonts := p.xml("word/fontTable.xml")) is not None:
        yield "fonts", len(fonts.findall(W + "font"))


def citations(p: Package) -> Iterator[Fact]:
    yield "citation_fields", sum(c.upper().startswith(("CITATION", "BIBLIOGRAPHY", "ADDIN")) for c in field_codes(p.xml(DOC), simple=False))


def metadata_accessibility(p: Package) -> Iterator[Fact]:
    core = p.xml("docProps/core.xml")
    if core is None:
        yield "core.xml", None
    else:
        text = {n: (x.text or "").strip() if (x := core.find(DC + n)) is not None else None for n in ("title", "creator", "language")}
        yield "title_present", bool(text["title"])
        yield "creator_present", bool(text["creator"])
        yield "language", text["language"]
    drawings = list(p.xml(DOC).iter(WP + "docPr"))
    yield "drawings", len(drawings)
    if drawings:
        yield "with_alt_text", sum(bool(d.get("descr") or d.get("title")) for d in drawings)


EXTRACTORS: dict[str, Callable[[Package], Iterator[Fact]]] = {
    f.__name__: f for f in (styles, numbering, sections, headers_footers, captions, tables, equations, revisions, anchors, fonts_language, citations, metadata_accessibility)
}
WITHOUT_BODY = {"styles", "numbering", "headers_footers"}


def convention_evidence(packages: DataFrame) -> DataFrame:
    """(doc_id, category, node, part, value_json, confidence, authority, status, conflicts).

    Lists of geometry resolve if all sections agree; else the first value in order stands with its confidence shared
    among the values, and the others are its conflicts.
    """

    def one(content: bytes) -> dict:
        package, rows = Package(content), []
        for category, extractor in EXTRACTORS.items():
            if category not in WITHOUT_BODY and package.xml(DOC) is None:
                continue
            for node, value in extractor(package):
                conflicts, status, confidence = [], "resolved", 1.0
                if isinstance(value, list):
                    kinds = sorted({_canonical(v) for v in value})
                    status = "unknown" if not kinds else "resolved" if len(kinds) == 1 else "mixed"
                    confidence, conflicts, text = 1.0 / max(1, len(kinds)), kinds[1:], kinds[0] if kinds else None
                else:
                    text, status = _canonical(value), "unknown" if value is None else "resolved"
                rows.append({"category": category, "node": node, "part": DOC if category not in WITHOUT_BODY else f"word/{category}", "value_json": text, "confidence": confidence, "authority": "observed", "status": status, "conflicts": conflicts})
        return {"evidence": rows}

    found = _per_package(packages, ("evidence",), one)
    return found.select(F.col("path").alias("doc_id"), F.inline("evidence"))
