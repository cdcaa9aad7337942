"""Word packages: parts, visible text, document graphs, feature counts, integrity, profile evidence.

Ordered mixed XML content has no form in Catalyst, so packages are read in `mapInArrow`, one package at a time from
its bytes, and leave as flat tables (`nodes`, `edges`, ...) for DataFrame operators.  A bad package gives a row with an
error, never an exception.  Members above `MOST_BYTES` and documents with entity declarations are refused.
"""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 256 << 20
#: bytes, unpacked, of packages whose results are held at a time
BATCH_BYTES = 2 << 20
# fixed values: namespaces of the format
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
DC = "{http://purl.org/dc/elements/1.1/}"
# fixed values: characters of empty elements, equation slots that must not be empty, words of flattened equations, feature families by tag
SIGNS = {W + "tab": "\t", W + "br": "\n", W + "cr": "\n"}
SLOTS = {"num", "den", "e", "sub", "sup", "deg"}
FLAT_WORDS = ("fraction", "over", "summation", "subscript", "superscript", "cases", "matrix")
FAMILIES = {
    "fraction": {"f"},
    "radical": {"rad"},
    "subscript": {"sSub"},
    "superscript": {"sSup"},
    "nary": {"nary"},
    "matrix_or_array": {"m", "eqArr"},
    "accent_or_limit": {"acc", "bar", "box", "borderBox", "groupChr", "d", "limLow", "limUpp"},
    "multi_script": {"sSubSup", "sPre", "sPost"},
}


def arrow_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bounds what a Python worker is sent at a time, whatever the number and the length of the packages of a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def read_packages(spark: SparkSession, *roots: str, pattern: str = "*.docx") -> DataFrame:
    """(path, length, content) of all files below the roots; a file that several roots reach comes once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(list(roots))
    return files.select("path", "length", "content").dropDuplicates(["path"])


def parse_xml(data: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in data[:65536] or b"<!DOCTYPE" in data[:65536]:
        raise ElementTree.ParseError("document type declarations are refused")
    return ElementTree.fromstring(data)


class Package:
    """Members of a package, parsed once and on demand."""

    #: bytes that this process has unpacked
    unpacked = 0

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = self.zip.namelist()
        self._roots: dict[str, ElementTree.Element | None] = {}

    def bytes(self, name: str) -> bytes:
        if self.zip.getinfo(name).file_size > MOST_BYTES:
            raise ValueError(f"{name} is too large")
        data = self.zip.read(name)
        Package.unpacked += len(data)
        return data

    def xml(self, name: str) -> ElementTree.Element | None:
        """Root of a part; None if it is missing or bad."""
        if name not in self._roots:
            try:
                self._roots[name] = parse_xml(self.bytes(name)) if name in self.names else None
            except (ElementTree.ParseError, ValueError, zipfile.BadZipFile):
                self._roots[name] = None
        return self._roots[name]

    def matching(self, prefix: str, suffix: str = ".xml") -> list[str]:
        return sorted(n for n in self.names if n.startswith(prefix) and n.endswith(suffix))


def visible(element: ElementTree.Element, math: bool = False) -> str:
    """Run text in document order; tabs and breaks as characters."""
    texts = {W + "t", M + "t"} if math else {W + "t"}
    return "".join((x.text or "") if x.tag in texts else SIGNS.get(x.tag, "") for x in element.iter())


def math_text(equation: ElementTree.Element) -> str:
    """Text of math runs alone; no paragraph shows it."""
    return "".join(x.text or "" for x in equation.iter(M + "t"))


def equation_label(equation: ElementTree.Element, compat: bool = True) -> str:
    """correct, empty_required_child or fallback_forbidden.

    With `compat` only word-processing runs count as text, as in published figures; without it math runs count too,
    and a degree that the radical hides may be empty.
    """
    inside = [x for x in equation.iter() if x is not equation]
    structured = any(x.tag.startswith(M) and x.tag not in (M + "r", M + "t") for x in inside)
    flat = visible(equation, math=not compat).strip().lower()
    if not structured and any(word in flat for word in FLAT_WORDS):
        return "fallback_forbidden"
    hidden = set()
    if not compat:
        for radical in equation.iter(M + "rad"):
            if (sign := radical.find(f"{M}radPr/{M}degHide")) is not None and sign.get(M + "val", "1") not in ("0", "off", "false"):
                hidden.update(radical.findall(M + "deg"))
    for slot in inside:
        if slot.tag.rpartition("}")[2] in SLOTS and slot not in hidden and not visible(slot, math=not compat).strip() and not any(c.tag.startswith(M) for c in slot):
            return "empty_required_child"
    return "correct"


def field_codes(element: ElementTree.Element, simple: bool = True) -> Iterator[str]:
    """Stripped instructions of complex and, if asked for, simple fields."""
    for x in element.iter():
        if x.tag == W + "instrText" and x.text:
            yield x.text.strip()
        elif simple and x.tag == W + "fldSimple":
            yield x.get(W + "instr", "").strip()


class Graph:
    """Nodes, edges and uncertainties of one document, in the order in which they are met; equations with their XML if
    `raw`."""

    def __init__(self, compat: bool = True, raw: bool = True):
        self.compat, self.raw, self.nodes, self.edges, self.doubts = compat, raw, [], [], []
        self.paragraphs, self.tables, self.ids = 0, 0, Counter()

    def node(self, node_id: str, kind: str, anchor: str | None = None, **attrs) -> dict:
        self.nodes.append({"node_id": node_id, "kind": kind, "anchor": anchor, "attrs": {k: str(v) for k, v in attrs.items() if v is not None}})
        return self.nodes[-1]

    def edge(self, src: str, kind: str, dst: str, order: int | None = None, resolution: str | None = None) -> None:
        self.edges.append({"src": src, "kind": kind, "dst": dst, "ord": order, "resolution": resolution})

    def doubt(self, node_id: str, status: str, reason: str) -> None:
        self.doubts.append({"id": node_id, "status": status, "reason": reason})

    def paragraph(self, p: ElementTree.Element, parent: str, order: int) -> tuple[str, str]:
        native = p.get(W14 + "paraId")
        name = f"para-{native}" if native is not None else f"para-synthetic-{self.paragraphs}"
        if native is None:
            self.doubt(name, "synthetic", "no native id")
        else:
            self.ids[native] += 1
        text, equations, codes, marks = [], [], [], []
        for x in p.iter():  # once for all that a paragraph holds
            if (tag := x.tag) == W + "t":
                text.append(x.text or "")
            elif tag in SIGNS:
                text.append(SIGNS[tag])
            elif tag == M + "oMath":
                equations.append(x)
            elif tag == W + "instrText" and x.text:
                codes.append(x.text)
            elif tag == W + "fldSimple":
                codes.append(x.get(W + "instr", ""))
            elif tag == W + "bookmarkStart":
                marks.append(x)
        kind = "caption" if any(c.strip().upper().startswith("SEQ") for c in codes) else "paragraph"
        self.node(name, kind, native, para_id=native, text_id=p.get(W14 + "textId"), text="".join(text), order=order, has_equation=str(bool(equations)).lower())
        self.edge(parent, "contains", name, order)
        for i, equation in enumerate(equations):
            label = equation_label(equation, self.compat)
            self.node(f"{name}-eq{i}", "equation", order=i, para_id=native, flat_text=math_text(equation), semantic_label=label, omml_raw=ElementTree.tostring(equation, encoding="unicode") if self.raw else None)
            self.edge(name, "contains", f"{name}-eq{i}", i)
            if label != "correct":
                self.doubt(f"{name}-eq{i}", "ambiguous", label)
        for mark in marks:
            if (title := mark.get(W + "name")) and not title.startswith("_GoBack"):
                anchor = f"anchor-{mark.get(W + 'id')}-{title}"
                self.node(anchor, "anchor", title, name=title, bookmark_id=mark.get(W + "id"))
                self.edge(name, "anchors", anchor)
        self.paragraphs += 1
        return name, kind

    def table(self, tbl: ElementTree.Element, parent: str, order: int) -> str:
        name, rows = f"table-{self.tables}", tbl.findall(W + "tr")
        self.tables += 1
        self.node(name, "table", order=order, row_count=len(rows))
        self.edge(parent, "contains", name, order)
        for r, row in enumerate(rows):
            cells = row.findall(W + "tc")
            self.node(f"{name}-row{r}", "table_row", order=r, cell_count=len(cells))
            self.edge(name, "contains", f"{name}-row{r}", r)
            for c, cell in enumerate(cells):
                place = f"{name}-row{r}-cell{c}"
                self.node(place, "table_cell", order=c, text=visible(cell))
                self.edge(f"{name}-row{r}", "contains", place, c)
                for k, p in enumerate(cell.findall(W + "p")):
                    self.paragraph(p, place, k)
        return name

    def body(self, body: ElementTree.Element) -> None:
        section, order, latest = "section-0", 0, None
        self.node(section, "section", order=0)
        self.edge("doc", "contains", section, 0)
        for child in body:
            if child.tag == W + "sectPr":
                continue
            if child.tag == W + "p":
                name, kind = self.paragraph(child, section, order)
                if kind == "caption" and latest:
                    self.edge(name, "caption_for", latest, resolution="nearest_preceding_top_level_table")
                elif kind == "caption":
                    self.doubt(name, "dangling", "no table before it")
            elif child.tag == W + "tbl":
                latest = self.table(child, section, order)
            else:
                self.doubt(f"{section}-child{order}", "unknown", child.tag)
            order += 1
        for native, n in self.ids.items():
            if n > 1:
                self.doubt(f"para-{native}", "ambiguous", f"id used {n} times")


_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
#: columns of the tables below: their types in Spark and in Arrow
_KINDS = {
    "nodes": ("array<struct<seq:int,node_id:string,kind:string,anchor:string,attrs:map<string,string>>>", pa.list_(pa.struct([("seq", pa.int32()), ("node_id", _TEXT), ("kind", _TEXT), ("anchor", _TEXT), ("attrs", pa.map_(_TEXT, _TEXT))]))),
    "edges": ("array<struct<src:string,kind:string,dst:string,ord:int,resolution:string>>", pa.list_(pa.struct([("src", _TEXT), ("kind", _TEXT), ("dst", _TEXT), ("ord", pa.int32()), ("resolution", _TEXT)]))),
    "uncertainty": ("array<struct<id:string,status:string,reason:string>>", pa.list_(pa.struct([("id", _TEXT), ("status", _TEXT), ("reason", _TEXT)]))),
    "grids": ("array<array<int>>", pa.list_(pa.list_(pa.int32()))),
    "families": ("map<string,int>", pa.map_(_TEXT, pa.int32())),
    "evidence": (
        "array<struct<category:string,node:string,part:string,value_json:string,confidence:double,authority:string,status:string,conflicts:array<string>>>",
        pa.list_(pa.struct([("category", _TEXT), ("node", _TEXT), ("part", _TEXT), ("value_json", _TEXT), ("confidence", pa.float64()), ("authority", _TEXT), ("status", _TEXT), ("conflicts", _TEXTS)])),
    ),
    **{c: ("array<string>", _TEXTS) for c in ("errors", "used", "defined", "paragraphs")},
    **{c: ("string", _TEXT) for c in ("path", "sha256", "content_sha256", "text", "error")},
    "size": ("long", pa.int64()),
    "omath": ("int", pa.int32()),
    "ok": ("boolean", pa.bool_()),
}


def _per_package(packages: DataFrame, columns: Collection[str], one: Callable[[bytes], dict]) -> DataFrame:
    """(path, *columns, error) of each package.  Results leave as they come: a task holds those of a few packages,
    however many rows a batch has."""
    names = ["path", *columns, "error"]
    schema = pa.schema([(c, _KINDS[c][1]) for c in names])

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _KINDS[c][1]) for c in names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, content in zip(batch.column("path"), batch.column("content")):
                path, content, before = path.as_py(), content.as_py(), Package.unpacked
                try:
                    rows.append({"path": path, **one(content), "error": None})
                except Exception as exc:  # a bad package is a row, not a failed job
                    rows.append({"path": path, "error": f"{type(exc).__name__}: {exc}"[:500]})
                held += len(content or b"") + Package.unpacked - before
                if held > BATCH_BYTES:
                    yield table(rows)
                    rows, held = [], 0
            yield table(rows)

    arrow_batches(packages.sparkSession)
    return packages.select("path", "content").mapInArrow(run, ", ".join(f"{c} {_KINDS[c][0]}" for c in names))


EXTRACTED = ("sha256", "nodes", "edges", "uncertainty", "text", "grids")


def extract(packages: DataFrame, compat: bool = True, columns: Collection[str] = EXTRACTED, kinds: Collection[str] | None = None, attrs: Collection[str] | None = None) -> DataFrame:
    """(path, sha256, nodes, edges, uncertainty, text, grids, error) of each package, or of these the `columns`; nodes
    and edges of the `kinds` alone and nodes with the `attrs` alone, if given, since all others would only be moved."""
    columns = [c for c in EXTRACTED if c in columns]
    listed = set(kinds) if kinds is not None else None
    wanted = set(attrs) if attrs is not None else None
    raw = "nodes" in columns and (wanted is None or "omml_raw" in wanted)

    def node(seq: int, n: dict) -> dict:
        return {"seq": seq, **n, "attrs": [(k, v) for k, v in n["attrs"].items() if wanted is None or k in wanted]}

    def one(content: bytes) -> dict:
        package, graph = Package(content), Graph(compat, raw)
        root = package.xml("word/document.xml")
        if root is None:
            if "word/document.xml" not in package.names:
                raise ValueError("no word/document.xml")
            found = {"nodes": [], "edges": [], "uncertainty": [{"id": "doc", "status": "unknown", "reason": "document part does not parse"}], "text": "", "grids": []}
            return {c: found[c] for c in columns if c in found} | ({"sha256": hashlib.sha256(content).hexdigest()} if "sha256" in columns else {})
        graph.node("doc", "document_snapshot", part_count=len(package.names))
        if (body := root.find(W + "body")) is not None:
            graph.body(body)
        out: dict = {"uncertainty": graph.doubts}
        if "sha256" in columns:
            out["sha256"] = hashlib.sha256(content).hexdigest()
        if "nodes" in columns:
            out["nodes"] = [node(i, n) for i, n in enumerate(graph.nodes) if listed is None or n["kind"] in listed]
        if "edges" in columns:
            out["edges"] = [e for e in graph.edges if listed is None or e["kind"] in listed]
        if "text" in columns:
            texts = [n["attrs"].get("text", "") for n in graph.nodes if n["kind"] in ("paragraph", "caption")]
            out["text"] = "\n".join(t for t in texts if t)
        if "grids" in columns:
            grids: dict[str, list[int]] = {n["node_id"]: [] for n in graph.nodes if n["kind"] == "table"}
            for n in graph.nodes:
                if n["kind"] == "table_row":
                    grids[n["node_id"].rpartition("-row")[0]].append(int(n["attrs"]["cell_count"]))
            out["grids"] = list(grids.values())
        return out

    return _per_package(packages, columns, one)


def relabel(raw: str) -> Column:
    """An equation's label told again from its XML; null for null or unparsable XML."""

    def one(xml: str | None) -> str | None:
        try:
            return equation_label(parse_xml(xml.encode())) if xml else None
        except ElementTree.ParseError:
            return None

    def many(xs: pd.Series) -> pd.Series:
        return xs.map(one)

    return F.pandas_udf(many, "string")(F.col(raw))


def nodes(extracted: DataFrame) -> DataFrame:
    return extracted.select("path", F.inline("nodes"))


def edges(extracted: DataFrame) -> DataFrame:
    return extracted.select("path", F.inline("edges"))


def uncertainty(extracted: DataFrame) -> DataFrame:
    return extracted.select("path", F.inline("uncertainty"))


def scan(packages: DataFrame) -> DataFrame:
    """Hashes, integrity errors (all of them), equation containers and feature families."""

    def one(content: bytes) -> dict:
        out: dict = {"sha256": hashlib.sha256(content).hexdigest(), "size": len(content), "errors": [], "families": [], "omath": 0, "content_sha256": None}
        try:
            package = Package(content)
        except zipfile.BadZipFile as exc:
            return out | {"errors": [f"not a package: {exc}"], "ok": False}
        if bad := package.zip.testzip():
            out["errors"].append(f"corrupt member: {bad}")
        out["errors"] += [f"missing {n}" for n in ("[Content_Types].xml", "word/document.xml") if n not in package.names]
        out["errors"] += [f"repeated member: {n}" for n, k in sorted(Counter(package.names).items()) if k > 1]
        found, digest = Counter(), hashlib.sha256()
        for name in sorted(set(package.matching("word/"))):
            digest.update(name.encode() + b"\0" + package.bytes(name))
            if (root := package.xml(name)) is None:
                out["errors"].append(f"unparsable part: {name}")
                continue
            tags = Counter(x.tag[len(M) :] for x in root.iter() if isinstance(x.tag, str) and x.tag.startswith(M))
            out["omath"] += tags["oMath"]
            for family, names in FAMILIES.items():
                found[family] += sum(tags[n] for n in names)
        return out | {"content_sha256": digest.hexdigest(), "families": [(k, v) for k, v in found.items() if v], "ok": not out["errors"]}

    return _per_package(packages, ("sha256", "size", "content_sha256", "ok", "errors", "omath", "families"), one)


def relationships(packages: DataFrame) -> DataFrame:
    """(path, used, defined): relationship ids of the document part; `audit.dangling` compares them."""

    def one(content: bytes) -> dict:
        package = Package(content)
        used = {v for x in (package.xml("word/document.xml") or ()).iter() for k, v in x.attrib.items() if k.endswith("/relationships}id") or k.endswith("/relationships}embed")} if package.xml("word/document.xml") is not None else set()
        rels = package.xml("word/_rels/document.xml.rels")
        return {"used": sorted(used), "defined": sorted(x.get("Id", "") for x in rels) if rels is not None else []}

    return _per_package(packages, ("used", "defined"), one)


def visible_text(packages: DataFrame) -> DataFrame:
    """Text of body, headers, footers and notes: runs joined within a paragraph, paragraphs by line feeds."""

    return _per_package(packages, ("text",), lambda content: {"text": _visible_text(Package(content))})


def _visible_text(package: Package) -> str:
    parts = [n for n in package.names if n in ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml") or n.startswith(("word/header", "word/footer"))]
    return "\n".join("".join(t.text or "" for t in p.iter(W + "t")) for n in parts if (root := package.xml(n)) is not None for p in root.iter(W + "p"))


def _paragraph_texts(root: ElementTree.Element) -> list[str]:
    texts = ("".join(t.text or "" for t in p.iter(W + "t")).strip() for p in root.iter(W + "p"))
    return [t for t in texts if t]


def paragraph_texts(packages: DataFrame) -> DataFrame:
    """Stripped non-empty paragraphs of the whole body, cells included; null for an unreadable package."""

    def one(content: bytes) -> dict:
        root = Package(content).xml("word/document.xml")
        if root is None:
            raise ValueError("unreadable document part")
        return {"paragraphs": _paragraph_texts(root)}

    return _per_package(packages, ("paragraphs",), one)


def texts(packages: DataFrame) -> DataFrame:
    """(path, paragraphs, text): `paragraph_texts` and `visible_text` from one reading."""

    def one(content: bytes) -> dict:
        package = Package(content)
        root = package.xml("word/document.xml")
        return {"paragraphs": None if root is None else _paragraph_texts(root), "text": _visible_text(package)}

    return _per_package(packages, ("paragraphs", "text"), one)


def _canonical(value) -> str | None:
    return None if value is None else json.dumps(value, sort_keys=True, separators=(",", ":"))
