"""Package queries: a Word package is built from each document by rules of its id and paragraphs, then read back.

Paragraph i of a document becomes a body paragraph; every second one has a native id (seven of them, so they repeat),
every fifth is a caption, every fourth holds an equation, and a table of two rows of three cells follows every sixth.
A last paragraph without text carries sections, revisions, bookmarks, links, languages, citations and drawings.  One
document in twenty gives bytes that are no package, one in twenty a package without content types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import Tables
from ..operators import alignment, audit, scoring, structure
from ..sources import convention, docx
from ..sources import writer as w
from .base import LINES, prf1_sql, query, table

_EMPTY = "<m:f><m:num/><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f>"
_WHOLE = "<m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f>"
_FLAT = "<m:r><w:t>a over b</w:t></m:r>"  # a run of the document's own text, so its paragraph shows it
_CAPTION = "<w:r><w:instrText> SEQ Table \\* ARABIC </w:instrText></w:r>"
_LETTER = '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/></w:sectPr>'
_A4 = '<w:pPr><w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:pPr>'


#: forms of mathematics that stand outside of equations, as often as the id's remainder says
_FORMS = [("rad", 2), ("sSub", 3), ("sSup", 4), ("nary", 5), ("m", 2), ("eqArr", 3), ("acc", 2), ("limLow", 5), ("sSubSup", 3), ("sPost", 2)]


def _body(n: int, paragraphs: list[str]) -> str:
    out = []
    for i, text in enumerate(paragraphs):
        inner = _CAPTION if i % 5 == 4 else ""
        if i % 4 == 3:
            inner += f"<m:oMath>{_FLAT if i % 12 == 3 else _EMPTY if i % 12 == 7 else _WHOLE}</m:oMath>"
        out.append(w.paragraph(text, f"P{i % 14 // 2}" if i % 2 == 0 else None, inner))
        if i % 6 == 5:
            out.append(w.table([[text[:10], str(i), str(n)], ["x", "y", "z"]], "Grid" if i % 12 == 5 else None, i % 12 == 5))
    tail = _A4 if n % 3 == 0 else ""
    tail += "<w:ins/>" * (n % 4) + '<w:bookmarkStart w:id="1" w:name="_Toc1"/><w:bookmarkStart w:id="9" w:name="_GoBack"/>'
    tail += "".join(f'<w:bookmarkStart w:id="{k + 2}" w:name="ref{k}"/>' for k in range(n % 3))
    tail += '<w:hyperlink w:anchor="ref0"/>' * (n % 2) + '<w:r><w:rPr><w:lang w:val="en-US"/></w:rPr></w:r>' * (1 + n % 2)
    tail += "<w:r><w:instrText>CITATION a1</w:instrText></w:r>" * (n % 3)
    tail += "".join(f'<wp:docPr id="{k}"' + (' descr="a plot"' if k % 2 == 0 else "") + "/>" for k in range(n % 3))
    tail += "".join(f"<m:{name}/>" * (n % k) for name, k in _FORMS)
    return "".join(out) + f"<w:p>{tail}</w:p>" + _LETTER


def _parts(n: int) -> dict[str, str]:
    chain = "".join(f'<w:style w:type="paragraph" w:styleId="S{k}">' + (f'<w:basedOn w:val="S{k - 1}"/>' if k else "") + "</w:style>" for k in range(3 + n % 4))
    loop = '<w:style w:type="character" w:styleId="A"><w:basedOn w:val="B"/></w:style><w:style w:type="character" w:styleId="B"><w:basedOn w:val="A"/></w:style>'
    font = "Calibri" if n % 2 else "Arial"
    defaults = f'<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="{font}"/><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults>'
    parts = {
        "word/styles.xml": w.part("w:styles", defaults + f'<w:latentStyles w:count="{300 + n % 3}" w:defLockedState="0"/>' + chain + loop),
        "word/settings.xml": w.part("w:settings", "<w:trackChanges/>" if n % 5 == 0 else ""),
        "word/header1.xml": w.part("w:hdr", '<w:p><w:fldSimple w:instr=" page "/><w:r><w:t>head</w:t></w:r></w:p>'),
        "word/fontTable.xml": w.part("w:fonts", "<w:font/><w:font/>"),
        "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1"/></Relationships>',
    }
    if n % 2:
        parts["word/footer1.xml"] = w.part("w:ftr", "<w:p><w:r><w:instrText> NUMPAGES </w:instrText></w:r><w:r><w:t>foot</w:t></w:r></w:p>")
    else:
        levels = "".join(f'<w:lvl><w:numFmt w:val="{k}"/></w:lvl>' for k in ["bullet"] + ["decimal"] * (1 + n % 3))
        parts["word/numbering.xml"] = w.part("w:numbering", f"<w:abstractNum>{levels}</w:abstractNum>" + "<w:num/>" * (1 + n % 3))
    if n % 7:
        parts["docProps/core.xml"] = w.part("coreProperties", ("<dc:title>t</dc:title>" if n % 2 else "<dc:title> </dc:title>") + "<dc:creator>c</dc:creator><dc:language>en</dc:language>")
    return parts


def _build(row: dict) -> bytes:
    n, paragraphs = int(row["path"]), [] if row["p"] is None else list(row["p"])
    if n % 20 == 9:
        return b"no package " + row["path"].encode()
    return w.package(_body(n, paragraphs), _parts(n), types=n % 20 != 19)


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), T.paragraphs(F.col("text")).alias("p"))
    return w.write_packages(docs, _build)


def _id():
    return F.col("path").cast("long").alias("doc_id")


_P = f"d AS (SELECT doc_id, coalesce({LINES}, []) AS ps, coalesce(len({LINES}), 0) AS n FROM documents), g AS (SELECT * FROM d WHERE doc_id % 20 <> 9), p AS (SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS i FROM g)"
#: name of a body paragraph: synthetic names count the six cells of each table before
_NAME = "CASE WHEN i % 2 = 0 THEN 'para-P' || (i % 14 // 2) ELSE 'para-synthetic-' || (i + 6 * (i // 6)) END"


@query(f"""WITH {_P}, k AS (SELECT doc_id, 'document_snapshot' AS kind, 1 AS n FROM g UNION ALL SELECT doc_id, 'section', 1 FROM g UNION ALL SELECT doc_id, 'caption', n // 5 FROM g
  UNION ALL SELECT doc_id, 'paragraph', n - n // 5 + 6 * (n // 6) + 1 FROM g UNION ALL SELECT doc_id, 'table', n // 6 FROM g UNION ALL SELECT doc_id, 'table_row', 2 * (n // 6) FROM g
  UNION ALL SELECT doc_id, 'table_cell', 6 * (n // 6) FROM g UNION ALL SELECT doc_id, 'equation', n // 4 FROM g UNION ALL SELECT doc_id, 'anchor', 1 + doc_id % 3 FROM g) SELECT doc_id, kind, n::BIGINT AS n FROM k WHERE n > 0""")
def package_node_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each kind in the extracted graph."""
    found = docx.nodes(docx.extract(_packages(spark, sf_dir), columns=["nodes"], attrs=[]))
    return found.groupBy(_id(), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_P} SELECT doc_id, 'section-0' AS src, {_NAME} AS dst, i + i // 6 AS ord, md5(text || CASE WHEN i % 12 = 3 THEN 'a over b' ELSE '' END) AS text_md5, CASE WHEN i % 5 = 4 THEN 'caption' ELSE 'paragraph' END AS kind, i % 4 = 3 AS has_equation FROM p""")
def package_body_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body paragraphs with their names, kinds and places among the body's children."""
    got = docx.extract(_packages(spark, sf_dir))
    held = docx.nodes(got).where(F.col("kind").isin("paragraph", "caption") & (F.col("attrs.text") != ""))
    held = held.select(_id(), F.col("node_id").alias("dst"), "kind", F.col("attrs.order").cast("long").alias("ord"), F.md5("attrs.text").alias("text_md5"), (F.col("attrs.has_equation") == "true").alias("has_equation"))
    inside = docx.edges(got).where((F.col("kind") == "contains") & (F.col("src") == "section-0")).select(_id(), "src", "dst", F.col("ord").cast("long").alias("ord")).distinct()
    return inside.join(held, ["doc_id", "dst", "ord"])


@query(f"""WITH {_P} SELECT doc_id, {_NAME} AS caption, CASE WHEN i >= 6 THEN 'table-' || (i // 6 - 1) END AS target, CASE WHEN i >= 6 THEN 'nearest_preceding_top_level_table' ELSE 'dangling' END AS resolution FROM p WHERE i % 5 = 4""")
def package_caption_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions with the table they stand for, and those without one before them."""
    got = docx.extract(_packages(spark, sf_dir), columns=["edges", "uncertainty"], kinds=["caption_for"])
    row = lambda caption, target, resolution: F.struct(caption.alias("caption"), target.alias("target"), resolution.alias("resolution"))
    found = F.transform("edges", lambda e: row(e["src"], e["dst"], e["resolution"]))
    lost = F.transform(F.filter("uncertainty", lambda d: d["status"] == "dangling"), lambda d: row(d["id"], F.lit(None).cast("string"), F.lit("dangling")))
    return got.select(_id(), F.inline(F.concat(found, lost)))  # both from one reading


@query(f"""WITH {_P}, x AS (SELECT doc_id, 'equation' AS family, i % 12 = 11 AS hit, CASE WHEN i % 2 = 0 THEN 'P' || (i % 14 // 2) END AS place FROM p WHERE i % 4 = 3
  UNION ALL SELECT doc_id, 'table', contains(substr(text, 1, 10) || i || doc_id || 'xyz', '1' || doc_id || 'x'), (i + i // 6 + 1)::VARCHAR FROM p WHERE i % 6 = 5)
 SELECT doc_id, family, CASE count(*) FILTER (hit) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN count(*) FILTER (hit) = 1 THEN max(place) FILTER (hit) END AS place FROM x GROUP BY ALL""")
def package_marker_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers among equations, by the text of their math runs and the paragraph's native id, and among tables, by the
    text of their cells and their place among the body's children."""
    kinds, attrs = ["equation", "table", "table_cell"], ["flat_text", "para_id", "text", "order"]
    nodes = docx.nodes(docx.extract(_packages(spark, sf_dir), columns=["nodes"], kinds=kinds, attrs=attrs))
    attr = lambda c: F.col(f"attrs.{c}")
    equations = nodes.where("kind = 'equation'").select(_id(), F.lit("equation").alias("family"), attr("flat_text").alias("text"), attr("para_id").alias("place"), F.lit("1").alias("marker"))
    held = nodes.where(F.col("kind").isin("table", "table_cell")).select(_id(), F.regexp_extract("node_id", "^table-[0-9]+", 0).alias("t"), "kind", "seq", attr("text").alias("text"), attr("order").alias("ord"))
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "table_cell", F.struct("seq", "text")))), lambda x: x["text"]), "")
    tables = held.groupBy("doc_id", "t").agg(cells.alias("text"), F.max(F.when(F.col("kind") == "table", F.col("ord"))).alias("place"))
    tables = tables.select("doc_id", F.lit("table").alias("family"), "text", "place", F.concat(F.lit("1"), F.col("doc_id").cast("string"), F.lit("x")).alias("marker"))
    return structure.resolve_marker_rows(equations.unionByName(tables), ["doc_id", "family"], "text", "place", F.col("marker"))


@query(f"""WITH {_P}, e AS (SELECT doc_id, CASE i % 12 WHEN 3 THEN 'fallback_forbidden' WHEN 7 THEN 'empty_required_child' ELSE 'correct' END AS label FROM p WHERE i % 4 = 3) SELECT doc_id, label, count(*) AS n FROM e GROUP BY ALL""")
def package_equation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    equations = docx.nodes(docx.extract(_packages(spark, sf_dir), columns=["nodes"], kinds=["equation"], attrs=["semantic_label"]))
    return equations.groupBy(_id(), F.col("attrs.semantic_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_P}, e AS (SELECT doc_id, i, CASE WHEN i % 8 = 3 THEN NULL WHEN i % 12 = 3 THEN 'fallback_forbidden' WHEN i % 12 = 7 THEN 'empty_required_child' ELSE 'correct' END AS label FROM p WHERE i % 4 = 3)
 SELECT coalesce(label, 'unparsable') AS label, count(*) AS equations, count(DISTINCT doc_id) AS documents FROM e GROUP BY label""")
def package_equation_reclassification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels told again from the equations' XML alone; every second one is cut short and cannot be parsed."""
    equations = docx.nodes(docx.extract(_packages(spark, sf_dir), columns=["nodes"], kinds=["equation"], attrs=["omml_raw"]))
    at = F.regexp_extract("node_id", "^(.*)-eq", 1)
    # every second equation by its place in the document
    place = F.row_number().over(_by_document()) % 2 == 1
    again = equations.select(_id(), at.alias("para"), F.when(place, F.substring("attrs.omml_raw", 1, 40)).otherwise(F.col("attrs.omml_raw")).alias("raw"))
    labelled = again.select("doc_id", docx.relabel("raw").alias("label"))
    return labelled.groupBy(F.coalesce("label", F.lit("unparsable")).alias("label")).agg(F.count(F.lit(1)).alias("equations"), F.count_distinct("doc_id").alias("documents"))


def _by_document():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("seq")


@query(f"""WITH {_P}, u AS (SELECT doc_id, 'synthetic' AS status, n // 2 + 6 * (n // 6) + 1 AS n FROM g UNION ALL SELECT doc_id, 'dangling', CASE WHEN n >= 5 THEN 1 ELSE 0 END FROM g
  UNION ALL SELECT doc_id, 'ambiguous', len(list_filter(range(n), lambda i: i % 12 IN (3, 7))) + len(list_filter(range(7), lambda k: (n + 13 - 2 * k) // 14 > 1)) FROM g) SELECT doc_id, status, n::BIGINT AS n FROM u WHERE n > 0""")
def package_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids without a native name, captions without a table, labels in doubt and ids in several places."""
    return docx.uncertainty(docx.extract(_packages(spark, sf_dir), columns=["uncertainty"])).groupBy(_id(), "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_P} SELECT doc_id, (n // 6)::BIGINT AS tables, CASE WHEN n >= 6 THEN array_to_string(list_transform(range(n // 6), lambda t: '3,3'), ';') ELSE '' END AS grid, md5(array_to_string(list_transform(range(n // 6), lambda t: substr(ps[6 * t + 6], 1, 10)), chr(10))) AS first_cells FROM g""")
def package_table_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each row of each table, and the text of each table's first cell."""
    got = docx.extract(_packages(spark, sf_dir), columns=["nodes", "grids"], kinds=["table_cell"], attrs=["text"]).where(F.col("error").isNull())
    grid = F.array_join(F.transform("grids", lambda t: F.array_join(t.cast("array<string>"), ",")), ";")
    cells = F.filter("nodes", lambda n: n["node_id"].rlike("^table-[0-9]+-row0-cell0$"))
    return got.select(_id(), F.size("grids").cast("long").alias("tables"), grid.alias("grid"), F.md5(F.array_join(F.transform(cells, lambda n: n["attrs"]["text"]), "\n")).alias("first_cells"))


@query(f"""WITH {_P}, t AS (SELECT doc_id, list_reduce([[]::VARCHAR[]] || list_transform(range(n), lambda i: CASE WHEN i % 6 = 5 THEN [ps[i + 1], substr(ps[i + 1], 1, 10), i::VARCHAR, doc_id::VARCHAR, 'x', 'y', 'z'] ELSE [ps[i + 1] || CASE WHEN i % 12 = 3 THEN 'a over b' ELSE '' END] END), lambda a, b: a || b) AS ls, n FROM g)
 SELECT d.doc_id, t.doc_id IS NOT NULL AS readable, len(list_filter(ls, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13)) <> ''))::BIGINT AS paragraphs, CASE WHEN t.doc_id IS NOT NULL THEN md5(array_to_string(ls || [''] || ['head'] || CASE WHEN d.doc_id % 2 = 1 THEN ['foot'] ELSE [] END, chr(10))) END AS text_md5 FROM d LEFT JOIN t USING (doc_id)""")
def package_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all parts, and paragraphs of the body; nulls where a package cannot be read."""
    readable = F.col("paragraphs").isNotNull()
    return docx.texts(_packages(spark, sf_dir)).select(_id(), readable.alias("readable"), F.when(readable, F.size("paragraphs")).cast("long").alias("paragraphs"), F.md5("text").alias("text_md5"))


@query(f"""WITH {_P}, f AS (SELECT d.doc_id, CASE WHEN doc_id % 20 = 9 THEN ['not a package'] WHEN doc_id % 20 = 19 THEN ['missing [Content_Types].xml'] ELSE [] END AS errors, CASE WHEN doc_id % 20 = 9 THEN 0 ELSE n // 4 END AS omath, CASE WHEN doc_id % 20 = 9 THEN 0 ELSE len(list_filter(range(n), lambda i: i % 12 IN (7, 11))) END AS fractions FROM d)
 SELECT doc_id, len(errors) = 0 AS ok, array_to_string(errors, ';') AS errors, omath::BIGINT AS omath, fractions::BIGINT AS fraction, k * (doc_id % 2) AS radical, k * (doc_id % 3) AS subscript, k * (doc_id % 4) AS superscript, k * (doc_id % 5) AS nary,
 k * (doc_id % 2 + doc_id % 3) AS matrix_or_array, k * (doc_id % 2 + doc_id % 5) AS accent_or_limit, k * (doc_id % 3 + doc_id % 2) AS multi_script FROM (SELECT *, CASE WHEN doc_id % 20 = 9 THEN 0 ELSE 1 END AS k FROM f)""")
def package_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity errors, equations and all feature families of every package, broken ones included."""
    found = docx.scan(_packages(spark, sf_dir))
    errors = F.array_join(F.transform("errors", lambda e: F.regexp_replace(e, "^not a package.*", "not a package")), ";")
    families = [F.coalesce(F.try_element_at("families", F.lit(name)), F.lit(0)).cast("long").alias(name) for name in docx.FAMILIES]
    return found.select(_id(), "ok", errors.alias("errors"), F.col("omath").cast("long").alias("omath"), *families)


@query(f"WITH {_P} SELECT doc_id, 'unused' AS kind, 'rId1' AS ref FROM g")
def package_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docx.relationships(_packages(spark, sf_dir)).where(F.col("error").isNull()).select(_id(), "used", "defined")
    both = F.concat(F.transform(F.array_except("used", "defined"), lambda r: F.struct(F.lit("dangling").alias("kind"), r.alias("ref"))), F.transform(F.array_except("defined", "used"), lambda r: F.struct(F.lit("unused").alias("kind"), r.alias("ref"))))
    return found.select("doc_id", F.inline(both))


_HIST = "'{{\"' || {} || '\":' || {} || '}}'"
#: what each category holds, as SQL over doc_id and n, the number of paragraphs
_EVIDENCE = {
    ("styles", "style_count_by_type"): "'{\"character\":2,\"paragraph\":' || (3 + doc_id % 4) || '}'",
    ("styles", "max_inheritance_depth"): "greatest(2, 2 + doc_id % 4)::VARCHAR",
    ("styles", "default_font"): "CASE WHEN doc_id % 2 = 1 THEN '\"Calibri\"' ELSE '\"Arial\"' END",
    ("styles", "default_size"): "'\"22\"'",
    ("styles", "latent_count"): "(300 + doc_id % 3)::VARCHAR",
    ("styles", "latent_locked"): "'\"0\"'",
    ("numbering", "uses_numbering"): "CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END",
    ("numbering", "formats_by_level"): "CASE WHEN doc_id % 2 = 0 THEN '{\"bullet\":1,\"decimal\":' || (1 + doc_id % 3) || '}' ELSE 'absent' END",
    ("numbering", "instances"): "CASE WHEN doc_id % 2 = 0 THEN (1 + doc_id % 3)::VARCHAR ELSE 'absent' END",
    ("numbering", "abstract_instances"): "CASE WHEN doc_id % 2 = 0 THEN '1' ELSE 'absent' END",
    ("sections", "section_count"): "CASE WHEN doc_id % 3 = 0 THEN '2' ELSE '1' END",
    ("sections", "page_size"): "CASE WHEN doc_id % 3 = 0 THEN '[\"11906\",\"16838\"]' ELSE '[\"12240\",\"15840\"]' END",
    ("sections", "orientation"): "'\"portrait\"'",
    ("sections", "margins"): "NULL",
    ("headers_footers", "header_parts"): "'1'",
    ("headers_footers", "footer_parts"): "(doc_id % 2)::VARCHAR",
    ("headers_footers", "field_codes"): "CASE WHEN doc_id % 2 = 1 THEN '{\"NUMPAGES\":1,\"PAGE\":1}' ELSE '{\"PAGE\":1}' END",
    ("captions", "sequence_labels"): "CASE WHEN n >= 5 THEN '{\"Table\":' || (n // 5) || '}' END",
    ("tables", "table_count"): "(n // 6)::VARCHAR",
    ("tables", "with_grid"): "CASE WHEN n >= 6 THEN ((n // 6 + 1) // 2)::VARCHAR ELSE 'absent' END",
    ("tables", "styles"): "CASE WHEN n >= 6 THEN '{\"Grid\":' || ((n // 6 + 1) // 2) || '}' ELSE 'absent' END",
    ("equations", "equation_count"): "(n // 4)::VARCHAR",
    ("revisions", "track_changes"): "CASE WHEN doc_id % 5 = 0 THEN 'true' ELSE 'false' END",
    ("revisions", "ins_count"): "(doc_id % 4)::VARCHAR",
    ("revisions", "del_count"): "'0'",
    ("anchors", "bookmarks"): "(2 + doc_id % 3)::VARCHAR",
    ("anchors", "user_named"): "(doc_id % 3)::VARCHAR",
    ("anchors", "internal_links"): "(doc_id % 2)::VARCHAR",
    ("fonts_language", "languages"): "'{\"en-US\":' || (1 + doc_id % 2) || '}'",
    ("fonts_language", "fonts"): "'2'",
    ("citations", "citation_fields"): "(doc_id % 3)::VARCHAR",
    ("metadata_accessibility", "core.xml"): "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'absent' END",
    ("metadata_accessibility", "title_present"): "CASE WHEN doc_id % 7 = 0 THEN 'absent' WHEN doc_id % 2 = 1 THEN 'true' ELSE 'false' END",
    ("metadata_accessibility", "creator_present"): "CASE WHEN doc_id % 7 = 0 THEN 'absent' ELSE 'true' END",
    ("metadata_accessibility", "language"): "CASE WHEN doc_id % 7 = 0 THEN 'absent' ELSE '\"en\"' END",
    ("metadata_accessibility", "drawings"): "(doc_id % 3)::VARCHAR",
    ("metadata_accessibility", "with_alt_text"): "CASE WHEN doc_id % 3 = 0 THEN 'absent' ELSE '1' END",
}


def _evidence_sql(categories: tuple[str, ...]) -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, '{k}' AS node, {v} AS value_json, {'doc_id % 3 = 0' if k == 'page_size' else 'false'} AS mixed FROM g" for (c, k), v in _EVIDENCE.items() if c in categories)
    return f"""WITH {_P}, e AS ({rows}) SELECT doc_id, category, node, value_json, CASE WHEN mixed THEN 'mixed' WHEN value_json IS NULL THEN 'unknown' ELSE 'resolved' END AS status, CASE WHEN mixed THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence, CASE WHEN mixed THEN '["12240","15840"]' ELSE '' END AS conflicts
 FROM e WHERE value_json IS DISTINCT FROM 'absent'"""


def _evidence(spark: SparkSession, sf_dir: str, *categories: str) -> DataFrame:
    found = convention.convention_evidence(_packages(spark, sf_dir)).where(F.col("category").isin(*categories))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "category", "node", "value_json", "status", "confidence", F.array_join("conflicts", ";").alias("conflicts"))


@query(_evidence_sql(("styles", "numbering")))
def package_style_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir, "styles", "numbering")


@query(_evidence_sql(("sections", "headers_footers", "captions", "tables")))
def package_layout_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir, "sections", "headers_footers", "captions", "tables")


@query(_evidence_sql(("equations", "revisions", "anchors", "fonts_language", "citations", "metadata_accessibility")))
def package_content_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir, "equations", "revisions", "anchors", "fonts_language", "citations", "metadata_accessibility")


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per package the texts of its captions, in order."""
    found = docx.nodes(docx.extract(_packages(spark, sf_dir), columns=["nodes"], kinds=["caption"], attrs=["text"])).where("kind = 'caption'")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("attrs.text").alias("text")))), lambda x: x["text"])
    return found.groupBy(_id()).agg(listed.alias("gold"))


_CAP = f"WITH {_P}, c AS (SELECT doc_id, n // 5 AS g, n // 5 - 1 AS c FROM g WHERE n >= 5)"


@query(f"""{_CAP} SELECT doc_id, 'caption_f1' AS metric, system, CASE WHEN system = 'captions' THEN round(f1, 6) END AS value, CASE WHEN system = 'captions' THEN CASE WHEN f1 IS NULL THEN 'undefined' ELSE 'scored' END ELSE 'not_applicable: unsupported' END AS status
 FROM (SELECT doc_id, {prf1_sql('c', 'g', 'c')} FROM c), (SELECT unnest(['captions', 'plain']) AS system)""")
def package_caption_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions against a candidate that lost each document's last one, and one that has no captions at all."""
    sides = _captions(spark, sf_dir).withColumn("cand", F.slice("gold", F.lit(1), F.size("gold") - 1))
    capable = {"captions": True, "plain": False}
    return scoring.caption_scores(sides, "doc_id", capable).withColumn("value", F.round("value", 6))


@query(f"""WITH {_P}, m AS (SELECT doc_id, n, n // 6 AS t, n // 4 AS e, CASE doc_id % 6 WHEN 0 THEN 'marker' WHEN 1 THEN CASE WHEN n > 0 THEN 'drift' ELSE 'clean' END WHEN 2 THEN CASE WHEN n >= 6 THEN 'tables' ELSE 'clean' END WHEN 3 THEN CASE WHEN n >= 6 THEN 'rows' ELSE 'clean' END WHEN 4 THEN CASE WHEN n >= 4 THEN 'labels' ELSE 'clean' END ELSE 'clean' END AS mode FROM g)
 SELECT doc_id, mode <> 'marker' AS marker_found, n = 0 AS empty, mode <> 'tables' AS table_count_stable, CASE WHEN mode <> 'tables' THEN mode <> 'rows' END AS row_counts_stable, mode <> 'labels' AS labels_stable,
 CASE WHEN mode = 'marker' THEN 'marker_paragraph_missing_after_round_trip' WHEN mode = 'drift' OR n = 0 THEN 'unintended_paragraph_drift_detected' WHEN mode = 'tables' THEN 'table_count_drift_detected' WHEN mode = 'rows' THEN 'table_row_count_drift_detected' WHEN mode = 'labels' THEN 'equation_semantic_drift_detected' ELSE 'clean_round_trip' END AS status FROM m""")
def package_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages against themselves after a round trip that appends a marker, and by the id loses the marker, a
    paragraph, a table, a row, or an equation's label."""
    kinds, attrs = ["paragraph", "caption", "table", "equation"], ["text", "row_count", "semantic_label"]
    got = docx.extract(_packages(spark, sf_dir), columns=["nodes"], kinds=kinds, attrs=attrs).where(F.col("error").isNull())
    of = lambda kinds, field: F.transform(F.filter("nodes", lambda n: n["kind"].isin(*kinds)), lambda n: n["attrs"][field])
    texts = F.filter(F.transform(F.filter("nodes", lambda n: n["kind"].isin("paragraph", "caption") & ~n["attrs"]["text"].isNull()), lambda n: n["attrs"]["text"]), lambda t: t != "")
    base = got.select(_id(), texts.alias("gold"), of(["table"], "row_count").cast("array<int>").alias("rows"), of(["equation"], "semantic_label").alias("labels"))
    base = Tables(spark).save(base, "base")  # read twice, extracted once
    mode, marker = F.col("doc_id") % 6, F.lit("round trip  Marker")
    rest = F.slice("gold", F.lit(2), F.greatest(F.size("gold") - 1, F.lit(0)))
    trip = base.select(
        "*",
        F.lit("Round trip marker").alias("marker"),
        F.when(mode == 0, F.col("gold")).when(mode == 1, F.concat(rest, F.array(marker))).otherwise(F.concat("gold", F.array(marker))).alias("cand"),
        F.when((mode == 2) & (F.size("rows") > 0), F.slice("rows", F.lit(2), F.size("rows"))).when(mode == 3, F.transform("rows", lambda r: r - 1)).otherwise(F.col("rows")).alias("rows_after"),
        F.when(mode == 4, F.transform("labels", lambda x: F.lit("other"))).otherwise(F.col("labels")).alias("labels_after"),
    )
    scored = alignment.round_trip(trip, "doc_id")
    return scored.join(base.select("doc_id", (F.size("gold") == 0).alias("empty")), "doc_id").select("doc_id", "marker_found", "empty", "table_count_stable", "row_counts_stable", "labels_stable", "status")


@query(f"""WITH {_P}, c AS (SELECT doc_id, n, greatest(n - 1, 0) AS m, n // 6 AS t, greatest(n // 6 - 1, 0) AS u, n // 4 AS e, greatest(n // 4 - doc_id % 2, 0) AS f FROM g WHERE n > 0)
 SELECT doc_id, CASE WHEN m > 0 THEN round(2 * m::DOUBLE / (n + m), 6) END AS paragraph_f1, CASE WHEN n - 1 >= 2 THEN 1.0::DOUBLE END AS order_accuracy,
 CASE WHEN u > 0 THEN round(2 * u::DOUBLE / (t + u), 6) END AS table_f1, CASE WHEN u > 0 THEN round((u - (u + 2 - (3 - doc_id % 3) % 3) // 3)::DOUBLE / u, 6) END AS row_match_rate,
 CASE WHEN f > 0 THEN round(2 * f::DOUBLE / (e + f), 6) END AS equation_f1, CASE WHEN f > 0 THEN round((f // 3)::DOUBLE / f, 6) END AS label_accuracy FROM c""")
def package_composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of a document side by side.  The candidate lacks the last paragraph of text, the last table, and by
    the id the last equation; every third table has a row more, and all its equations count as correct."""
    tables = Tables(spark)  # packages are extracted once, for all scores
    kinds, attrs = ["paragraph", "caption", "table", "equation", "contains"], ["order", "text", "row_count", "semantic_label"]
    got = docx.extract(_packages(spark, sf_dir), columns=["nodes", "edges"], kinds=kinds, attrs=attrs).where(F.col("error").isNull())
    got = tables.save(got.withColumn("edges", F.filter("edges", lambda e: e["src"] == "section-0")), "extracted")
    body = docx.edges(got).where("kind = 'contains' and src = 'section-0'").select("path", F.col("dst").alias("node_id"), F.col("ord").cast("string").alias("order")).distinct()
    held = docx.nodes(got).where(F.col("kind").isin("paragraph", "caption") & (F.col("attrs.text") != "")).select("path", "seq", "node_id", F.col("attrs.order").alias("order"), F.col("attrs.text").alias("text"))
    texts = held.join(body, ["path", "node_id", "order"]).groupBy(_id()).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("gold"))
    # numbered, so that no text repeats and the correspondence is the plain one
    sides = texts.select("doc_id", F.transform("gold", lambda x, i: F.concat(i.cast("string"), F.lit(" "), x)).alias("gold"))
    sides = tables.save(sides.withColumn("cand", F.slice("gold", F.lit(1), F.size("gold") - 1)), "sides")
    paras = alignment.align(sides, "doc_id").select("doc_id", F.round("f1", 6).alias("paragraph_f1"))
    order = alignment.fuzzy_order(sides, "doc_id").select("doc_id", F.round("accuracy", 6).alias("order_accuracy"))
    of = lambda kind, field: F.transform(F.filter("nodes", lambda n: n["kind"] == kind), lambda n: n["attrs"][field])
    parts = got.select(_id(), of("table", "row_count").cast("array<int>").alias("rows"), of("equation", "semantic_label").alias("labels"))
    short = lambda c, n: F.slice(c, F.lit(1), F.greatest(F.size(c) - n, F.lit(0)))
    parts = parts.withColumn("rows_c", F.transform(short("rows", F.lit(1)), lambda r, i: r + F.when((i + F.col("doc_id")) % 3 == 0, 1).otherwise(0)))
    parts = parts.withColumn("labels_c", F.transform(short("labels", (F.col("doc_id") % 2).cast("int")), lambda x: F.lit("correct")))
    parts = tables.save(parts, "parts")
    counts = lambda g, c: T.prf1(F.least(F.size(g), F.size(c)), F.size(g), F.size(c))["f1"]
    sized = parts.select("doc_id", F.round(counts("rows", "rows_c"), 6).alias("table_f1"), F.round(counts("labels", "labels_c"), 6).alias("equation_f1"))
    listed = lambda c: parts.select("doc_id", F.posexplode(c).alias("pos", "v"))
    matched = scoring.positional_match(listed("rows"), listed("rows_c"), ["doc_id", "pos"], "v").select("doc_id", F.col("rate").alias("row_match_rate"))
    labelled = scoring.label_accuracy(listed("labels"), listed("labels_c"), ["doc_id", "pos"], "v").select("doc_id", F.col("accuracy").alias("label_accuracy"))
    rest = sized.join(matched, "doc_id", "left").join(labelled, "doc_id", "left").select("doc_id", "table_f1", "row_match_rate", "equation_f1", "label_accuracy")
    return scoring.composite(paras, order, key="doc_id").join(rest, "doc_id")


@query(f"""WITH {_P}, c AS (SELECT d.doc_id, doc_id % 20 = 9 AS broken, doc_id % 20 = 19 AS partial FROM d) SELECT CASE WHEN broken THEN 'degraded' WHEN partial THEN 'degraded' ELSE 'clean' END AS provenance, count(*) AS packages FROM c GROUP BY 1""")
def package_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that read without an error and hold all that a package must are clean."""
    found = docx.scan(_packages(spark, sf_dir))
    state = audit.provenance(F.col("error").isNotNull() | ~F.col("ok"), F.col("sha256").isNotNull())
    return found.groupBy(state.alias("provenance")).agg(F.count(F.lit(1)).alias("packages"))

