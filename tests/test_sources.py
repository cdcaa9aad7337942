"""Packages built in memory, files, and incremental runs."""

import io
import json
import sys
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.operators import audit, pii
from folioflow.plans.registry import QUERIES
from folioflow.sources import docx, files, writer
from folioflow.sources.convention import EXTRACTORS, chain_depth, convention_evidence
from folioflow.streaming import incremental

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'


def p(text, para_id=None, extra=""):
    mark = f' w14:paraId="{para_id}"' if para_id else ""
    return f"<w:p{mark}><w:r><w:t>{text}</w:t></w:r>{extra}</w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


CAPTION = "<w:r><w:instrText> SEQ Table </w:instrText></w:r>"


def equation(inner):
    return f"<w:p><m:oMath>{inner}</m:oMath></w:p>"


def package(body, types=True, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if types:
            z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}<w:sectPr/></w:body></w:document>")
        for name, content in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", content)
    return out.getvalue()


@pytest.fixture
def packages(spark):
    return lambda **content: spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "path string, content binary")


def test_graph_of_ids_tables_and_captions(packages):
    body = p("before", extra=CAPTION) + p("one", "A1") + p("two", "A1") + table(["a", "b"], ["c", "d"]) + p("caption", "C1", CAPTION) + '<w:p><w:bookmarkStart w:id="1" w:name="ref"/><w:bookmarkStart w:id="2" w:name="_GoBack"/></w:p>'
    got = docx.extract(packages(x=package(body))).cache()
    nodes, edges = docx.nodes(got), docx.edges(got)
    kinds = {r.kind: r["count"] for r in nodes.groupBy("kind").count().collect()}
    assert kinds == {"document_snapshot": 1, "section": 1, "caption": 2, "paragraph": 7, "table": 1, "table_row": 2, "table_cell": 4, "anchor": 1}
    assert [(r.src, r.dst) for r in edges.where("kind = 'caption_for'").collect()] == [("para-C1", "table-0")]
    doubts = {(r.id, r.status) for r in docx.uncertainty(got).collect()}
    assert ("para-A1", "ambiguous") in doubts and ("para-synthetic-0", "dangling") in doubts
    assert got.select("grids").first()[0] == [[2, 2]]


def test_tabs_and_breaks(packages):
    body = "<w:p><w:r><w:t>(a)</w:t><w:tab/><w:t>x</w:t><w:br/><w:t>y</w:t></w:r></w:p>"
    assert docx.extract(packages(x=package(body))).first().text == "(a)\tx\ny"


FRACTION = "<m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f>"
RADICAL = '<m:rad><m:radPr><m:degHide m:val="1"/></m:radPr><m:deg/><m:e><m:r><m:t>x</m:t></m:r></m:e></m:rad>'


@pytest.mark.parametrize(
    "inner, compat, intended",
    [
        (FRACTION, "correct", "correct"),
        (RADICAL, "empty_required_child", "correct"),
        ("<m:f><m:num/><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f>", "empty_required_child", "empty_required_child"),
        ("<m:r><m:t>1 over 2</m:t></m:r>", "correct", "fallback_forbidden"),
    ],
)
def test_equation_labels(packages, inner, compat, intended):
    for flag, label in ((True, compat), (False, intended)):
        nodes = docx.nodes(docx.extract(packages(x=package(equation(inner))), compat=flag))
        assert nodes.where("kind = 'equation'").select(F.col("attrs")["semantic_label"]).first()[0] == label


def test_bad_packages_are_rows(packages):
    bad = packages(zip=b"no zip", types=package(p("x"), types=False), xml=package("<w:p>"), good=package(p("x")))
    scan = {r.path: r for r in docx.scan(bad).collect()}
    assert scan["good"].ok and not scan["zip"].ok and not scan["types"].ok and not scan["xml"].ok
    assert scan["types"].errors == ["missing [Content_Types].xml"]
    assert {r.path for r in docx.extract(bad).where("error is not null").collect()} == {"zip"}


def test_features_and_content_hash(packages):
    body = equation(FRACTION) + equation(RADICAL)
    again = io.BytesIO(package(body))
    with zipfile.ZipFile(again, "a") as z:
        z.comment = b"other bytes"
    got = {r.path: r for r in docx.scan(packages(a=package(body), b=again.getvalue())).collect()}
    assert got["a"].families == {"fraction": 1, "radical": 1} and got["a"].omath == 2
    assert got["a"].sha256 != got["b"].sha256 and got["a"].content_sha256 == got["b"].content_sha256


def test_visible_text_keeps_paragraphs_apart_and_reads_footers(packages):
    content = package(p("555") + p("123-456-7890"), word__footer1=f"<w:ftr {NS}>{p('mail a@b.org')}</w:ftr>")
    r = pii.scan(docx.visible_text(packages(x=content)).select("path", "text")).first()
    assert (r.phone_count, r.real_email_count) == (1, 1)


def test_relationships(packages):
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = f'<w:p><w:hyperlink xmlns:r="{r}" r:id="rId9"/></w:p>'
    got = docx.relationships(packages(x=package(body)))
    used, known = (got.select(F.explode(c).alias("id")) for c in ("used", "defined"))
    assert [tuple(x) for x in audit.dangling(used, known, "id").collect()] == [("dangling", "rId9")]


def test_convention_evidence(packages):
    styles = f'<w:styles {NS}><w:style w:type="paragraph" w:styleId="A"/><w:style w:type="paragraph" w:styleId="B"><w:basedOn w:val="A"/></w:style></w:styles>'
    sections = '<w:p><w:pPr><w:sectPr><w:pgSz w:w="12240" w:h="15840"/></w:sectPr></w:pPr></w:p><w:p><w:pPr><w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:pPr></w:p>'
    got = {(r.category, r.node): r for r in convention_evidence(packages(x=package(sections, word__styles=styles))).collect()}
    assert json.loads(got["styles", "style_count_by_type"].value_json) == {"paragraph": 2}
    assert got["styles", "max_inheritance_depth"].value_json == "1"
    assert (got["sections", "page_size"].status, got["sections", "page_size"].confidence, len(got["sections", "page_size"].conflicts)) == ("mixed", 0.5, 1)
    assert got["metadata_accessibility", "core.xml"].status == "unknown"
    assert len(EXTRACTORS) == 12
    assert chain_depth({"a": "b", "b": "a"}) == 2 and chain_depth({f"s{i}": f"s{i + 1}" for i in range(90)}) == 51


def test_read_packages(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/x.docx").write_bytes(package(p("hello")))
    got = docx.paragraph_texts(docx.read_packages(spark, str(tmp_path), str(tmp_path / "deep")))
    assert [r.paragraphs for r in got.collect()] == [["hello"]]


def test_files(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"id":"x","seq":1,"v":1}\n{"id":"x","seq":2,"v":2}\n')
    assert [tuple(r) for r in files.checkpoint_log(spark, str(log), "id string, seq int, v int", "id", "seq").collect()] == [("x", 2, 2)]
    reports = spark.createDataFrame([("r1", True), ("r3", False), ("r2", True)], "path string, ok boolean")
    assert files.newest(reports).first().path == "r3" and files.newest(reports, F.col("ok")).first().path == "r2"
    tex = spark.createDataFrame([(r"see \cite{a, b} and \citep{c}",)], "text string")
    bib = spark.createDataFrame([("@article{a, title={x}}\n@book{d,}",)], "text string")
    got = audit.dangling(files.citation_keys(tex), files.bibliography_keys(bib), "key").collect()
    assert sorted(map(tuple, got)) == [("dangling", "b"), ("dangling", "c"), ("unused", "d")]
    path = files.write_report(reports, str(tmp_path), "report-v1", "run1")
    assert spark.read.json(path).select("schema").distinct().first()[0] == "report-v1"
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_report(reports, str(tmp_path), "report-v1", "run1")


def test_replace_field(spark):
    old = spark.createDataFrame([(1, {"g": 1, "k": 7}), (2, {"g": 2, "k": 8}), (3, {"g": 3, "k": 9})], "id int, rec struct<g:int,k:int>")
    got = files.replace_field(old, spark.createDataFrame([(1, 5), (2, 2)], "id int, value int"), "id", "rec", "g").orderBy("id").collect()
    assert [(r.rec.g, r.rec.k, r.state) for r in got] == [(5, 7, "changed"), (2, 8, "unchanged"), (3, 9, "error")]


def test_stream_resumes_without_doing_work_twice(spark, tmp_path):
    source, out, mark = (str(tmp_path / d) for d in ("in", "out", "mark"))
    schema = "id long, v string"
    run = lambda: incremental.process_new_files(spark, source, schema, out, mark, "id", lambda df: df.withColumn("done", F.lit(True))).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(source)
    run()
    spark.createDataFrame([(2, "again"), (3, "c")], schema).write.mode("append").parquet(source)
    run()
    run()
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_windowed_counts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert incremental.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_manifests_tiers_and_logs(spark, tmp_path):
    for name, items in (("a", [{"id": 1, "kind": "x"}, {"id": 2, "kind": None}]), ("b", [{"id": 3, "kind": "y"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"name": name, "items": items}, indent=1))
    schema = schema_of("name string, items array<struct<id:long,kind:string>>")
    rows = files.manifests(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], schema, "items")
    assert sorted((r.id, r.kind) for r in rows.collect()) == [(1, "x"), (2, None), (3, "y")]
    files.write_tiers(rows.withColumn("tier", F.col("id") % 2), f"{tmp_path}/tiers")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/tiers").where("tier = 1").collect()) == [1, 3]
    for seq, state in ((1, "open"), (2, "done")):
        files.append_log(spark.createDataFrame([(7, seq, state)], "id long, seq long, state string"), f"{tmp_path}/log")
    last = files.checkpoint_log(spark, f"{tmp_path}/log", "id long, seq long, state string", "id", "seq").collect()
    assert [(r.id, r.seq, r.state) for r in last] == [(7, 2, "done")]


def schema_of(ddl):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def test_results_leave_by_unpacked_bytes_and_only_what_is_asked(spark, packages, monkeypatch):
    """A batch of many small packages that unpack to much is not held as one; unwanted nodes and columns do not move."""
    long = "".join(p("x" * 5000, extra=CAPTION) for _ in range(20)) + table(["a", "b"])
    got = packages(**{f"k{i}": package(long) for i in range(60)}).coalesce(1)
    held = []
    monkeypatch.setattr(type(got), "mapInArrow", lambda self, f, schema: held.append(f) or self)
    docx.extract(got, columns=["nodes"], kinds=["table"], attrs=["row_count"])
    rows = pa.RecordBatch.from_pylist([{"path": f"k{i}", "content": package(long)} for i in range(60)])
    out = list(held[0](iter([rows])))
    assert len(out) > 2 and sum(b.num_rows for b in out) == 60 and out[0].schema.names == ["path", "nodes", "error"]
    assert out[0].column("nodes")[0].as_py() == [{"seq": 22, "node_id": "table-0", "kind": "table", "anchor": None, "attrs": [("row_count", "1")]}]


ARROW = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.fixture
def usual_batches(spark):
    """Spark's own limits of Arrow batches, whatever ran before in the session."""
    for name in ARROW:
        spark.conf.unset(name)


def test_workers_are_sent_a_few_packages_at_a_time(spark, usual_batches):
    """The worker that reads packages and the one that writes them hold a small part of a large task's bytes."""
    held = spark.range(40, numPartitions=1).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("x"), 1 << 20).cast("binary").alias("content"))
    sent = lambda: sys._getframe(2).f_locals["batch"].nbytes  # noqa: E731  of the batch whose row is asked for
    most = docx._per_package(held, ("size",), lambda content: {"size": sent()}).agg(F.max("size")).first()[0]
    assert 1 << 20 <= most < 10 << 20
    for name in ARROW:
        spark.conf.unset(name)
    built = writer.write_packages(held, lambda row: str(sent()).encode())
    assert 1 << 20 <= built.agg(F.max(F.col("content").cast("string").cast("long"))).first()[0] < 10 << 20


@pytest.mark.parametrize("name", ["package_equation_reclassification", "package_marker_resolution", "package_table_grids", "package_relationships", "package_provenance", "package_content_evidence"])
def test_package_queries_read_bounded_batches(spark, sf_dir, usual_batches, name):
    QUERIES[name](spark, sf_dir)
    assert [spark.conf.get(c) for c in ARROW] == ["2000", "8m"]
