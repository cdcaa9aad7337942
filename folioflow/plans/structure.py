"""Structure queries: paragraphs as nodes, orders and lineitems as containment, events as ordered body items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tables import Tables
from ..operators import audit, packing, spans, structure
from .base import LINES, prf1_sql, query, table

_PARAS = f"SELECT doc_id, unnest({LINES}) AS text, generate_subscripts({LINES}, 1) - 1 AS ord FROM documents"


@query(f"SELECT doc_id, ord, 'para-synthetic-' || ord AS node_id, md5(text) AS text_md5 FROM ({_PARAS})")
def paragraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = structure.paragraph_nodes(table(spark, sf_dir, "documents"))
    return nodes.select("doc_id", "ord", "node_id", F.md5("text").alias("text_md5"))


@query(f"SELECT doc_id, count(*) AS n_paragraphs, md5(string_agg(text, chr(10) ORDER BY ord)) AS text_md5 FROM ({_PARAS}) GROUP BY doc_id")
def document_text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.text_facts(structure.paragraph_nodes(table(spark, sf_dir, "documents")), "doc_id")


@query(f"SELECT doc_id, md5(text) AS para_id, count(*) AS n, 'ambiguous' AS status FROM ({_PARAS}) GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_paragraph_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = structure.paragraph_nodes(table(spark, sf_dir, "documents")).withColumn("para_id", F.md5("text"))
    return structure.ambiguous_ids(nodes, "doc_id", "para_id")


@query("""SELECT event_id, user_id, resolved, CASE WHEN resolved IS NULL THEN 'dangling' ELSE 'resolved' END AS status FROM (SELECT event_id, user_id, event_type,
 last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS resolved FROM events) WHERE event_type = 'error'""")
def caption_nearest_preceding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    found = events.withColumn("resolved", structure.preceding(events, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", "event_id"))
    return found.where(F.col("event_type") == "error").select("event_id", "user_id", "resolved", F.when(F.col("resolved").isNull(), "dangling").otherwise("resolved").alias("status"))


@query("SELECT o_orderkey AS node_id, o_orderstatus AS status FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R') USING (o_orderkey)")
def top_level_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dst"), F.col("l_returnflag").alias("src"))
    cells = lines.where(F.col("src") == "R").select(F.col("src").alias("node_id")).distinct()
    return structure.top_level(nodes, lines, cells)


@query("SELECT o_orderkey AS node_id, count(l_orderkey) AS n_children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def rows_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"))
    return structure.children_count(parents, edges, "node_id")


@query(f"""WITH p AS (SELECT doc_id, ord, text FROM ({_PARAS}) WHERE length(trim(text)) >= 8 AND (ord % 7 <> 0 OR ord % 14 = 7)), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM p)
 SELECT doc_id, substr(text, 1, 80) AS anchor FROM documents LEFT JOIN (SELECT doc_id, text FROM n WHERE k = least(floor(n * 0.8::DOUBLE), n - 1)) t USING (doc_id)""".replace("SELECT doc_id, substr(text, 1, 80)", "SELECT documents.doc_id, substr(t.text, 1, 80)"))
def body_anchor_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every fourteen paragraphs one has a heading's style, one none, and the others a body style."""
    style = lambda i: F.when(i % 14 == 0, "Heading 2").when(i % 14 != 7, "Body Text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(T.paragraphs(F.col("text")), lambda x, i: F.struct(x.alias("text"), style(i).alias("style"))).alias("p"))
    return docs.select("doc_id", structure.body_anchor(F.col("p")).alias("anchor"))


@query(f"""SELECT doc_id, CASE len(m) WHEN 1 THEN 'found' WHEN 0 THEN 'not_found' ELSE 'ambiguous' END AS status, CASE WHEN len(m) = 1 THEN m[1] END AS position
 FROM (SELECT doc_id, list_filter(list_transform(range(len(p)), lambda i: CASE WHEN contains(p[i + 1], 'License') THEN i END), lambda i: i IS NOT NULL) AS m FROM (SELECT doc_id, {LINES} AS p FROM documents))""")
def marker_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.paragraphs(F.col("text")).alias("p"))
    return docs.select("doc_id", structure.resolve_marker(F.col("p"), F.lit("License")).alias("m")).select("doc_id", "m.*")


@query(f"""WITH h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i, text, length(text) % 3 AS level, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_PARAS}) WHERE length(text) < 60),
 c AS (SELECT doc_id, i, level, row_number() OVER (PARTITION BY doc_id ORDER BY abs(i - n // 2), i) AS k FROM h WHERE n >= 3)
 SELECT c.doc_id, c.i AS chosen, CASE WHEN c.i > 0 THEN c.i - 1 END AS preceding, (SELECT min(h.i) FROM h WHERE h.doc_id = c.doc_id AND h.i > c.i AND h.level <= c.level) AS following FROM c WHERE k = 1""")
def section_reorder_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short paragraphs stand in for headings; their level is their length modulo 3."""
    nodes = structure.paragraph_nodes(table(spark, sf_dir, "documents")).where(F.length("text") < 60)
    numbered = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("xs")).select("doc_id", F.posexplode("xs").alias("i", "x"))
    return structure.reorder_plan(numbered.select("doc_id", "i", F.col("x.text").alias("text"), (F.length("x.text") % 3).alias("level")), "doc_id")


_FAMILIES = {"heading": "<h[1-6]", "paragraph": "<p>", "list": "<ul>", "bold": "<b>", "break": "<br>", "script": "<script>", "style": "<style>", "comment": "<!--"}


@query("SELECT family, sum(n)::BIGINT AS total, count(*) FILTER (n > 0) AS pages FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS family, len(regexp_extract_all(html, '{p}')) AS n FROM pages" for k, p in _FAMILIES.items()) + ") GROUP BY family")
def page_feature_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.array(*[F.struct(F.lit(k).alias("family"), F.regexp_count("html", F.lit(p)).cast("long").alias("n")) for k, p in _FAMILIES.items()])
    rows = table(spark, sf_dir, "pages").select(F.inline_outer(counts))
    return rows.groupBy("family").agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 0).alias("pages"))


@query("""SELECT ref, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref FROM pages) GROUP BY ref""")
def page_link_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "pages").select("page_id", F.explode_outer(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ref")).where(F.col("ref").isNotNull())
    return refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


#: of every thousand keys: roots at 0 and 50, cycles of two at 60 and 80 and one of sixty at 140, an undefined parent at 99
_BASED = "CASE WHEN p_partkey % 1000 IN (0, 50) THEN NULL WHEN p_partkey % 1000 IN (60, 80) THEN p_partkey + 1 WHEN p_partkey % 1000 = 99 THEN -1 WHEN p_partkey % 1000 = 140 THEN p_partkey + 59 ELSE p_partkey - 1 END"


@query(f"""WITH RECURSIVE c AS (SELECT p_partkey AS node, {_BASED} AS parent FROM part),
 w(node, cur, seen) AS (SELECT node, node, []::BIGINT[] FROM c UNION ALL SELECT w.node, c.parent, w.seen || [w.cur::BIGINT] FROM w JOIN c ON c.node = w.cur WHERE c.parent IS NOT NULL AND NOT list_contains(w.seen, w.cur) AND len(w.seen) < 51)
 SELECT node, max(len(seen))::BIGINT AS depth FROM w GROUP BY node""")
def style_inheritance_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys as styles: each is based on the one before, but for roots, cycles, and bases that are not defined."""
    node = F.col("p_partkey")
    at = node % 1000
    parent = F.when(at.isin(0, 50), None).when(at.isin(60, 80), node + 1).when(at == 99, F.lit(-1)).when(at == 140, node + 59).otherwise(node - 1)
    return structure.chain_depth(table(spark, sf_dir, "part").select(node.alias("node"), parent.alias("parent")), "node", "parent")


@query("""SELECT event_id, CASE WHEN event_type IS NULL THEN 'not_run_missing' WHEN event_type = 'error' AND value > 50 THEN 'blocked' WHEN event_type = 'error' THEN 'failed' WHEN value < 1 THEN 'not_run_budget' ELSE 'completed' END AS status FROM events""")
def execution_status_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    status = audit.cascade((kind.isNull(), "not_run_missing"), ((kind == "error") & (value > 50), "blocked"), (kind == "error", "failed"), (value < 1, "not_run_budget"), default="completed")
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"))


@query("""SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all("text", '([A-Z][a-z]+)', 1)), lambda x: x NOT IN ('The', 'And', 'Of'))), ',') AS foreign_names,
 len(list_filter(list_distinct(regexp_extract_all("text", '([A-Z][a-z]+)', 1)), lambda x: x NOT IN ('The', 'And', 'Of'))) = 0 AS isolated FROM conversations""")
def isolation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", audit.foreign_names(F.col("text"), "([A-Z][a-z]+)", ["The", "And", "Of"]).alias("f"))
    return found.select("conv_id", "turn", F.array_join("f", ",").alias("foreign_names"), (F.size("f") == 0).alias("isolated"))


@query(f"""SELECT doc_id, contains(lower(text), 'license') OR contains(lower(text), 'copyright') OR contains(lower(text), 'rights reserved') AS said, toxic = 1 AS truth,
 CASE WHEN toxic IS NULL THEN 'unlabelled' WHEN (contains(lower(text), 'license') OR contains(lower(text), 'copyright') OR contains(lower(text), 'rights reserved')) = (toxic = 1) THEN 'agree' ELSE 'disagree' END AS verdict FROM documents LEFT JOIN labels USING (doc_id)""")
def keyword_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", T.any_keyword(F.col("text"), ["license", "copyright", "rights reserved"]).alias("said")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    truth = F.col("toxic") == 1
    return joined.select("doc_id", "said", truth.alias("truth"), F.when(F.col("toxic").isNull(), "unlabelled").when(F.col("said") == truth, "agree").otherwise("disagree").alias("verdict"))


@query("""SELECT CASE p_brand WHEN 'Brand#1' THEN 'smoke' WHEN 'Brand#2' THEN 'scale_up' ELSE 'final' END AS stage, CASE WHEN n = 1 THEN 'kept' ELSE 'excluded' END AS inclusion, count(*) AS parts
 FROM (SELECT p_partkey, p_brand, count(l_partkey) AS n FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1, 2""")
def stage_remap_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage names from a dictionary; only items with exactly one input are kept, all others are listed apart."""
    names = F.create_map(F.lit("Brand#1"), F.lit("smoke"), F.lit("Brand#2"), F.lit("scale_up"))
    inputs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(inputs, "p_partkey", "left")
    return joined.groupBy(F.coalesce(F.try_element_at(names, "p_brand"), F.lit("final")).alias("stage"), F.when(F.col("n") == 1, "kept").otherwise("excluded").alias("inclusion")).agg(F.count(F.lit(1)).alias("parts"))


@query("""SELECT doc_id, name, starts_with(name, 'fixture-') OR starts_with(name, 'composite-') AS hand_authored FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'fixture-' WHEN 1 THEN 'composite-' ELSE 'my-fixture-' END || doc_id AS name FROM documents)""")
def hand_authored_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("doc_id") % 3
    name = F.concat(F.when(third == 0, "fixture-").when(third == 1, "composite-").otherwise("my-fixture-"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).select("doc_id", "name", audit.hand_authored(F.col("name")).alias("hand_authored"))


_SAID = ["the tool doesn't exist in my toolset", "it isn't loaded in this session.", "there is no way to modify or save", "done"]


@query("""WITH t AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm, CASE WHEN event_type <> 'signup' THEN event_type = 'purchase' END AS changed, CASE WHEN event_id % 5 < 4 THEN ['the tool doesn''t exist in my toolset', 'it isn''t loaded in this session.', 'there is no way to modify or save', 'done'][event_id % 5 + 1] END AS result FROM events)
 SELECT event_id, arm = 'treatment' AND NOT coalesce(changed, false) AND coalesce(contains(result, 'doesn''t exist in my toolset') OR contains(result, 'isn''t loaded in this session') OR contains(result, 'no way to modify or save'), false) AS flake FROM t""")
def flake_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials that failed for want of tools; a null change or answer is none."""
    arm = F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment")
    said = F.get(F.array(*[F.lit(x) for x in _SAID]), (F.col("event_id") % 5).cast("int"))
    changed = F.when(F.col("event_type") != "signup", F.col("event_type") == "purchase")
    return table(spark, sf_dir, "events").select("event_id", audit.flake(arm, changed, said).alias("flake"))


@query("""WITH u AS (SELECT user_id, coalesce(list_distinct(list(event_id % 50) FILTER (event_type = 'click')), []) AS before, coalesce(list_distinct(list(event_id % 50) FILTER (event_type = 'view')), []) AS after, CASE WHEN user_id % 3 = 0 THEN user_id % 50 END AS owned FROM events GROUP BY user_id),
 d AS (SELECT *, list_sort(list_filter(after, lambda x: NOT list_contains(before, x))) AS fresh, list_sort(list_filter(before, lambda x: list_contains(after, x))) AS kept, coalesce(list_contains(after, owned), false) AS running FROM u)
 SELECT user_id, CASE WHEN running THEN 'orphan_still_running' WHEN len(fresh) > 0 THEN 'unattributed_new_process' ELSE 'clean_no_new_word_process' END AS status, array_to_string(fresh, ',') AS new_pids, array_to_string(kept, ',') AS untouched_pids,
 CASE WHEN running THEN owned::VARCHAR ELSE array_to_string(fresh, ',') END AS orphan_pids FROM d""")
def process_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event numbers stand in for process ids before and after a run."""
    pid = (F.col("event_id") % 50).cast("long")
    of = lambda kind: F.collect_set(F.when(F.col("event_type") == kind, pid))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(of("click").alias("before"), of("view").alias("after"))
    owned = F.when(F.col("user_id") % 3 == 0, (F.col("user_id") % 50).cast("long"))
    found = audit.orphans(F.col("before"), F.col("after"), owned)
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return users.select("user_id", found["status"].alias("status"), *[text(found[c]).alias(c) for c in ("new_pids", "untouched_pids", "orphan_pids")])


@query("""SELECT o_orderkey, coalesce(nullif(regexp_extract(hint, 'key=([A-Z0-9]+)', 1), ''), 'K' || o_orderkey) AS key, trim(regexp_replace(hint, 'key=([A-Z0-9]+)', '')) AS hint
 FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'see key=Z' || o_custkey || ' there' WHEN 1 THEN 'no hint' ELSE '' END AS hint FROM orders)""")
def key_remaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("o_orderkey") % 3
    hint = F.when(third == 0, F.concat(F.lit("see key=Z"), F.col("o_custkey").cast("string"), F.lit(" there"))).when(third == 1, "no hint").otherwise("")
    key, rest = audit.remap(F.concat(F.lit("K"), F.col("o_orderkey").cast("string")), hint, "key=([A-Z0-9]+)")
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"), rest.alias("hint"))


@query("""WITH c AS (SELECT l_orderkey AS item, l_linestatus AS variant, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1, 2)
 SELECT o.item, o.variant, array_to_string(list_filter([CASE WHEN o.n_lines <> b.n_lines THEN 'n_lines' END, CASE WHEN o.n_suppliers <> b.n_suppliers THEN 'n_suppliers' END], lambda x: x IS NOT NULL), ',') AS changed
 FROM c o JOIN c b ON b.item = o.item AND b.variant = 'F' AND o.variant <> 'F' WHERE o.n_lines <> b.n_lines OR o.n_suppliers <> b.n_suppliers""")
def structure_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line statuses as variants of an order, those with F as the baseline."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item"), F.col("l_linestatus").alias("variant")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("l_suppkey").alias("n_suppliers"))
    found = audit.structure_regressions(counts, "item", "variant", "F", ["n_lines", "n_suppliers"])
    return found.select("item", "variant", F.array_join("changed", ",").alias("changed"))


@query("""WITH s AS (SELECT p_partkey, [12240, 11906, 12240, 1000][p_partkey % 4 + 1] AS a, [15840, 16838, 20160, 2000][p_partkey % 4 + 1] AS b FROM part)
 SELECT p_partkey, ['a4', 'letter', 'legal', 'custom'][CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 4 END] AS size, upper(string_split(trim(['  seq Table', 'PAGE', 'ref x y', ' ' ][p_partkey % 3 + 1]), ' ')[1]) AS code FROM s""")
def page_sizes_and_field_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sizes in both orientations, and the words that field instructions begin with."""
    key = F.col("p_partkey")
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    a, b = pick([12240, 11906, 12240, 1000], key % 4), pick([15840, 16838, 20160, 2000], key % 4)
    turned = key % 8 > 3
    size = T.paper_size(F.when(turned, b).otherwise(a), F.when(turned, a).otherwise(b))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("size"), T.field_code(pick(["  seq Table", "PAGE", "ref x y"], key % 3)).alias("code"))


TARGET = 500


@query(f"""WITH RECURSIVE e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS o FROM documents WHERE text IS NOT NULL),
 k AS (SELECT doc_id, o, x, unnest(range(greatest(length(x) + {TARGET - 1}, {TARGET}) // {TARGET})) AS k FROM e),
 p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o, k) AS pos, substr(x, k * {TARGET} + 1, {TARGET}) AS piece FROM k),
 g(doc_id, pos, held, chunk) AS (SELECT doc_id, pos, length(piece), 0 FROM p WHERE pos = 1
  UNION ALL SELECT p.doc_id, p.pos, CASE WHEN held >= {TARGET} THEN 0 ELSE held END + length(piece), chunk + (held >= {TARGET})::INT FROM g JOIN p ON p.doc_id = g.doc_id AND p.pos = g.pos + 1)
 SELECT doc_id, chunk::BIGINT AS chunk, count(*) AS n_pieces, sum(length(piece))::BIGINT AS n_chars, md5(string_agg(piece, chr(10) ORDER BY pos)) AS text_md5 FROM g JOIN p USING (doc_id, pos) GROUP BY doc_id, chunk""")
def chunked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document in chunks of 500 characters."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("o", "line"))
    chunks = packing.pack_chunks(Tables(spark), lines, "doc_id", "o", "line", TARGET)
    return chunks.select("doc_id", "chunk", "n_pieces", "n_chars", F.md5("text").alias("text_md5"))


def _span_cells(spark: SparkSession, sf_dir: str, cols: str) -> DataFrame:
    """Line items as table cells: a table for each eight orders, a row for each order, and spans from their figures."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    return lines.select(
        F.shiftright("l_orderkey", 3).alias("doc"),
        (F.col("l_orderkey") % 8).cast("int").alias("row"),
        F.col("l_linenumber").cast("long").alias("cell"),
        (F.col("p") % 3 + 1).cast("int").alias("row_span"),
        F.expr(cols).cast("int").alias("col_span"),
    )


def _grid_sql(side: str, cols: str) -> str:
    """One cell after the other: slots taken by earlier rows as a list, the first free one at or behind the cell before."""
    return f"""c{side} AS (SELECT l_orderkey // 8 AS doc, l_orderkey % 8 AS row, l_linenumber AS cell, min(l_partkey) % 3 + 1 AS rs, {cols} AS cs FROM lineitem GROUP BY ALL),
 n{side} AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY row, cell) AS k FROM c{side}),
 w{side}(doc, k, row, cell, col, rs, cs, free, taken) AS (SELECT doc, 0::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM n{side} GROUP BY doc
  UNION ALL SELECT doc, k, row, cell, spot, rs, cs, spot + cs, list_concat(list_filter(taken, lambda x: x // 1000 >= row), list_transform(range(CASE WHEN rs > 1 THEN (rs - 1) * cs ELSE 0 END), lambda x: (row + 1 + x // cs) * 1000 + spot + x % cs))
   FROM (SELECT n.*, w.taken, list_min(list_filter(range(CASE WHEN n.row = w.row THEN w.free ELSE 0 END, 400), lambda x: NOT list_contains(w.taken, n.row * 1000 + x))) AS spot FROM w{side} w JOIN n{side} n ON n.doc = w.doc AND n.k = w.k + 1)),
 p{side} AS (SELECT doc, row, cell, col, rs, cs FROM w{side} WHERE k > 0)"""


_GOLD, _CAND = "s % 2 + 1", "CASE WHEN p % 7 = 0 THEN s % 3 + 1 ELSE s % 2 + 1 END"
_GOLD_SQL = _grid_sql("g", "min(l_suppkey) % 2 + 1")


@query(f"WITH RECURSIVE {_GOLD_SQL} SELECT doc, row::INT AS row, cell, col::INT AS col, rs::INT AS row_span, cs::INT AS col_span FROM pg")
def span_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.place_cells(_span_cells(spark, sf_dir, _GOLD), ["doc"])


@query(f"""WITH RECURSIVE {_GOLD_SQL}, {_grid_sql("c", "CASE WHEN min(l_partkey) % 7 = 0 THEN min(l_suppkey) % 3 + 1 ELSE min(l_suppkey) % 2 + 1 END")},
 t AS (SELECT doc, count(*) FILTER (g AND rs * cs > 1) AS n_gold, count(*) FILTER (c AND rs * cs > 1) AS n_cand, count(*) FILTER (g AND c AND rs * cs > 1) AS matched
  FROM (SELECT doc, row, col, rs, cs, bool_or(s = 0) AS g, bool_or(s = 1) AS c FROM (SELECT *, 0 AS s FROM pg UNION ALL SELECT *, 1 FROM pc) GROUP BY doc, row, col, rs, cs) GROUP BY doc)
 SELECT doc, n_gold, n_cand, matched, {prf1_sql("matched", "n_gold", "n_cand")} FROM t""")
def merged_cell_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged cells of a candidate that has other column spans in one cell of seven."""
    gold, cand = (spans.place_cells(_span_cells(spark, sf_dir, cols), ["doc"]) for cols in (_GOLD, _CAND))
    return spans.merged_cell_scores(gold, cand, ["doc"], "doc")
