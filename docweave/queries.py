"""The registered queries over the relational tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rule_queries
from .functions import globs, text as tx
from .model import Namespace, diagnostics
from .operators import core, graph, navigation as nav
from .sources import external, markdown, relational as rel, scan
from .sources.config import Config

AS_OF = "2001-08-01"


def _known_customers(spark, sf, declared=None):
    return rel.corpus(spark, sf, {"ORD": None, "CUST": "c_acctbal >= 0"}, [("ORD", "CUST")], declared)


def q_dep_resolved(spark, sf):
    c = _known_customers(spark, sf)
    found = core.dep_resolved(c, "ORD", {})
    return found.select(tx.number_of(F.col("path")).alias("o_orderkey"), tx.number_of(F.col("subject")).alias("o_custkey"))


def q_cross_ref_dedupe(spark, sf):
    known = rel.read(spark, sf, "part").where("p_size <= 25").select("p_partkey")
    items = rel.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_linenumber")
    lost = items.join(known, items.l_partkey == known.p_partkey, "left_anti")
    one = core.first_mentions(lost, ["l_orderkey", "l_partkey"], ["l_shipdate", "l_linenumber"])
    return one.select("l_orderkey", "l_partkey", "l_shipdate", "l_linenumber", "n")


def q_required_metadata(spark, sf):
    labels = rel.read(spark, sf, "labels").where("quality IS NOT NULL").select(F.col("doc_id").alias("number"), rel.json_text(F.col("quality")).alias("quality"))
    c = rel.corpus(spark, sf, {"DOC": None}, [])
    c.tables["docs"] = c.docs.join(labels, "number", "left").withColumn(
        "metadata", F.when(F.col("quality").isNotNull(), F.map_concat("metadata", F.create_map(F.lit("quality"), F.col("quality")))).otherwise(F.col("metadata")))
    found = core.required_metadata(c, "DOC", {"keys": ["lang", "quality"]})
    return found.select(tx.number_of(F.col("path")).alias("doc_id"), F.col("subject").alias("missing"))


def q_allowed_values(spark, sf):
    c = rel.corpus(spark, sf, {"ORD": None, "EVT": None}, [])
    a = core.allowed_values(c, "ORD", {"priority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]})
    b = core.allowed_values(c, "EVT", {"event_type": ["click", "view", "purchase"]})
    return a.unionByName(b).groupBy("subject", F.col("note").alias("value")).agg(F.count("*").alias("n"))


def q_calendar_fresh(spark, sf):
    c = rel.corpus(spark, sf, {"ORD": None}, [])
    c.tables["docs"] = c.docs.withColumn("metadata", F.map_from_arrays(F.array(F.lit("date")), F.array(F.concat(F.lit('"'), F.substring(F.get_json_object(F.col("metadata")["date"], "$"), 1, 10), F.lit('"')))))
    found = core.calendar_freshness(c, "ORD", {"field": "date", "stale_days": 365, "as_of": AS_OF})
    return found.select(tx.number_of(F.col("path")).alias("o_orderkey"), F.col("note").alias("due"))


def q_file_budget(spark, sf):
    found = core.file_budget(rel.corpus(spark, sf, {"DOC": None}, []), "DOC", {"max_chars": 20_000})
    return found.select(tx.number_of(F.col("path")).alias("doc_id"), F.col("subject").cast("long").alias("n_chars"))


def q_required_anchors(spark, sf):
    found = core.required_anchors(rel.corpus(spark, sf, {"PAGE": None}, []), "PAGE", {"anchors": ["</html>"]})
    return found.select(tx.number_of(F.col("path")).alias("page_id"), F.col("subject").alias("anchor"))


def q_refs(spark, sf):
    """All that points at customer 7 and at region 1."""
    c = rel.corpus(spark, sf, {"CUST": None, "ORD": None, "REG": None, "NAT": None}, [("ORD", "CUST"), ("NAT", "REG"), ("CUST", "NAT")])
    region = nav.refs(c, "REG", 1).select(F.lit("REG-1").alias("target"), "file", "kind")
    cust = nav.refs(c, "CUST", 7).select(F.lit("CUST-7").alias("target"), "file", "kind")
    return cust.unionByName(region)


def q_status(spark, sf):
    """Orders wait for their items' parts: a part above 40 is open, one above 30 untracked."""
    orders = rel.corpus(spark, sf, {"ORD": None}, [("ITEM", "PART")])
    part = rel.read(spark, sf, "part").select(
        F.lit("PART").alias("ns"), F.col("p_partkey").alias("number"),
        F.when(F.col("p_size") > 40, "open").when(F.col("p_size") > 30, F.lit(None).cast("string")).otherwise("F").alias("status"))
    items = rel.read(spark, sf, "lineitem").select(
        F.concat(F.lit("ORD-"), F.col("l_orderkey")).alias("src_key"), F.lit("ORD").alias("src_ns"), F.lit("depends_on").alias("kind"),
        F.lit("PART").alias("dst_ns"), F.col("l_partkey").cast("long").alias("dst_number")).distinct()
    orders.tables["docs"] = orders.docs.unionByName(part, allowMissingColumns=True)
    orders.tables["edges"] = items
    states = nav.status(orders, ["F"]).where("ns = 'ORD'")
    return states.groupBy("state", "settled_on_open").agg(F.count("*").alias("n"))


def _below_region(spark, sf):
    c = rel.corpus(spark, sf, {"REG": "r_regionkey = 0"}, [])
    target = ["REG", "NAT", "CUST"]
    steps = None
    for src, dst in (("NAT", "REG"), ("CUST", "NAT"), ("ORD", "CUST")):
        part = rel.edges(spark, sf, src, dst).select(F.col("dst_raw").alias("src"), F.col("src_key").alias("dst"))
        steps = part if steps is None else steps.unionByName(part)
    return steps, c.docs.select(F.col("doc_key").alias("node")), target


def q_lineage(spark, sf):
    steps, roots, _ = _below_region(spark, sf)
    return graph.reach(steps, roots).where("depth > 0").select("node", "depth")


def q_turn_chain(spark, sf):
    turns = rel.read(spark, sf, "conversations").select("conv_id", "turn").distinct()
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    steps = nxt.join(turns, ["conv_id", "turn"]).select(
        F.struct("conv_id", "turn").alias("src"), F.struct("conv_id", (F.col("turn") + 1).alias("turn")).alias("dst"))
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(F.struct("conv_id", "turn").alias("node"))
    found = graph.reach(steps, first)
    return found.select("node.conv_id", "node.turn", "depth")


def q_cycle(spark, sf):
    """A functional graph over the parts, k -> (k * k + 1) mod n (made up for the purpose)."""
    parts = rel.read(spark, sf, "part").select("p_partkey")
    n = parts.agg(F.count("*").alias("n"))
    edges = parts.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * F.col("p_partkey") + 1) % F.col("n")).alias("dst"))
    return graph.cycle_members(edges).select(F.col("node").alias("p_partkey"))


_CLAIMS = {"EN": ["*/en/*"], "DE": ["*/de/*"], "EXAMPLE": ["*example*/?n/*"]}


def _claimed(spark, sf):
    rows = [(ns, globs.any_of(gs)) for ns, gs in _CLAIMS.items()]
    return nav.claims(rel.read(spark, sf, "pages").select(F.col("url").alias("path")), spark.createDataFrame(rows, "ns string, rx string"))


def q_claim_globs(spark, sf):
    return nav.conflicts(_claimed(spark, sf))


def q_namespaces(spark, sf):
    declared = spark.createDataFrame([("en", "a"), ("de", None), ("fr", "b"), ("it", None)], "ns string, owner string")
    counts = rel.read(spark, sf, "documents").groupBy(F.col("lang").alias("ns")).agg(F.count("*").alias("n_docs"))
    return nav.with_counts(declared, counts).select("ns", "owner", "n_docs")


def q_next_id(spark, sf):
    return nav.next_ids(rel.corpus(spark, sf, {"CUST": None, "ORD": None, "PART": None, "DOC": None}, []).docs)


def q_briefing(spark, sf):
    c = rel.corpus(spark, sf, {"ORD": None}, [], [Namespace("ORD", briefing={"statuses": ["P"], "counts": ["O", "F"]})])
    out = nav.briefing(c)
    return out.groupBy("kind", "what", "place").agg(F.sum("n").alias("n"))


def q_first_release(spark, sf):
    orders = rel.read(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM").alias("tag"), F.date_format("o_orderdate", "yyyyMM").cast("long").alias("tag_order"))
    return nav.first_settled(orders, ["o_custkey"], "tag_order").select("o_custkey", "tag")


def q_nearest(spark, sf):
    names = rel.read(spark, sf, "part").select(F.col("p_type").alias("name")).distinct()
    known = spark.createDataFrame([(x,) for x in ("STANDARD", "PROMO STEEL", "ECONOMY TIN", "SMALL BRASS", "LARGE COPPER")], "known_name string")
    return nav.nearest(names, known)


def q_pack_drift(spark, sf):
    cust = rel.read(spark, sf, "customer")
    print_ = F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256)
    old = cust.where("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.sha2(F.col("c_name"), 256)).otherwise(print_).alias("fp"))
    new = cust.where("c_custkey % 11 <> 0").select("c_custkey", print_.alias("fp"))
    return nav.drift(old, new, "c_custkey", "fp")


def summary_diagnostics(spark, sf):
    """Diagnostics of five rules over the relational corpus."""
    c = _known_customers(spark, sf)
    docs = rel.corpus(spark, sf, {"DOC": None}, [])
    pages = rel.corpus(spark, sf, {"PAGE": None}, [])
    parts = [
        diagnostics(core.dep_resolved(c, "ORD", {}), "core.dep-resolved", "error", "{} is no known document"),
        diagnostics(core.allowed_values(c, "ORD", {"priority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}), "core.allowed-values", "error", "value of {} is not allowed"),
        diagnostics(core.file_budget(docs, "DOC", {}), "core.file-budget", "warning", "{} characters"),
        diagnostics(core.required_anchors(pages, "PAGE", {"anchors": ["</html>"]}), "core.required-anchors", "warning", "{} is missing"),
        diagnostics(core.required_metadata(docs, "DOC", {"keys": ["quality"]}), "core.required-metadata", "info", "{} is missing"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_summary(spark, sf):
    return summary_diagnostics(spark, sf).groupBy("code").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"), F.count_distinct("path").alias("files"))


def _markdown(spark, sf):
    """Documents rendered as markdown envelopes and parsed back: every document mentions its successor, and more."""
    n = F.col("doc_id")
    body = F.concat(
        F.lit("---\nstatus: "), F.when(n % 3 == 0, "done").otherwise("open"), F.lit("\n---\n# T\n## "), F.when(n % 2 == 0, "1. Status:").otherwise("State"),
        F.lit("\nSee DOC-00"), (n + 1).cast("string"), F.lit(", `DOC-999999` and ~~DOC-888888~~.\n- ["), F.when(n % 4 == 0, "x").otherwise(" "), F.lit("] box\n```\nDOC-777777\n```\n"),
        F.coalesce("text", F.lit("")), F.lit("\nagain DOC-"), (n + 1).cast("string"))
    raw = rel.read(spark, sf, "documents").select(
        F.concat(F.lit("DOC-"), n.cast("string")).alias("id"), body.alias("body"), F.concat(F.lit("docs/"), n.cast("string"), F.lit(".md")).alias("location"),
        F.array().cast("array<string>").alias("depends_on"), F.array().cast("array<string>").alias("part_of"), F.lit("{}").alias("extra_json"))
    return markdown.build(spark, external.parse_envelopes(raw), Config(namespaces=[Namespace("DOC")]), "source")


def _path_number(df, *more):
    return df.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("doc_id"), *more)


def q_md_cross_ref(spark, sf):
    found = core.cross_ref(_markdown(spark, sf), "DOC", {})
    return _path_number(found, F.col("subject").alias("mention"), F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), "note")


def q_md_required_headings(spark, sf):
    return _path_number(core.required_headings(_markdown(spark, sf), "DOC", {"headings": ["Status"]}), F.col("subject").alias("heading"))


def q_md_acceptance(spark, sf):
    p = {"terminal": ["done"], "headings": ["Status", "State"]}
    return _path_number(core.acceptance_complete(_markdown(spark, sf), "DOC", p), F.col("line").cast("long").alias("line"))


def q_md_refs(spark, sf):
    return nav.refs(_markdown(spark, sf), "DOC", 5).select("file", F.col("line").cast("long").alias("line"), F.col("kind"))


def q_scan_hits(spark, sf):
    """A line scanner over made-up source files: one mention in three is hushed by a marker."""
    n = F.col("o_orderkey")
    text = F.concat(
        F.lit("x = CUST-"), F.col("o_custkey").cast("string"), F.when(n % 3 == 0, f"  // {scan.IGNORE_LINE}").otherwise(""), F.lit("\n"),
        F.when(n % 2 == 0, f"// {scan.IGNORE_NEXT}").otherwise("//"), F.lit("\nHTTP-2 ORD-7 and CUST-00"), F.col("o_custkey").cast("string"))
    files = rel.read(spark, sf, "orders").select(F.concat(F.lit("f"), n.cast("string")).alias("location"), text.cast("binary").alias("content"))
    hits = scan.hits(scan.lines(files), ["CUST", "ORD"])
    return hits.select(F.substring("file", 2, 20).cast("long").alias("o_orderkey"), "ns", "number", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"))


SQL: dict[str, str] = {
    "q_md_cross_ref": """
        WITH b AS (SELECT doc_id, coalesce(text, '') AS text, doc_id + 1 AS n FROM documents)
        SELECT doc_id, 'DOC-00' || n AS mention, 6::BIGINT AS line, 5::BIGINT AS col, '2 mentions' AS note FROM b WHERE n NOT IN (SELECT doc_id FROM documents)""",
    "q_md_required_headings": "SELECT doc_id, 'Status' AS heading FROM documents WHERE doc_id % 2 <> 0",
    "q_md_acceptance": "SELECT doc_id, 7::BIGINT AS line FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0",
    "q_md_refs": """
        SELECT 'docs/5.md' AS file, 0::BIGINT AS line, 'self' AS kind FROM documents WHERE doc_id = 5
        UNION ALL SELECT 'docs/4.md', 6, 'body' FROM documents WHERE doc_id = 4
        UNION ALL SELECT 'docs/4.md', 11 + length(text) - length(replace(text, chr(10), '')) + 1, 'body' FROM documents WHERE doc_id = 4""",
    "q_scan_hits": """
        SELECT o_orderkey, 'CUST' AS ns, o_custkey AS number, 1::BIGINT AS line, 5::BIGINT AS col FROM orders WHERE o_orderkey % 3 <> 0
        UNION ALL SELECT o_orderkey, 'ORD', 7, 3, 8 FROM orders WHERE o_orderkey % 2 <> 0
        UNION ALL SELECT o_orderkey, 'CUST', o_custkey, 3, 18 FROM orders WHERE o_orderkey % 2 <> 0""",
    "q_dep_resolved": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)",
    "q_cross_ref_dedupe": """
        SELECT l_orderkey, l_partkey, l_shipdate, l_linenumber, n FROM (
          SELECT l_orderkey, l_partkey, l_shipdate, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS n,
                 row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate, l_linenumber) AS nth
          FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)) WHERE nth = 1""",
    "q_required_metadata": "SELECT d.doc_id, 'quality' AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality IS NOT NULL WHERE l.doc_id IS NULL",
    "q_allowed_values": """
        SELECT 'priority' AS subject, o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY ALL
        UNION ALL SELECT 'event_type', event_type, count(*) FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY ALL""",
    "q_calendar_fresh": f"SELECT o_orderkey, strftime(o_orderdate::DATE + 365, '%Y-%m-%d') AS due FROM orders WHERE o_orderdate::DATE + 365 < DATE '{AS_OF}'",
    "q_file_budget": "SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) > 20000",
    "q_required_anchors": "SELECT page_id, '</html>' AS anchor FROM pages WHERE html IS NULL OR NOT contains(html, '</html>')",
    "q_refs": """
        SELECT 'CUST-7' AS target, 'CUST-7' AS file, 'self' AS kind FROM customer WHERE c_custkey = 7
        UNION ALL SELECT 'REG-1', 'REG-1', 'self' FROM region WHERE r_regionkey = 1
        UNION ALL SELECT 'CUST-7', 'ORD-' || o_orderkey, 'depends_on' FROM orders WHERE o_custkey = 7
        UNION ALL SELECT 'REG-1', 'NAT-' || n_nationkey, 'depends_on' FROM nation WHERE n_regionkey = 1""",
    "q_status": """
        WITH p AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'open' WHEN p_size > 30 THEN NULL ELSE 'F' END AS st FROM part),
        b AS (SELECT l_orderkey, bool_or(st IS NOT NULL AND st <> 'F') AS blocked FROM lineitem JOIN p ON l_partkey = p_partkey GROUP BY l_orderkey),
        s AS (SELECT CASE WHEN o_orderstatus IS NULL THEN 'untracked' WHEN o_orderstatus = 'F' THEN 'settled' WHEN coalesce(blocked, false) THEN 'blocked' ELSE 'ready' END AS state,
                     o_orderstatus = 'F' AND coalesce(blocked, false) AS settled_on_open
              FROM orders LEFT JOIN b ON o_orderkey = l_orderkey)
        SELECT state, settled_on_open, count(*) AS n FROM s GROUP BY ALL""",
    "q_lineage": """
        WITH RECURSIVE e AS (
          SELECT 'REG-' || n_regionkey AS src, 'NAT-' || n_nationkey AS dst FROM nation
          UNION ALL SELECT 'NAT-' || c_nationkey, 'CUST-' || c_custkey FROM customer
          UNION ALL SELECT 'CUST-' || o_custkey, 'ORD-' || o_orderkey FROM orders),
        r AS (SELECT 'REG-0' AS node, 0::BIGINT AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node)
        SELECT node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY node""",
    "q_turn_chain": """
        WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations),
        r AS (SELECT conv_id, min(turn) AS turn, 0::BIGINT AS depth FROM t GROUP BY conv_id
              UNION ALL SELECT t.conv_id, t.turn, depth + 1 FROM r JOIN t ON t.conv_id = r.conv_id AND t.turn = r.turn + 1)
        SELECT conv_id, turn, depth FROM r""",
    "q_cycle": """
        WITH RECURSIVE e AS (SELECT p_partkey AS src, (p_partkey * p_partkey + 1) % (SELECT count(*) FROM part) AS dst FROM part),
        r AS (SELECT src AS root, dst AS node FROM e UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.node)
        SELECT DISTINCT root AS p_partkey FROM r WHERE root = node""",
    "q_claim_globs": f"""
        WITH g AS (SELECT * FROM (VALUES {", ".join(f"('{ns}', '{globs.any_of(gs)}')" for ns, gs in _CLAIMS.items())}) v(ns, rx)),
        m AS (SELECT DISTINCT url AS path, ns FROM pages JOIN g ON regexp_matches(url, rx))
        SELECT path, count(DISTINCT ns) AS n_ns, string_agg(ns, ',' ORDER BY ns) AS namespaces FROM m GROUP BY path HAVING count(DISTINCT ns) > 1""",
    "q_namespaces": "SELECT ns, owner, count(doc_id) AS n_docs FROM (VALUES ('en', 'a'), ('de', NULL), ('fr', 'b'), ('it', NULL)) v(ns, owner) LEFT JOIN documents ON lang = ns GROUP BY ns, owner",
    "q_next_id": """
        SELECT 'CUST' AS ns, max(c_custkey) + 1 AS next_id FROM customer UNION ALL SELECT 'ORD', max(o_orderkey) + 1 FROM orders
        UNION ALL SELECT 'PART', max(p_partkey) + 1 FROM part UNION ALL SELECT 'DOC', max(doc_id) + 1 FROM documents""",
    "q_briefing": """
        SELECT 'document' AS kind, 'P' AS what, 1::BIGINT AS place, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT 'count', o_orderstatus, 1000, count(*) FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY o_orderstatus""",
    "q_first_release": "SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m') AS tag FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey",
    "q_nearest": """
        WITH n AS (SELECT DISTINCT p_type AS name FROM part), k AS (SELECT unnest(['STANDARD', 'PROMO STEEL', 'ECONOMY TIN', 'SMALL BRASS', 'LARGE COPPER']) AS known_name)
        SELECT name, known_name AS nearest, d AS distance FROM (
          SELECT name, known_name, levenshtein(name, known_name)::BIGINT AS d, row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, known_name), known_name) AS r FROM n, k) WHERE r = 1""",
    "q_pack_drift": """
        WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN sha256(c_name) ELSE sha256(c_name || '|' || c_mktsegment) END AS was FROM customer WHERE c_custkey % 7 <> 0),
        n AS (SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS now FROM customer WHERE c_custkey % 11 <> 0)
        SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN was IS NULL THEN 'no baseline' WHEN now IS NULL THEN 'gone' WHEN was = now THEN 'current' ELSE 'drift' END AS state
        FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""",
    "q_summary": """
        SELECT * FROM (
        SELECT 'core.dep-resolved' AS code, count(*) AS errors, 0::BIGINT AS warnings, 0::BIGINT AS infos, count(DISTINCT o_orderkey) AS files
        FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)
        UNION ALL SELECT 'core.allowed-values', count(*), 0, 0, count(DISTINCT o_orderkey) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
        UNION ALL SELECT 'core.file-budget', 0, count(*), 0, count(DISTINCT doc_id) FROM documents WHERE length(text) > 20000
        UNION ALL SELECT 'core.required-anchors', 0, count(*), 0, count(DISTINCT page_id) FROM pages WHERE NOT contains(html, '</html>')
        UNION ALL SELECT 'core.required-metadata', 0, 0, count(*), count(DISTINCT doc_id) FROM documents) WHERE files > 0""",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL} | rule_queries.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | rule_queries.oracle_sql()
