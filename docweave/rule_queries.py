"""Registered queries that run the rules themselves over a corpus made of orders, each with its SQL.

Every order is a document of namespace ORD; what stands in it (headings, boxes,
links, metadata) follows from its number by simple arithmetic, so that SQL can
say which findings there must be.  The rules see nothing but entity tables, as
they do behind any other source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import globs, text as tx
from .model import TABLES, Corpus, Namespace, shaped
from .operators import kernel, navigation as nav
from .plans import registry, report
from .sources import relational as rel

AS_OF = "2001-08-01"


def _n() -> Column:
    return F.col("o_orderkey")


def _key() -> Column:
    return F.concat(F.lit("ORD-"), _n().cast("string"))


def _text(value: Column | str) -> Column:
    """A string as the metadata map holds it."""
    return F.concat(F.lit('"'), F.lit(value) if isinstance(value, str) else value, F.lit('"'))


def _metadata(**values: Column) -> Column:
    """The metadata map; a key whose value is null is not there."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))


def _orders(spark: SparkSession, sf: str, **more: Column) -> DataFrame:
    base = {"doc_key": _key(), "id": _key(), "ns": F.lit("ORD"), "number": _n().cast("long"), "location": _key(), "status": F.col("o_orderstatus"), "title": _key()}
    return rel.read(spark, sf, "orders").select(*[c.alias(k) for k, c in {**base, **more}.items()])


def _inside(spark: SparkSession, sf: str, where: Column | bool = True, **columns: Column) -> DataFrame:
    """Rows of an entity table, one for each order where the condition holds."""
    df = rel.read(spark, sf, "orders")
    df = df if where is True else df.where(where)
    return df.select(_key().alias("doc_key"), *[c.alias(k) for k, c in columns.items()])


def _to(spark: SparkSession, sf: str, kind: str, to: Column, where: Column) -> DataFrame:
    """Pointers from orders to orders."""
    row = {"src_key": _key(), "src_ns": F.lit("ORD"), "kind": F.lit(kind), "dst_raw": F.concat(F.lit("ORD-"), to.cast("string")), "dst_ns": F.lit("ORD"), "dst_number": to.cast("long"), "line": F.lit(4)}
    return rel.read(spark, sf, "orders").where(where).select(*[c.alias(k) for k, c in row.items()])


def _corpus(spark: SparkSession, namespaces: list[Namespace] | None = None, **tables: DataFrame) -> Corpus:
    return Corpus(spark, {k: shaped(df, TABLES[k]) for k, df in tables.items()}, namespaces or [Namespace("ORD")])


def _paths(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string")


def _found(df: DataFrame) -> DataFrame:
    return df.select(
        tx.number_of(F.col("path")).alias("n"), F.col("subject"), F.col("note"), F.col("line").cast("long").alias("line")
    )


def _run(code: str, c: Corpus, p: dict | None = None, ns: str = "ORD") -> DataFrame:
    """The findings of a registered rule."""
    return _found(registry.RULES[code].run(c, ns, p or {}))


# --- documents ---------------------------------------------------------------


def q_rule_frontmatter(spark, sf):
    error = F.when(_n() % 11 == 0, F.concat(F.lit("line "), (_n() % 5).cast("string")))
    return _run("core.frontmatter", _corpus(spark, docs=_orders(spark, sf, parse_error=error)))


def q_rule_id(spark, sf):
    docs = _orders(spark, sf, id=F.when(_n() % 7 != 0, _key()), number=F.when(_n() % 5 != 0, _n().cast("long")), parse_error=F.when(_n() % 11 == 0, "bad"))
    return _run("core.id", _corpus(spark, docs=docs))


def q_rule_file_name(spark, sf):
    name = F.concat(F.lit("docs/"), F.when(_n() % 2 == 0, "ORD-").otherwise(""), F.when(_n() % 9 == 0, _n() + 1).otherwise(_n()).cast("string"), F.lit("-x.md"))
    return _run("core.file-name", _corpus(spark, docs=_orders(spark, sf, file=name)))


def q_rule_metadata_format(spark, sf):
    events = rel.read(spark, sf, "events")
    n, at = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    day = F.when(n % 7 == 0, "2024-02-30").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    when = F.when(n % 5 == 0, at).otherwise(F.concat(at, F.lit("Z")))
    docs = events.select(F.lit("EVT").alias("ns"), F.concat(F.lit("EVT-"), n.cast("string")).alias("location"), _metadata(day=_text(day), at=_text(when)).alias("metadata"))
    found = _run("core.metadata-format", _corpus(spark, docs=docs), {"day": "date", "at": "datetime"}, "EVT")
    return found.select("n", "subject", "note")


def q_rule_min_docs(spark, sf):
    docs = rel.read(spark, sf, "customer").select(F.col("c_mktsegment").alias("ns"), F.col("c_name").alias("location"))
    c, out = _corpus(spark, docs=docs), None
    for ns in ("AUTOMOBILE", "BUILDING", "GARDEN", "TOYS"):
        part = registry.RULES["core.min-docs"].run(c, ns, {}).select("subject")
        out = part if out is None else out.unionByName(part)
    return out


def q_rule_id_unique(spark, sf):
    c = rel.corpus(spark, sf, {"ITEM": None}, [])
    return registry.RULES["core.id-unique"].run(c, "ITEM", {}).select("path", "subject", "note")


def q_rule_headings_code(spark, sf):
    """Sections by status, with a command under one of them."""
    heads = _inside(spark, sf, _n() % 3 != 0, level=F.lit(2), text=F.lit("1. Rollback:"), norm=F.lit("rollback"), line=F.lit(6), code=_n() % 2 == 0)
    c = _corpus(spark, docs=_orders(spark, sf), headings=heads)
    return _run("core.required-headings", c, {"headings": ["Rollback"], "statuses": ["F", "P"], "code_in": ["Rollback"]})


def q_rule_section_order(spark, sf):
    rows = None
    for line, name in ((10, "Color"), (20, "Type"), (30, "Color"), (5, "Space")):
        at = F.when((_n() % 4 == 0) & (F.lit(name) == "Type"), 7).otherwise(line)
        there = (_n() % 3 == 0) if line == 30 else (_n() % 5 != 0) if name == "Space" else F.lit(True)
        part = _inside(spark, sf, there, level=F.lit(2), text=F.lit(name), norm=F.lit(name.lower()), line=at)
        rows = part if rows is None else rows.unionByName(part)
    return _run("design.section-order", _corpus(spark, docs=_orders(spark, sf), headings=rows), {"sections": ["Color", "Type", "Space"]})


def q_rule_soul_sections(spark, sf):
    heads = _inside(spark, sf, _n() % 4 != 0, level=F.lit(1), text=F.lit("T"), norm=F.lit("t"), line=F.lit(1)).unionByName(
        _inside(spark, sf, _n() % 3 != 0, level=F.when(_n() % 2 == 0, 2).otherwise(3), text=F.lit("Voice"), norm=F.lit("voice"), line=F.lit(8)))
    return _run("soul.sections", _corpus(spark, docs=_orders(spark, sf), headings=heads), {"sections": ["Voice", "Values"]})


def q_rule_clause_syntax(spark, sf):
    clause = F.element_at(F.array(
        F.lit("**EARS-1** The pump shall stop."), F.lit("EARS-2: it stops"), F.lit("EARS-3 When full it shall stop"),
        F.lit("EARS-4 the pump, if full, shall stop"), F.lit("EARS-5 While dry, when full, the pump shall stop"), F.lit("no id")), (_n() % 6 + 1).cast("int"))
    items = _inside(spark, sf, section=F.lit("requirements"), text=clause, line=F.lit(9))
    return _run("ears.clause-syntax", _corpus(spark, docs=_orders(spark, sf), list_items=items))


def q_rule_checklist_complete(spark, sf):
    boxes = _inside(spark, sf, section=F.lit("x"), checked=_n() % 3 == 0, line=F.lit(3)).unionByName(_inside(spark, sf, section=F.lit("x"), checked=_n() % 5 == 0, line=F.lit(5)))
    docs = _orders(spark, sf, status=F.when(_n() % 2 == 0, "sealed").otherwise("open"))
    return _run("checklist.complete", _corpus(spark, docs=docs, checkboxes=boxes))


def q_rule_checklist_pinned(spark, sf):
    """Without a history, a well-formed commit can only be warned about."""
    commit = F.when(_n() % 3 == 0, F.repeat(F.lit("ab"), 20)).when(_n() % 3 == 1, F.lit("main"))
    docs = _orders(spark, sf, status=F.when(_n() % 2 == 0, "sealed"), metadata=_metadata(pinned_commit=_text(commit)), key_lines=F.create_map(F.lit("pinned_commit"), F.lit(3)))
    return _run("checklist.pinned", _corpus(spark, docs=docs))


def q_rule_todo_structure(spark, sf):
    heads = _inside(spark, sf, _n() % 2 == 0, level=F.lit(3), text=F.lit("TODO"), norm=F.lit("todo"), line=F.lit(4)).unionByName(
        _inside(spark, sf, _n() % 5 != 0, level=F.lit(3), text=F.lit("Context"), norm=F.lit("context"), line=F.lit(8)))
    boxes = _inside(spark, sf, _n() % 3 != 0, section=F.lit("todo"), checked=F.lit(False), line=F.lit(5))
    return _run("todo.structure", _corpus(spark, docs=_orders(spark, sf), headings=heads, checkboxes=boxes))


def q_rule_todo_sections(spark, sf):
    heads = _inside(spark, sf, _n() % 3 != 0, level=F.lit(2), text=F.lit("Now"), norm=F.lit("now"), line=F.when(_n() % 2 == 0, 9).otherwise(2)).unionByName(
        _inside(spark, sf, level=F.lit(2), text=F.lit("Done"), norm=F.lit("done"), line=F.lit(5)))
    return _run("todo.sections", _corpus(spark, docs=_orders(spark, sf), headings=heads), {"sections": ["Now", "Done"]})


def q_rule_todo_freshness(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    body = F.when(_n() % 9 == 0, F.lit("no date")).otherwise(F.concat(F.lit("# To do\n*Last updated: "), day, F.lit("*\n")))
    return _run("todo.freshness", _corpus(spark, docs=_orders(spark, sf, body=body)), {"stale_days": 100, "as_of": AS_OF})


def q_rule_todo_listed(spark, sf):
    listed = rel.read(spark, sf, "orders").where(_n() % 3 == 0).select(F.lit("TODO.md").alias("doc_key"), F.lit("ORD").alias("ns"), _n().cast("long").alias("number"))
    return _run("todo.listed", _corpus(spark, docs=_orders(spark, sf), tokens=listed), {"terminal": ["F"]})


def q_rule_context_budget(spark, sf):
    c = rel.corpus(spark, sf, {"DOC": None}, [])
    links = rel.read(spark, sf, "documents").where("doc_id % 50 = 0").select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("doc_key"), F.lit("import").alias("kind"), F.lit("@x.md").alias("target"),
        F.when(F.col("doc_id") % 100 == 0, "x.md").otherwise("y.md").alias("path"), F.lit(2).alias("line"))
    c.tables |= {"links": shaped(links, TABLES["links"]), "files": _paths(spark, "x.md")}
    return _run("agents.context-budget", c, {"max_words": 1000}, "DOC")


def q_rule_context_headings(spark, sf):
    heads = _inside(spark, sf, _n() % 5 == 0, level=F.lit(2), text=F.lit("Current State"), norm=F.lit("current state"), line=F.lit(7))
    kind = F.when(_n() % 3 == 0, "import").otherwise("link")
    links = _inside(spark, sf, _n() % 2 == 0, kind=kind, target=F.lit("TODO.md"), path=F.lit("TODO.md"), line=F.lit(3))
    c = _corpus(spark, docs=_orders(spark, sf), headings=heads, links=links, files=_paths(spark, "TODO.md"))
    return _run("agents.context-headings", c)


def q_rule_banned_prose(spark, sf):
    c = rel.corpus(spark, sf, {"DOC": None}, [])
    return _run("writing.banned-prose", c, {"terms": ["under", "und", "avec", "c++ (\\E)"]}, "DOC").select("n", "subject")


def q_rule_skills(spark, sf):
    meta = _metadata(name=F.when(_n() % 3 != 0, _text(F.when(_n() % 2 == 0, " ").otherwise("n"))), description=_text(F.when(_n() % 5 == 0, "").otherwise("d")))
    return _run("skills.frontmatter", _corpus(spark, docs=_orders(spark, sf, metadata=meta)))


def _agents(spark, sf):
    about = F.repeat(F.lit("x"), F.when(_n() % 3 == 0, 10).when(_n() % 3 == 1, 60).otherwise(2000).cast("int"))
    meta = _metadata(name=_text(F.when(_n() % 2 == 0, _key()).otherwise(F.lit("other"))), description=_text(about), model=_text(F.when(_n() % 5 == 0, "fast").otherwise("large")))
    return _corpus(spark, docs=_orders(spark, sf, location=F.concat(F.lit("agents/"), _key(), F.lit(".md")), metadata=meta))


def q_rule_agent_frontmatter(spark, sf):
    found = registry.RULES["agent.frontmatter"].run(_agents(spark, sf), "ORD", {"models": ["large"]})
    return found.select("path", "subject", "note", "severity")


def q_rule_plain_agent(spark, sf):
    found = registry.RULES["opencode.frontmatter"].run(_agents(spark, sf), "ORD", {"models": ["fast"]})
    return found.select("path", "subject", "severity")


def q_rule_agent_assigned(spark, sf):
    parts = rel.read(spark, sf, "part")
    key = F.concat(F.lit("PART-"), F.col("p_partkey").cast("string"))
    docs = parts.select(key.alias("doc_key"), F.lit("PART").alias("ns"), key.alias("location"), _metadata(agents=F.concat(F.lit("["), _text(F.col("p_type")), F.lit("]"))).alias("metadata"))
    files = _paths(spark, *(f"agents/{x}.md" for x in ("STANDARD", "PROMO STEEL", "SMALL BRASS", "LARGE COPPER")), "docs/ECONOMY.md")
    return _run("agent.assigned", _corpus(spark, docs=docs, files=files), {"builtin_agents": ["ECONOMY TIN"]}, "PART").select("n", "subject", "note")


def q_rule_guide(spark, sf):
    kind = F.when(_n() % 3 == 0, F.lit('{"type": "tutorial"}')).when(_n() % 3 == 1, F.lit('{"type": "poem"}'))
    docs = _orders(spark, sf, metadata=_metadata(title=F.when(_n() % 2 == 0, _text("t")), diataxis=kind))
    return _run("guide.frontmatter", _corpus(spark, docs=docs), {"types": ["tutorial", "how-to"]})


def q_rule_c4(spark, sf):
    docs = _orders(spark, sf, metadata=_metadata(title=_text("t"), c4=F.concat(F.lit('{"level": '), (_n() % 6).cast("string"), F.lit("}"))))
    return _run("c4.frontmatter", _corpus(spark, docs=docs), {"levels": ["1", "2", "3", "4"]})


def q_rule_token_ref(spark, sf):
    meta = _metadata(color=F.when(_n() % 2 == 0, F.lit('{"primary": "#000", "scale": {"x1": 1}}')).otherwise(F.lit('{"primary": "#000"}')))
    docs = _orders(spark, sf, metadata=meta, body=F.lit("{color.primary} and {color.scale.x1}, {color.primary}, {space.gap} {not a ref}"))
    return _run("design.token-ref", _corpus(spark, docs=docs))


# --- pointers ----------------------------------------------------------------


def _customers(spark, sf, status: str = "CASE WHEN c_acctbal < 0 THEN 'O' WHEN c_acctbal < 1000 THEN 'P' WHEN c_acctbal < 9000 THEN 'F' END"):
    """Orders, twice each customer (ids are not always unique), and the pointers from orders to them."""
    c = rel.corpus(spark, sf, {"ORD": None}, [("ORD", "CUST")])
    cust = rel.read(spark, sf, "customer").select(
        F.concat(F.lit("CUST-"), F.col("c_custkey").cast("string")).alias("doc_key"), F.lit("CUST").alias("ns"), F.col("c_custkey").cast("long").alias("number"), F.expr(status).alias("status"))
    c.tables["docs"] = c.docs.unionByName(shaped(cust, TABLES["docs"])).unionByName(shaped(cust, TABLES["docs"]))
    return c


def q_rule_dep_status(spark, sf):
    return _run("core.dep-status", _customers(spark, sf), {"terminal": ["F"]}).select("n", "subject", "note")


def q_rule_dep_satisfied(spark, sf):
    found = registry.RULES["core.dep-status"].run(_customers(spark, sf), "ORD", {"terminal": ["F"], "satisfied-by": {"CUST": ["F", "P"]}, "containers": ["CUST"]})
    return found.groupBy("note", "severity").agg(F.count("*").alias("n"))


def q_rule_dep_cycle(spark, sf):
    """Each tenth order and the two after it form a ring; the next one points into it."""
    docs = _orders(spark, sf, number=(_n() * 1).cast("long"), key_lines=F.create_map(F.lit("depends_on"), F.lit(4)))
    to = F.when(_n() % 10 == 2, _n() - 2).otherwise(F.when(_n() % 10 == 3, _n() - 1).otherwise(_n() + 1))
    return _run("core.dep-cycle", _corpus(spark, docs=docs, edges=_to(spark, sf, "depends_on", to, _n() % 10 < 4))).select("n", "subject", "note", "line")


def q_rule_dep_shape(spark, sf):
    docs = _orders(spark, sf)
    parts = rel.read(spark, sf, "part").select(F.lit("PART").alias("ns"), F.col("p_partkey").cast("long").alias("number"), F.col("p_brand").alias("status"))
    items = rel.read(spark, sf, "lineitem").select(
        F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string")).alias("src_key"), F.lit("ORD").alias("src_ns"), F.lit("depends_on").alias("kind"),
        F.lit("PART").alias("dst_ns"), F.col("l_partkey").cast("long").alias("dst_number"))
    c = _corpus(spark, docs=docs.unionByName(parts, allowMissingColumns=True), edges=items)
    brands = [r.b for r in rel.read(spark, sf, "part").agg(F.min("p_brand").alias("b")).collect()]
    p = {"requires": ["PART"], "requires-any": ["PART", "SUPP"], "statuses": ["F"], "admissibility": brands}
    return _run("core.dep-shape", c, p).select("n", "subject")


def q_rule_successor(spark, sf):
    docs = _orders(spark, sf, status=F.when(_n() % 3 == 0, "superseded").otherwise("accepted"))
    return _run("core.successor-link", _corpus(spark, docs=docs, edges=_to(spark, sf, "superseded_by", _n() + 1, _n() % 2 == 0)))


def q_rule_reciprocal(spark, sf):
    status = F.when(_n() % 4 == 1, "accepted").when(_n() % 12 == 0, "draft").when(_n() % 4 == 0, "superseded").otherwise("draft")
    edges = _to(spark, sf, "supersedes", _n() - 1, _n() % 4 == 1).unionByName(_to(spark, sf, "superseded_by", _n() + 1, _n() % 8 == 0))
    return _run("core.supersedes-reciprocal", _corpus(spark, docs=_orders(spark, sf, status=status), edges=edges))


def q_rule_links(spark, sf):
    """Links of pages to addresses that no page has, but for those that a pattern allows."""
    page = F.concat(F.lit("PAGE-"), F.col("page_id").cast("string"))
    href = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    links = rel.read(spark, sf, "pages").select(page.alias("doc_key"), F.lit("link").alias("kind"), href.alias("target")).withColumn("path", F.col("target"))
    c = rel.corpus(spark, sf, {"PAGE": None}, [])
    c.tables |= {"links": shaped(links, TABLES["links"]), "files": rel.read(spark, sf, "pages").select(F.col("url").alias("path"))}
    return _run("core.link-resolved", c, {"allow": _ALLOWED}, "PAGE").select("n", "subject")


_ALLOWED = ["*7*", "#*"]


def q_rule_requires_link(spark, sf):
    links = _inside(spark, sf, _n() % 2 == 0, kind=F.lit("link"), target=F.lit("README.md"), path=F.lit("README.md")).unionByName(
        _inside(spark, sf, _n() % 3 == 0, kind=F.lit("import"), target=F.lit("STYLE.md"), path=F.lit("STYLE.md")))
    c = _corpus(spark, docs=_orders(spark, sf), links=links, files=_paths(spark, "README.md", "STYLE.md"))
    return _run("core.requires-link", c, {"targets": ["README.md", "STYLE.md", "GONE.md"]})


def q_rule_file_referenced(spark, sf):
    links = _inside(spark, sf, _n() % 2 == 0, kind=F.lit("link"), target=F.lit("SOUL.md"), path=F.lit("SOUL.md"))
    c = _corpus(spark, docs=_orders(spark, sf), links=links, files=_paths(spark, "SOUL.md"))
    soul, style = _run("soul.referenced", c, {"target": "SOUL.md"}), _run("style.referenced", c, {"target": "STYLE.md"})
    return soul.unionByName(style)


def q_rule_pair(spark, sf):
    at = F.concat(F.lit("p/"), (_n() % 7).cast("string"), F.lit("/STYLE-"), _n().cast("string"), F.lit(".md"))
    c = _corpus(spark, docs=_orders(spark, sf, location=at), files=_paths(spark, "p/1/SOUL.md", "p/4/SOUL.md", "SOUL.md"))
    found = registry.RULES["style.soul-pair"].run(c, "ORD", {"sibling": "SOUL.md"})
    return found.groupBy("subject").agg(F.count("*").alias("n"))


def q_rule_requirement_ref(spark, sf):
    asked = F.concat(F.lit("REQ-"), (_n() % 8).cast("string"), F.lit(" and REQ-1.2, see NFR-X-3"))
    items = _inside(spark, sf, _n() % 2 == 0, section=F.when(_n() % 4 == 0, "satisfies").otherwise("notes"), text=asked, line=F.lit(6))
    known = spark.createDataFrame([(f"REQ-{k}",) for k in range(1, 6)] + [("REQ-1.2",)], "req_id string")
    return _run("core.requirement-ref", _corpus(spark, docs=_orders(spark, sf), list_items=items, requirements=known))


def q_rule_requirement_status(spark, sf):
    said = F.element_at(F.array(F.lit("Done"), F.lit("open"), F.lit("odd"), F.lit(None).cast("string")), (_n() % 4 + 1).cast("int"))
    reqs = _inside(spark, sf, req_id=F.concat(F.lit("REQ-"), _n().cast("string")), status=said, line=F.lit(5))
    return _run("core.requirement-status", _corpus(spark, docs=_orders(spark, sf), requirements=reqs), {"statuses": ["done", "Open"]})


def q_rule_files_allowed(spark, sf):
    path = F.concat(F.lit("`src/"), (_n() % 50).cast("string"), F.when(_n() % 4 == 0, "*.py`").otherwise(".py` and why"))
    items = _inside(spark, sf, section=F.lit("files allowed"), text=F.when(_n() % 9 == 0, F.lit("src/")).otherwise(path), line=F.lit(4))
    files = _paths(spark, *(f"src/{i}.py" for i in range(40)))
    return _run("tasks.files-allowed", _corpus(spark, docs=_orders(spark, sf), list_items=items, files=files))


def q_rule_requires_prd(spark, sf):
    prd = spark.createDataFrame([("PRD-1", "PRD", 1)], "doc_key string, ns string, number bigint")
    edges = _to(spark, sf, "depends_on", F.lit(1), _n() % 3 == 0).withColumn("dst_ns", F.lit("PRD"))
    docs = _orders(spark, sf).unionByName(prd, allowMissingColumns=True)
    return _run("spec.requires-prd", _corpus(spark, docs=docs, edges=edges)).select("n", "subject")


# --- domains -----------------------------------------------------------------


def q_rule_context_map(spark, sf):
    pattern = F.when(F.col("o_orderpriority") == "1-URGENT", "Conformist").when(F.col("o_orderpriority") == "2-HIGH", "Partnership").otherwise("Other")
    meta = _metadata(pattern=_text(pattern), upstream=F.when(_n() % 2 == 0, _text("a")), downstream=F.when(_n() % 3 == 0, _text("b")))
    supp = rel.corpus(spark, sf, {"SUPP": None}, []).docs
    edges = rel.read(spark, sf, "lineitem").select(
        F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string")).alias("src_key"), F.lit("ORD").alias("src_ns"), F.lit("depends_on").alias("kind"),
        F.lit("SUPP").alias("dst_ns"), F.col("l_suppkey").cast("long").alias("dst_number"))
    c = _corpus(spark, docs=shaped(_orders(spark, sf, metadata=meta), TABLES["docs"]).unionByName(supp), edges=edges)
    return _run("ddd.context-map-shape", c, {"context": "SUPP"}).select("n", "subject", "note")


def _dated(spark, sf, **more: Column):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return _orders(spark, sf, metadata=_metadata(severity=_text(F.col("o_orderpriority")), discovered=_text(day), expires=F.when(_n() % 4 != 0, _text(day)), **more))


def q_rule_vuln_sla(spark, sf):
    p = {"windows": {"1-URGENT": 7, "2-HIGH": 30}, "open": ["O"], "as_of": AS_OF}
    return _run("security.vuln-sla", _corpus(spark, docs=_dated(spark, sf)), p).select("n", F.col("subject").cast("long").alias("age"), "note")


def q_rule_risk_expiry(spark, sf):
    docs = _dated(spark, sf, approver=F.when(_n() % 2 == 0, _text("a")), rationale=_text(F.when(_n() % 3 == 0, " ").otherwise("why")))
    edges = _to(spark, sf, "depends_on", _n(), _n() % 5 == 0).withColumn("dst_ns", F.lit("VULN"))
    p = {"require-when-status": ["P"], "exempt-when-links": ["VULN"], "as_of": AS_OF}
    return _run("security.risk-expiry", _corpus(spark, docs=docs, edges=edges), p).select("n", "subject", "note")


def _mentions(spark, sf):
    """Orders that mention the next number, or themselves; not every number is an order."""
    return _inside(spark, sf, _n() % 3 != 2, ns=F.lit("ORD"), number=F.when(_n() % 3 == 0, _n() + 1).otherwise(_n()).cast("long"), line=F.lit(2))


def q_rule_remediation(spark, sf):
    c = _corpus(spark, docs=_orders(spark, sf), tokens=_mentions(spark, sf))
    return _run("security.remediation-link", c, {"statuses": ["F"]}).select("n", "subject")


def q_rule_evidence(spark, sf):
    meta = _metadata(evidence=F.when(_n() % 5 == 0, _text("file")), proof=_text(F.when(_n() % 7 == 0, "x").otherwise(" ")))
    c = _corpus(spark, docs=_orders(spark, sf, metadata=meta), tokens=_mentions(spark, sf))
    p = {"out-of-scope-status": ["O"], "evidence-fields": ["evidence", "proof"]}
    soc2, hipaa = _run("soc2.control-evidence", c, p), _run("hipaa.safeguard-evidence", c, {**p, "namespaces": ["CUST"]})
    both = soc2.withColumn("rule", F.lit("soc2")).unionByName(hipaa.withColumn("rule", F.lit("hipaa")))
    return both.select("rule", "n", "subject")


# --- the run, navigation, reports --------------------------------------------


def _sources(spark, sf):
    """Documents by their source as namespace; some sources are declared."""
    docs = rel.read(spark, sf, "documents").select(F.col("source").alias("ns"), F.col("doc_id").alias("number"), F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("location"))
    return _corpus(spark, [Namespace(f"src{i}") for i in range(10)], docs=docs)


def q_kernel_undeclared(spark, sf):
    return kernel.undeclared(_sources(spark, sf), ["src11"]).select("code", "path", "message", "note", "severity")


def q_kernel_unowned(spark, sf):
    docs = rel.read(spark, sf, "documents").select(F.col("lang").alias("ns"))
    declared = [Namespace("en", owner="a"), Namespace("de"), Namespace("fr", owner="b"), Namespace("it")]
    return kernel.unowned(_corpus(spark, declared, docs=docs), ["a"]).select("code", "message", "note")


def q_kernel_undescribed(spark, sf):
    rows = rel.read(spark, sf, "nation").select("n_name", "n_nationkey").collect()
    declared = [Namespace(r.n_name, summary=None if r.n_nationkey % 3 == 0 else "s" * (90 + r.n_nationkey)) for r in rows]
    return kernel.undescribed(_corpus(spark, declared)).select("code", "message", "severity")


def q_kernel_paths_skipped(spark, sf):
    declared = [Namespace("A", paths=["*/en/*"]), Namespace("B", paths=["*/de/*"]), Namespace("C", paths=["*.md"]), Namespace("D", paths=["*/fr/*"])]
    pages = rel.read(spark, sf, "pages").select(F.col("url").alias("path"))
    c = _corpus(spark, declared, docs=spark.createDataFrame([("D",)], "ns string"), files=pages.unionByName(_paths(spark, "x/y.md")))
    return kernel.paths_skipped(c).select("code", "message", "note")


def q_nav_lineage(spark, sf):
    c = rel.corpus(spark, sf, {"REG": None, "NAT": None, "CUST": None, "ORD": None}, [("NAT", "REG"), ("CUST", "NAT"), ("ORD", "CUST")])
    roots = c.docs.where("doc_key IN ('REG-0', 'REG-2', 'NAT-0')").select(F.col("doc_key").alias("node"))
    return nav.lineage(c, roots).select("root", "node", "depth", "shared_by")


def q_nav_lookups(spark, sf):
    c = rel.corpus(spark, sf, {"CUST": None, "NAT": None}, [])
    one = nav.definition(c, "CUST", 5).select(F.lit("definition").alias("what"), "id", F.lit(None).cast("string").alias("title"))
    two = nav.hover(c, "NAT", 3).select(F.lit("hover").alias("what"), "id", "title")
    three = nav.symbols(c, "CUST-12", prefix=True).select(F.lit("prefix").alias("what"), "id", "title")
    four = nav.symbols(c, "an").select(F.lit("part").alias("what"), "id", "title")
    return one.unionByName(two).unionByName(three).unionByName(four)


def q_nav_edges(spark, sf):
    return nav.edges(_customers(spark, sf)).select("from", "to", "kind", "resolved")


def q_nav_inventory(spark, sf):
    return nav.inventory(rel.corpus(spark, sf, {"ORD": None, "CUST": None}, [])).select("ns", "number", "id", "title", "status")


def _diagnosed(spark, sf):
    from .queries import summary_diagnostics

    return summary_diagnostics(spark, sf)


def q_report_summary(spark, sf):
    totals = report.summary(_diagnosed(spark, sf), undeclared=3)
    return spark.createDataFrame([tuple(totals.values())], ", ".join(f"{k} bigint" for k in totals))


_SUPP = "SELECT l_orderkey, count(DISTINCT l_suppkey) AS k FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey"
_CUST = "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'O' WHEN c_acctbal < 1000 THEN 'P' WHEN c_acctbal < 9000 THEN 'F' END AS st FROM customer"
_O = "WITH o AS (SELECT *, o_orderkey AS n, 'ORD-' || o_orderkey AS id FROM orders)"
_NONE = "NULL::VARCHAR AS note"

SQL: dict[str, str] = {
    "q_rule_frontmatter": f"{_O} SELECT n, 'line ' || (n % 5) AS subject, {_NONE}, 1::BIGINT AS line FROM o WHERE n % 11 = 0",
    "q_rule_id": f"{_O} SELECT n, CASE WHEN n % 7 = 0 THEN '(none)' ELSE id END AS subject, {_NONE}, 0::BIGINT AS line FROM o WHERE n % 11 <> 0 AND (n % 7 = 0 OR n % 5 = 0)",
    "q_rule_file_name": f"""{_O} SELECT n, id AS subject, CASE WHEN n % 2 = 0 THEN 'ORD-' ELSE '' END || (n + 1) || '-x.md' AS note, 0::BIGINT AS line FROM o WHERE n % 9 = 0""",
    "q_rule_metadata_format": """
        SELECT event_id AS n, 'day' AS subject, '2024-02-30' AS note FROM events WHERE event_id % 7 = 0
        UNION ALL SELECT event_id, 'at', strftime(ts, '%Y-%m-%dT%H:%M:%S') FROM events WHERE event_id % 5 = 0 AND ts IS NOT NULL""",
    "q_rule_min_docs": "SELECT ns AS subject FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('GARDEN'), ('TOYS')) v(ns) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = ns)",
    "q_rule_id_unique": """
        SELECT id AS path, id AS subject, n || ' documents' AS note FROM (
          SELECT 'ITEM-' || l_orderkey || '.' || l_linenumber AS id, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1""",
    "q_rule_headings_code": f"""{_O} SELECT n, 'Rollback' AS subject, {_NONE}, 0::BIGINT AS line FROM o WHERE o_orderstatus IN ('F', 'P') AND n % 3 = 0
        UNION ALL SELECT n, 'Rollback', 'no command', 6 FROM o WHERE o_orderstatus IN ('F', 'P') AND n % 3 <> 0 AND n % 2 <> 0""",
    "q_rule_section_order": f"""{_O},
        h AS (SELECT n, 'Color' AS t, 1 AS r, 10 AS line FROM o UNION ALL SELECT n, 'Type', 2, CASE WHEN n % 4 = 0 THEN 7 ELSE 20 END FROM o
              UNION ALL SELECT n, 'Color', 1, 30 FROM o WHERE n % 3 = 0 UNION ALL SELECT n, 'Space', 3, 5 FROM o WHERE n % 5 <> 0),
        w AS (SELECT *, max(r) OVER (PARTITION BY n ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY n, t ORDER BY line) AS nth FROM h)
        SELECT n, t AS subject, CASE WHEN nth > 1 THEN 'repeated' ELSE 'out of order' END AS note, line::BIGINT AS line FROM w WHERE nth > 1 OR b > r""",
    "q_rule_soul_sections": f"""{_O} SELECT n, 'title' AS subject, {_NONE}, 0::BIGINT AS line FROM o WHERE n % 4 = 0
        UNION ALL SELECT n, 'Values', NULL, 0 FROM o UNION ALL SELECT n, 'Voice', NULL, 0 FROM o WHERE n % 3 = 0
        UNION ALL SELECT n, 'Voice', 'at another level', 8 FROM o WHERE n % 3 <> 0 AND n % 2 <> 0""",
    "q_rule_clause_syntax": f"""{_O} SELECT n, 'EARS-2' AS subject, 'no shall' AS note, 9::BIGINT AS line FROM o WHERE n % 6 = 1
        UNION ALL SELECT n, 'EARS-3', 'no subject', 9 FROM o WHERE n % 6 = 2""",
    "q_rule_checklist_complete": f"""{_O} SELECT n, ((n % 3 <> 0)::INT + (n % 5 <> 0)::INT)::VARCHAR AS subject, {_NONE}, CASE WHEN n % 3 <> 0 THEN 3 ELSE 5 END::BIGINT AS line
        FROM o WHERE n % 2 = 0 AND NOT (n % 3 = 0 AND n % 5 = 0)""",
    "q_rule_checklist_pinned": f"""{_O} SELECT n, CASE n % 3 WHEN 0 THEN repeat('ab', 20) WHEN 1 THEN 'main' ELSE '' END AS subject,
        CASE n % 3 WHEN 0 THEN 'history is not complete here' ELSE 'no commit' END AS note, 3::BIGINT AS line FROM o WHERE n % 2 = 0""",
    "q_rule_todo_structure": f"""{_O} SELECT n, 'TODO checklist' AS subject, {_NONE}, 0::BIGINT AS line FROM o WHERE NOT (n % 2 = 0 AND n % 3 <> 0)
        UNION ALL SELECT n, 'Context', NULL, 0 FROM o WHERE n % 5 = 0""",
    "q_rule_todo_sections": f"""{_O} SELECT n, 'Now' AS subject, {_NONE}, 0::BIGINT AS line FROM o WHERE n % 3 = 0
        UNION ALL SELECT n, 'Now', 'out of order', 9 FROM o WHERE n % 3 <> 0 AND n % 2 = 0""",
    "q_rule_todo_freshness": f"""{_O} SELECT n, CASE WHEN n % 9 = 0 THEN 'no date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS subject, {_NONE}, 0::BIGINT AS line
        FROM o WHERE n % 9 = 0 OR o_orderdate::DATE + 100 < DATE '{AS_OF}'""",
    "q_rule_todo_listed": f"{_O} SELECT n, id AS subject, {_NONE}, 0::BIGINT AS line FROM o WHERE n % 3 <> 0 AND o_orderstatus <> 'F'",
    "q_rule_context_budget": rf"""
        SELECT doc_id AS n, w::VARCHAR AS subject, 'limit 1000' AS note, 0::BIGINT AS line
        FROM (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM documents) WHERE w > 1000
        UNION ALL SELECT doc_id, '@x.md', 'dangling import', 2 FROM documents WHERE doc_id % 50 = 0 AND doc_id % 100 <> 0""",
    "q_rule_context_headings": f"""{_O} SELECT n, 'Current State' AS subject, {_NONE}, 7::BIGINT AS line FROM o WHERE n % 5 = 0
        UNION ALL SELECT n, 'TODO.md', 'not linked', 0 FROM o WHERE n % 2 <> 0
        UNION ALL SELECT n, 'TODO.md', 'imported', 3 FROM o WHERE n % 6 = 0""",
    "q_rule_banned_prose": """
        SELECT doc_id AS n, term AS subject FROM documents JOIN (VALUES ('under'), ('und'), ('avec')) v(term)
        ON regexp_matches(text, '(?i)(^|[^A-Za-z0-9])' || term || '([^A-Za-z0-9]|$)')""",
    "q_rule_skills": f"""{_O} SELECT n, 'name' AS subject, {_NONE}, 0::BIGINT AS line FROM o WHERE n % 3 = 0 OR n % 2 = 0
        UNION ALL SELECT n, 'description', NULL, 0 FROM o WHERE n % 5 = 0""",
    "q_rule_agent_frontmatter": f"""{_O}, a AS (SELECT *, 'agents/' || id || '.md' AS path FROM o)
        SELECT path, 'other' AS subject, id AS note, 'warning' AS severity FROM a WHERE n % 2 <> 0
        UNION ALL SELECT path, CASE n % 3 WHEN 0 THEN '10' ELSE '2000' END, NULL, 'warning' FROM a WHERE n % 3 <> 1
        UNION ALL SELECT path, 'fast', NULL, 'warning' FROM a WHERE n % 5 = 0""",
    "q_rule_plain_agent": f"""{_O}, a AS (SELECT *, 'agents/' || id || '.md' AS path FROM o)
        SELECT path, CASE n % 3 WHEN 0 THEN '10' ELSE '2000' END AS subject, 'warning' AS severity FROM a WHERE n % 3 <> 1
        UNION ALL SELECT path, 'large', 'warning' FROM a WHERE n % 5 <> 0""",
    "q_rule_agent_assigned": """
        WITH k AS (SELECT unnest(['STANDARD', 'PROMO STEEL', 'ECONOMY TIN', 'SMALL BRASS', 'LARGE COPPER']) AS known)
        SELECT n, name AS subject, 'nearest: ' || known AS note FROM (
          SELECT p_partkey AS n, p_type AS name, known, row_number() OVER (PARTITION BY p_partkey ORDER BY levenshtein(p_type, known), known) AS r FROM part, k
          WHERE p_type NOT IN (SELECT known FROM k)) WHERE r = 1""",
    "q_rule_guide": f"""{_O} SELECT n, 'title' AS subject, {_NONE}, 0::BIGINT AS line FROM o WHERE n % 2 <> 0
        UNION ALL SELECT n, 'diataxis.type', CASE n % 3 WHEN 1 THEN 'poem' END, 0 FROM o WHERE n % 3 <> 0""",
    "q_rule_c4": f"{_O} SELECT n, 'c4.level' AS subject, (n % 6)::VARCHAR AS note, 0::BIGINT AS line FROM o WHERE n % 6 IN (0, 5)",
    "q_rule_token_ref": f"""{_O} SELECT n, 'space.gap' AS subject, {_NONE}, 0::BIGINT AS line FROM o
        UNION ALL SELECT n, 'color.scale.x1', NULL, 0 FROM o WHERE n % 2 <> 0""",
    "q_rule_dep_status": f"""SELECT o_orderkey AS n, 'CUST-' || o_custkey AS subject, st AS note FROM orders JOIN ({_CUST}) ON c_custkey = o_custkey
        WHERE o_orderstatus = 'F' AND st IN ('O', 'P')""",
    "q_rule_dep_satisfied": f"""
        SELECT st AS note, NULL::VARCHAR AS severity, count(*) AS n FROM orders JOIN ({_CUST}) ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND st = 'O' GROUP BY ALL
        UNION ALL SELECT * FROM (SELECT 'belongs in part_of', 'warning', count(*) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n > 0""",
    "q_rule_dep_cycle": f"""{_O}, r AS (SELECT n FROM o WHERE n % 10 < 3 AND n - n % 10 IN (SELECT n FROM o) AND n - n % 10 + 1 IN (SELECT n FROM o) AND n - n % 10 + 2 IN (SELECT n FROM o))
        SELECT n, 'ORD-' || n AS subject, least('ORD-' || (n - n % 10), 'ORD-' || (n - n % 10 + 1), 'ORD-' || (n - n % 10 + 2)) AS note, 4::BIGINT AS line FROM r""",
    "q_rule_dep_shape": f"""{_O}, bad AS (SELECT n FROM o WHERE o_orderstatus = 'F' AND NOT EXISTS (
          SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = n AND p_brand = (SELECT min(p_brand) FROM part)))
        SELECT n, 'PART' AS subject FROM bad UNION ALL SELECT n, 'PART or SUPP' FROM bad""",
    "q_rule_successor": f"""{_O} SELECT n, 'superseded_by' AS subject, {_NONE}, 0::BIGINT AS line FROM o
        WHERE n % 3 = 0 AND NOT (n % 2 = 0 AND n + 1 IN (SELECT n FROM o))""",
    "q_rule_reciprocal": f"""{_O} SELECT n, 'ORD-' || (n - 1) AS subject, CASE WHEN (n - 1) % 8 <> 0 THEN 'no link back' ELSE 'draft' END AS note, 4::BIGINT AS line FROM o
        WHERE n % 4 = 1 AND n - 1 IN (SELECT n FROM o) AND ((n - 1) % 8 <> 0 OR (n - 1) % 12 = 0)""",
    "q_rule_links": f"""
        WITH h AS (SELECT page_id AS n, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS subject FROM pages)
        SELECT n, subject FROM h WHERE subject NOT IN (SELECT url FROM pages WHERE url IS NOT NULL) AND NOT regexp_matches(subject, '{globs.any_of(_ALLOWED)}')""",
    "q_rule_requires_link": f"""{_O} SELECT n, 'README.md' AS subject, {_NONE}, 0::BIGINT AS line FROM o WHERE n % 2 <> 0
        UNION ALL SELECT n, 'STYLE.md', NULL, 0 FROM o WHERE n % 3 <> 0""",
    "q_rule_file_referenced": f"{_O} SELECT n, 'SOUL.md' AS subject, {_NONE}, 0::BIGINT AS line FROM o WHERE n % 2 <> 0",
    "q_rule_pair": f"{_O} SELECT 'p/' || (n % 7) || '/SOUL.md' AS subject, count(*) AS n FROM o WHERE n % 7 NOT IN (1, 4) GROUP BY n % 7",
    "q_rule_requirement_ref": f"""{_O} SELECT n, 'REQ-' || (n % 8) AS subject, {_NONE}, 6::BIGINT AS line FROM o WHERE n % 4 = 0 AND n % 8 NOT IN (1, 2, 3, 4, 5)
        UNION ALL SELECT n, 'NFR-X-3', NULL, 6 FROM o WHERE n % 4 = 0""",
    "q_rule_requirement_status": f"""{_O} SELECT n, 'REQ-' || n AS subject, CASE n % 4 WHEN 2 THEN 'odd' END AS note, 5::BIGINT AS line FROM o WHERE n % 4 IN (2, 3)""",
    "q_rule_files_allowed": f"""{_O} SELECT n, 'src/' || (n % 50) || '.py' AS subject, {_NONE}, 4::BIGINT AS line FROM o WHERE n % 9 <> 0 AND n % 4 <> 0 AND n % 50 >= 40""",
    "q_rule_requires_prd": f"{_O} SELECT n, 'PRD' AS subject FROM o WHERE n % 3 <> 0",
    "q_rule_context_map": f"""
        WITH o AS (SELECT o_orderkey AS n, coalesce(k, 0) AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 's' ELSE '' END AS p
                   FROM orders LEFT JOIN ({_SUPP}) ON l_orderkey = o_orderkey)
        SELECT n, k::VARCHAR AS subject, 'two contexts are needed' AS note FROM o WHERE k <> 2
        UNION ALL SELECT n, 'upstream', 'needed' FROM o WHERE p = 'a' AND n % 2 <> 0 UNION ALL SELECT n, 'downstream', 'needed' FROM o WHERE p = 'a' AND n % 3 <> 0
        UNION ALL SELECT n, 'upstream', 'not for this pattern' FROM o WHERE p = 's' AND n % 2 = 0 UNION ALL SELECT n, 'downstream', 'not for this pattern' FROM o WHERE p = 's' AND n % 3 = 0""",
    "q_rule_vuln_sla": f"""
        SELECT o_orderkey AS n, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') AS age, p AS note FROM orders JOIN (VALUES ('1-URGENT', 7), ('2-HIGH', 30)) w(p, days) ON o_orderpriority = p
        WHERE o_orderstatus = 'O' AND date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') > days""",
    "q_rule_risk_expiry": f"""{_O}, r AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM o WHERE o_orderstatus = 'P' AND n % 5 <> 0)
        SELECT n, 'approver' AS subject, {_NONE} FROM r WHERE n % 2 <> 0 UNION ALL SELECT n, 'rationale', NULL FROM r WHERE n % 3 = 0
        UNION ALL SELECT n, 'expires', NULL FROM r WHERE n % 4 = 0 UNION ALL SELECT n, 'expires', day FROM r WHERE n % 4 <> 0 AND o_orderdate::DATE <= DATE '{AS_OF}'""",
    "q_rule_remediation": f"{_O} SELECT n, id AS subject FROM o WHERE o_orderstatus = 'F' AND NOT (n % 3 = 0 AND n + 1 IN (SELECT n FROM o))",
    "q_rule_evidence": f"""{_O}, c AS (SELECT * FROM o WHERE o_orderstatus <> 'O' AND n % 5 <> 0 AND n % 7 <> 0)
        SELECT 'soc2' AS rule, n, id AS subject FROM c WHERE NOT (n % 3 = 0 AND n + 1 IN (SELECT n FROM o)) UNION ALL SELECT 'hipaa', n, id FROM c""",
    "q_kernel_undeclared": """
        SELECT 'cfg.namespace-undeclared' AS code, 'DOC-' || min(doc_id) AS path, 'namespace ' || source || ' is not declared' AS message, count(*) || ' documents' AS note, 'warning' AS severity
        FROM documents WHERE source NOT IN (SELECT 'src' || i FROM range(10) t(i)) AND source <> 'src11' GROUP BY source""",
    "q_kernel_unowned": """
        SELECT 'cfg.namespace-unowned' AS code, 'namespace ' || ns || ' has no known owner' AS message, owner AS note FROM (VALUES ('en', 'a'), ('de', NULL), ('fr', 'b'), ('it', NULL)) v(ns, owner)
        WHERE (owner IS NULL OR owner <> 'a') AND ns IN (SELECT lang FROM documents)""",
    "q_kernel_undescribed": "SELECT 'cfg.namespace-undescribed' AS code, n_name AS message, 'error' AS severity FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey > 10",
    "q_kernel_paths_skipped": f"""
        SELECT 'cfg.paths-skipped' AS code, 'the patterns of ' || ns || ' match no markdown' AS message, count(*) || ' files' AS note
        FROM pages JOIN (VALUES ('A', '{globs.any_of(["*/en/*"])}'), ('B', '{globs.any_of(["*/de/*"])}')) v(ns, rx) ON regexp_matches(url, rx) GROUP BY ns HAVING NOT bool_or(url LIKE '%.md')""",
    "q_nav_lineage": """
        WITH RECURSIVE e AS (
          SELECT 'REG-' || n_regionkey AS src, 'NAT-' || n_nationkey AS dst FROM nation
          UNION ALL SELECT 'NAT-' || c_nationkey, 'CUST-' || c_custkey FROM customer
          UNION ALL SELECT 'CUST-' || o_custkey, 'ORD-' || o_orderkey FROM orders),
        r AS (SELECT x AS root, x AS node, 0::BIGINT AS depth FROM (SELECT 'REG-' || r_regionkey AS x FROM region WHERE r_regionkey IN (0, 2) UNION ALL SELECT 'NAT-0' FROM nation WHERE n_nationkey = 0)
              UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node),
        d AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node)
        SELECT root, node, depth, count(*) OVER (PARTITION BY node) AS shared_by FROM d""",
    "q_nav_lookups": """
        SELECT 'definition' AS what, 'CUST-' || c_custkey AS id, NULL::VARCHAR AS title FROM customer WHERE c_custkey = 5
        UNION ALL SELECT 'hover', 'NAT-' || n_nationkey, n_name FROM nation WHERE n_nationkey = 3
        UNION ALL SELECT 'prefix', 'CUST-' || c_custkey, c_name FROM customer WHERE starts_with('CUST-' || c_custkey, 'CUST-12')
        UNION ALL SELECT 'part', 'CUST-' || c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'an') OR contains('CUST-' || c_custkey, 'an')
        UNION ALL SELECT 'part', 'NAT-' || n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'an')""",
    "q_nav_edges": """
        SELECT 'ORD-' || o_orderkey AS "from", 'CUST-' || o_custkey AS "to", 'depends_on' AS kind, o_custkey IN (SELECT c_custkey FROM customer) AS resolved FROM orders""",
    "q_nav_inventory": """
        SELECT 'ORD' AS ns, o_orderkey AS number, 'ORD-' || o_orderkey AS id, NULL::VARCHAR AS title, o_orderstatus AS status FROM orders
        UNION ALL SELECT 'CUST', c_custkey, 'CUST-' || c_custkey, c_name, NULL FROM customer""",
    "q_report_summary": """
        WITH d AS (
          SELECT 'error' AS s, 'ORD-' || o_orderkey AS p FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)
          UNION ALL SELECT 'error', 'ORD-' || o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
          UNION ALL SELECT 'warning', 'DOC-' || doc_id FROM documents WHERE length(text) > 20000
          UNION ALL SELECT 'warning', 'PAGE-' || page_id FROM pages WHERE html IS NULL OR NOT contains(html, '</html>')
          UNION ALL SELECT 'info', 'DOC-' || doc_id FROM documents)
        SELECT count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'warning') AS warnings, count(*) FILTER (s = 'info') AS infos, count(DISTINCT p) AS files, 3::BIGINT AS namespaces_undeclared FROM d""",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
