"""Rules that come with packs: same form as the core rules, about particular kinds of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import Corpus, findings, key_line, meta
from . import navigation as nav
from .core import _resolves, _subjects, _values, requires_link


def _today(p: dict):
    return F.to_date(F.lit(p["as_of"])) if p.get("as_of") else F.current_date()


#: The six clause forms of the requirements syntax.
CLAUSES = (
    r"(?i)^the .+ shall .+$",
    r"(?i)^when .+,? the .+ shall .+$",
    r"(?i)^while .+,? the .+ shall .+$",
    r"(?i)^where .+,? the .+ shall .+$",
    r"(?i)^if .+,? then the .+ shall .+$",
    r"(?i)^while .+,? when .+,? the .+ shall .+$",
)


def clause_syntax(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Items with an EARS id under Requirements follow one of six clause forms."""
    items = c.list_items.where(F.col("section") == tx.norm_heading(p.get("heading", "Requirements")))
    rx = r"^\**(EARS-[0-9]+(?:\.[0-9]+)?)\**[:.]?\**\s+(.*)$"
    items = items.withColumns({"req": F.regexp_extract("text", rx, 1), "clause": F.regexp_extract("text", rx, 2)}).where("req <> ''")
    defect = F.when(~F.lower("clause").contains(" shall "), "no shall").when(~F.lower("clause").rlike(r"(^|[ ,])the "), "no subject")
    for form in CLAUSES:
        defect = F.when(F.col("clause").rlike(form), F.lit(None).cast("string")).otherwise(defect)
    fits = F.lit(False)
    for form in CLAUSES:
        fits = fits | F.col("clause").rlike(form)
    bad = items.where(~fits).withColumn("defect", F.coalesce(defect, F.lit("no known form")))
    return findings(bad.join(_subjects(c, ns), "doc_key"), F.col("req"), line=F.col("line"), note=F.col("defect"))


def todo_freshness(c: Corpus, ns: str, p: dict) -> DataFrame:
    date = tx.date_of(F.regexp_extract("body", r"(?m)^\W*Last updated:\W*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))
    df = c.of(ns).withColumn("at", date)
    late = F.date_add("at", p.get("stale_days", 30)) < _today(p)
    return findings(df.where(F.col("at").isNull() | late), F.coalesce(F.col("at").cast("string"), F.lit("no date")))


def todo_structure(c: Corpus, ns: str, p: dict) -> DataFrame:
    docs = _subjects(c, ns)
    three = c.headings.where("level = 3")
    lists = three.where("norm = 'todo'").join(c.checkboxes.where("section = 'todo'").select("doc_key"), "doc_key", "left_semi").select("doc_key")
    out = findings(docs.join(lists, "doc_key", "left_anti"), F.lit("TODO checklist"), severity="error")
    context = three.where("norm = 'context'").select("doc_key")
    return out.unionByName(findings(docs.join(context, "doc_key", "left_anti"), F.lit("Context"), severity="warning"))


def section_order(c: Corpus, ns: str, p: dict) -> DataFrame:
    """H2 sections stand in the configured order, each once; others may stand anywhere."""
    order = [tx.norm_heading(h) for h in p["sections"]]
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("norm"))
    known = c.headings.where("level = 2").withColumn("rank", rank).where("rank > 0").join(_subjects(c, ns), "doc_key")
    by_doc = Window.partitionBy("doc_key").orderBy("line")
    before = F.max("rank").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    nth = F.row_number().over(Window.partitionBy("doc_key", "norm").orderBy("line"))
    df = known.withColumns({"before": before, "nth": nth})
    note = F.when(F.col("nth") > 1, "repeated").otherwise("out of order")
    return findings(df.where("nth > 1 OR before > rank"), F.col("text"), line=F.col("line"), note=note, severity=p.get("severity"))


def todo_sections(c: Corpus, ns: str, p: dict) -> DataFrame:
    names = p.get("sections", ["Now", "Next", "Later", "Done"])
    have = c.headings.where("level = 2").select("doc_key", "norm").distinct()
    wanted = _values(c.spark, "heading", names).withColumn("norm", tx.norm_heading_col(F.col("heading")))
    missing = _subjects(c, ns).crossJoin(F.broadcast(wanted)).join(have, ["doc_key", "norm"], "left_anti")
    return findings(missing, F.col("heading")).unionByName(section_order(c, ns, {"sections": names}))


def todo_listed(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Open documents are mentioned in the to-do file."""
    listed = c.tokens.where(F.col("doc_key") == p.get("file", "TODO.md")).select("ns", "number").distinct()
    docs = c.of(ns).where("number IS NOT NULL AND status IS NOT NULL").where(~F.col("status").isin(p["terminal"]))
    return findings(docs.join(listed, ["ns", "number"], "left_anti"), F.col("id"))


def context_headings(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Instruction files hold no state sections, and link to the root to-do file instead of importing it."""
    docs, target = _subjects(c, ns), p.get("target", "TODO.md")
    bad = [tx.norm_heading(h) for h in p.get("forbidden", ["Current State", "TODO"])]
    out = findings(c.headings.where(F.col("norm").isin(bad)).join(docs, "doc_key"), F.col("text"), line=F.col("line"))
    exists = c.files.where(F.col("path") == target).limit(1)
    to = c.links.where(F.col("path") == target).groupBy("doc_key").agg(F.bool_or(F.col("kind") != "import").alias("linked"), F.min("line").alias("line"))
    df = docs.crossJoin(F.broadcast(exists.select("path"))).join(to, "doc_key", "left").where("linked IS NULL OR NOT linked")
    imported = F.col("linked").isNotNull()
    return out.unionByName(findings(df, F.lit(target), line=F.col("line"), note=F.when(imported, "imported").otherwise("not linked"), severity=F.when(imported, "warning").otherwise("error")))


def context_budget(c: Corpus, ns: str, p: dict) -> DataFrame:
    docs, most = c.of(ns), p.get("max_words", 2000)
    words = tx.word_count(F.col("body"))
    out = findings(docs.where(words > most), words, note=f"limit {most}")
    imports = c.links.where("kind = 'import'").withColumnRenamed("path", "to")
    lost = imports.join(c.files.select(F.col("path").alias("to")), "to", "left_anti").join(_subjects(c, ns), "doc_key")
    return out.unionByName(findings(lost, F.col("target"), line=F.col("line"), note="dangling import"))


def context_cache(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Commits that touched a context file closer together than churn_min_hours."""
    docs = _subjects(c, ns)
    if c.git is None:
        return findings(docs.limit(0), F.lit(""))
    log = c.git.churn(c.spark).join(docs.select(F.col("location").alias("path")), "path", "left_semi")
    gap = (F.col("ts") - F.lag("ts").over(Window.partitionBy("path").orderBy("ts"))) / 3600
    hot = log.withColumn("gap", gap).where(F.col("gap") < p.get("churn_min_hours", 24)).groupBy("path").agg(F.count("*").alias("n"))
    return findings(hot.withColumnRenamed("path", "location"), F.col("n"), severity="warning")


def banned_prose(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Configured terms occur as whole words, in either case."""
    literal = lambda t: "".join(x if x.isalnum() else "\\" + x for x in t)
    terms = c.spark.createDataFrame([(t, f"(?i)(?<![A-Za-z0-9]){literal(t)}(?![A-Za-z0-9])") for t in p["terms"]], "term string, rx string")
    df = c.of(ns).select("location", "body").join(F.broadcast(terms), F.expr("body RLIKE rx"))
    return findings(df, F.col("term"))


def _non_empty(c: Corpus, ns: str, keys: list[str]) -> DataFrame:
    df = c.of(ns).select("location", "metadata", "key_lines", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    value = F.get_json_object(F.col("metadata")[F.col("key")], "$")
    return findings(df.where(F.coalesce(F.trim(value), F.lit("")) == ""), F.col("key"), line=F.col("key_lines")[F.col("key")])


def skills_frontmatter(c: Corpus, ns: str, p: dict) -> DataFrame:
    return _non_empty(c, ns, ["name", "description"])


def _agent(c: Corpus, ns: str, p: dict, names: bool) -> DataFrame:
    out = _non_empty(c, ns, ["name", "description"] if names else ["description"])
    docs = c.of(ns).withColumns({"name": meta("name"), "description": meta("description"), "model": meta("model")})
    if names:
        stem = F.regexp_replace(F.element_at(F.split("location", "/"), -1), r"\.md$", "")
        out = out.unionByName(findings(docs.where(F.col("name") != stem), F.col("name"), line=key_line("name"), note=stem, severity="warning"))
    n = F.char_length("description")
    band = docs.where((n < p.get("desc_min_chars", 40)) | (n > p.get("desc_max_chars", 1024)))
    out = out.unionByName(findings(band, n, line=key_line("description"), severity="warning"))
    if p.get("models"):
        odd = docs.where(F.col("model").isNotNull() & ~F.col("model").isin(p["models"]))
        out = out.unionByName(findings(odd, F.col("model"), line=key_line("model"), severity="warning"))
    return out


def agent_frontmatter(c: Corpus, ns: str, p: dict) -> DataFrame:
    return _agent(c, ns, p, True)


def plain_agent_frontmatter(c: Corpus, ns: str, p: dict) -> DataFrame:
    return _agent(c, ns, p, False)


def agent_assigned(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Agents that a document names are files or built in; the nearest known name is suggested."""
    dirs = p.get("search_dirs", ["agents"])
    under = F.lit(False)
    for d in dirs:
        under = under | F.col("path").startswith(d.rstrip("/") + "/")
    stems = c.files.where(under & F.col("path").endswith(".md")).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "").alias("known"))
    if p.get("name_source") == "frontmatter":
        stems = c.docs.where(F.expr(" OR ".join(f"startswith(location, '{d.rstrip('/')}/')" for d in dirs))).select(meta("name").alias("known")).where("known IS NOT NULL")
    known = stems.unionByName(_values(c.spark, "known", p.get("builtin_agents", []))).distinct()
    raw = F.col("metadata")[p.get("field", "agents")]
    named = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(F.get_json_object(raw, "$")))
    asked = c.of(ns).select("location", "key_lines", F.explode(named).alias("name"))
    lost = asked.join(known.select(F.col("known").alias("name")), "name", "left_anti")
    near = nav.nearest(lost.select("name").distinct(), known.select(F.col("known").alias("known_name")))
    df = lost.join(near, "name", "left")
    return findings(df, F.col("name"), line=key_line(p.get("field", "agents")), note=F.concat(F.lit("nearest: "), F.col("nearest")))


def files_allowed(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Paths listed under Files allowed exist; patterns are left alone."""
    items = c.list_items.where(F.col("section") == tx.norm_heading(p.get("heading", "Files allowed")))
    path = F.regexp_replace(F.regexp_extract("text", r"^`?([^`\s]+)`?", 1), r"/$", "")
    items = items.withColumn("path", path).where(F.col("path").contains("/") | F.col("path").contains(".")).where(~F.col("path").rlike(r"[*?\[]"))
    lost = items.join(c.files.select("path"), "path", "left_anti")
    folders = c.files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("path")).distinct()
    return findings(lost.join(folders, "path", "left_anti").join(_subjects(c, ns), "doc_key"), F.col("path"), line=F.col("line"), severity=p.get("severity"))


def _typed(c: Corpus, ns: str, key: str, allowed: list[str]) -> DataFrame:
    docs = c.of(ns).withColumns({"heading": F.coalesce(F.trim(meta("title")), F.lit("")), "value": meta(key)})
    out = findings(docs.where("heading = ''"), F.lit("title"), line=key_line("title"))
    return out.unionByName(findings(docs.where(F.col("value").isNull() | ~F.col("value").isin(allowed)), F.lit(key), line=key_line(key), note=F.col("value")))


def guide_frontmatter(c: Corpus, ns: str, p: dict) -> DataFrame:
    return _typed(c, ns, "diataxis.type", p["types"])


def c4_frontmatter(c: Corpus, ns: str, p: dict) -> DataFrame:
    return _typed(c, ns, "c4.level", p["levels"])


def checklist_complete(c: Corpus, ns: str, p: dict) -> DataFrame:
    sealed = _subjects(c, ns, "status").where("status = 'sealed'")
    left = c.checkboxes.where("NOT checked").groupBy("doc_key").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    return findings(sealed.join(left, "doc_key"), F.col("n"), line=F.col("line"))


def checklist_pinned(c: Corpus, ns: str, p: dict) -> DataFrame:
    """A sealed checklist names a 40-digit commit that is an ancestor of HEAD."""
    sealed = c.of(ns).where("status = 'sealed'").withColumn("commit", F.coalesce(meta("pinned_commit"), F.lit("")))
    form = F.col("commit").rlike("^[0-9a-f]{40}$")
    out = findings(sealed.where(~form), F.col("commit"), line=key_line("pinned_commit"), note="no commit")
    good = sealed.where(form)
    if c.git is None or c.git.shallow():
        return out.unionByName(findings(good, F.col("commit"), line=key_line("pinned_commit"), note="history is not complete here", severity="warning"))
    facts, _ = c.git.facts(c.spark, [r.commit for r in good.select("commit").distinct().collect()])
    bad = good.join(facts, "commit").where("NOT resolves OR NOT ancestor")
    return out.unionByName(findings(bad, F.col("commit"), line=key_line("pinned_commit"), note=F.when(F.col("resolves"), "not an ancestor of HEAD").otherwise("does not resolve")))


#: Relationship patterns between contexts, by whether they have a direction.
ASYMMETRIC = ("Customer-Supplier", "Conformist", "Anticorruption Layer", "Open Host Service", "Published Language")
SYMMETRIC = ("Partnership", "Shared Kernel", "Separate Ways")


def context_map_shape(c: Corpus, ns: str, p: dict) -> DataFrame:
    """A context map joins two contexts, with a direction exactly where its pattern has one."""
    to = c.edges.where((F.col("src_ns") == ns) & (F.col("kind") == "depends_on") & (F.col("dst_ns") == p.get("context", "BOUNDEDCONTEXT")))
    to = _resolves(to, c.docs, "dst_ns", "dst_number", "left_semi").groupBy("src_key").agg(F.count_distinct("dst_number").alias("n"))
    df = c.of(ns).join(to, F.col("doc_key") == F.col("src_key"), "left")
    out = findings(df.where("coalesce(n, 0) <> 2"), F.coalesce("n", F.lit(0)), line=key_line("depends_on"), note="two contexts are needed")
    for key in ("upstream", "downstream"):
        has = F.coalesce(F.map_contains_key("metadata", F.lit(key)), F.lit(False))
        out = out.unionByName(findings(df.where(meta("pattern").isin(*ASYMMETRIC) & ~has), F.lit(key), line=key_line("pattern"), note="needed"))
        out = out.unionByName(findings(df.where(meta("pattern").isin(*SYMMETRIC) & has), F.lit(key), line=key_line(key), note="not for this pattern"))
    return out


def vuln_sla(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Open findings are younger than the window of their severity."""
    windows = c.spark.createDataFrame([(k, int(v)) for k, v in p.get("windows", {"critical": 7, "high": 30}).items()], "sev string, days int")
    open_ = c.of(ns).where(F.col("status").isin(p.get("open", ["open"])))
    df = open_.withColumns({"sev": meta("severity"), "since": tx.date_of(meta(p.get("field", "discovered")))}).join(F.broadcast(windows), "sev")
    age = F.date_diff(_today(p), F.col("since"))
    return findings(df.where(age > F.col("days")), age, line=key_line("severity"), note=F.col("sev"))


def risk_expiry(c: Corpus, ns: str, p: dict) -> DataFrame:
    """An accepted risk has an approver, a rationale and an expiry in the future."""
    docs = c.of(ns).where(F.col("status").isin(p.get("require-when-status", ["accepted"])))
    if p.get("exempt-when-links"):
        out_to = c.edges.where(F.col("dst_ns").isin(p["exempt-when-links"])).select(F.col("src_key").alias("doc_key"))
        docs = docs.join(out_to, "doc_key", "left_anti")
    keys = docs.select("location", "metadata", "key_lines", F.explode(F.array(*[F.lit(k) for k in ("approver", "rationale", "expires")])).alias("key"))
    out = findings(keys.where(F.coalesce(F.trim(F.get_json_object(F.col("metadata")[F.col("key")], "$")), F.lit("")) == ""), F.col("key"))
    late = docs.where(tx.date_of(meta("expires")) <= _today(p))
    return out.unionByName(findings(late, F.lit("expires"), line=key_line("expires"), note=meta("expires")))


def _pointing(c: Corpus, ns: str) -> DataFrame:
    """doc_key of documents with an edge or mention that resolves to another document."""
    own = c.of(ns).select("doc_key", F.col("ns").alias("own_ns"), F.col("number").alias("own"))
    edge = c.edges.select(F.col("src_key").alias("doc_key"), "dst_ns", "dst_number")
    body = c.tokens.select("doc_key", F.col("ns").alias("dst_ns"), F.col("number").alias("dst_number"))
    to = _resolves(edge.unionByName(body), c.docs, "dst_ns", "dst_number", "left_semi").join(own, "doc_key")
    return to.where(~((F.col("dst_ns") == F.col("own_ns")) & F.col("dst_number").eqNullSafe(F.col("own"))))


def remediation_link(c: Corpus, ns: str, p: dict) -> DataFrame:
    docs = _subjects(c, ns, "id", "status").where(F.col("status").isin(p.get("statuses", ["mitigated"])))
    return findings(docs.join(_pointing(c, ns).select("doc_key"), "doc_key", "left_anti"), F.coalesce("id", "doc_key"))


def control_evidence(c: Corpus, ns: str, p: dict) -> DataFrame:
    """An asserted control has a resolving reference or a filled evidence field."""
    docs = c.of(ns).where(~F.coalesce(F.col("status").isin(p.get("out-of-scope-status", ["not-applicable"])), F.lit(False)))
    filled = F.lit(False)
    for key in p.get("evidence-fields", ["evidence"]):
        filled = filled | (F.coalesce(F.trim(meta(key)), F.lit("")) != "")
    to = _pointing(c, ns)
    if p.get("namespaces"):
        to = to.where(F.col("dst_ns").isin(p["namespaces"]))
    return findings(docs.where(~filled).join(to.select("doc_key"), "doc_key", "left_anti"), F.coalesce("id", "doc_key"))


def token_ref(c: Corpus, ns: str, p: dict) -> DataFrame:
    """{a.b.c} in a body names a node of the document's own metadata."""
    asked = c.of(ns).select("location", "metadata", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\{([A-Za-z_][\w-]*(?:\.[\w-]+)+)\}"), F.lit(1)))).alias("ref"))
    found = F.expr("get_json_object(metadata[substring_index(ref, '.', 1)], concat('$.', substring(ref, length(substring_index(ref, '.', 1)) + 2)))")
    return findings(asked.where(found.isNull()), F.col("ref"))


def soul_sections(c: Corpus, ns: str, p: dict) -> DataFrame:
    """A title and the configured sections at level 2; one at another level is said to be so."""
    docs = _subjects(c, ns)
    out = findings(docs.join(c.headings.where("level = 1").select("doc_key"), "doc_key", "left_anti"), F.lit("title"))
    wanted = _values(c.spark, "heading", p["sections"]).withColumn("norm", tx.norm_heading_col(F.col("heading")))
    have = c.headings.groupBy("doc_key", "norm").agg(F.bool_or(F.col("level") == 2).alias("right"), F.min("line").alias("line"))
    df = docs.crossJoin(F.broadcast(wanted)).join(have, ["doc_key", "norm"], "left").where("right IS NULL OR NOT right")
    return out.unionByName(findings(df, F.col("heading"), line=F.col("line"), note=F.when(F.col("right").isNotNull(), "at another level")))


def file_referenced(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Where the file exists, the documents link to it."""
    return requires_link(c, ns, {"targets": [p["target"]], "severity": p.get("severity", "warning")})


def pair(c: Corpus, ns: str, p: dict) -> DataFrame:
    """A sibling of the given name lies in the same folder."""
    folder = F.regexp_replace("location", r"[^/]*$", "")
    docs = c.of(ns).withColumn("path", F.concat(folder, F.lit(p["sibling"])))
    return findings(docs.join(c.files.select("path"), "path", "left_anti"), F.col("path"), severity=p.get("severity"))
