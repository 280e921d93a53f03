"""Rules that apply to any namespace.

Each takes (corpus, namespace, params) and returns findings.  A rule is an
anti-join, a filter, a grouped count or a graph query over the entity tables;
subjects are the namespace's documents, targets are always the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import globs, text as tx
from ..model import Corpus, findings, key_line, meta
from . import graph


def _values(spark, column: str, values: list) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def _resolves(df: DataFrame, docs: DataFrame, ns: str, number: str, how: str) -> DataFrame:
    """Semi- or anti-join of pointers with the documents they name, by namespace and number."""
    known = docs.where("number IS NOT NULL").select(F.col("ns").alias("_ns"), F.col("number").alias("_number")).distinct()
    return df.join(known, (df[ns] == known["_ns"]) & (df[number] == known["_number"]), how)


def _subjects(c: Corpus, ns: str, *columns: str) -> DataFrame:
    return c.of(ns).select("doc_key", "location", *columns)


# --- documents ---------------------------------------------------------------


def frontmatter(c: Corpus, ns: str, p: dict) -> DataFrame:
    """The metadata block of a claimed document parses."""
    return findings(c.of(ns).where("parse_error IS NOT NULL"), F.col("parse_error"), line=F.lit(1))


def id_present(c: Corpus, ns: str, p: dict) -> DataFrame:
    """The id is there and well formed; sources that address by location have none."""
    bad = c.of(ns).where("parse_error IS NULL AND (id IS NULL OR number IS NULL)")
    return findings(bad, F.coalesce("id", F.lit("(none)")), line=key_line("id"))


def id_unique(c: Corpus, ns: str, p: dict) -> DataFrame:
    """No two documents have the same (namespace, number)."""
    w = Window.partitionBy("ns", "number")
    df = c.of(ns).where("number IS NOT NULL").withColumn("n", F.count("*").over(w)).where("n > 1")
    return findings(df, F.col("id"), line=key_line("id"), note=F.concat(F.col("n"), F.lit(" documents")))


def duplicate_ids(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Ids that several documents share, with their number: the grouped form of id_unique."""
    return docs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def required_metadata(c: Corpus, ns: str, p: dict) -> DataFrame:
    keys = F.explode(F.array(*[F.lit(k) for k in p["keys"]]))
    df = c.of(ns).where("parse_error IS NULL").select("location", "metadata", keys.alias("key"))
    return findings(df.where(~F.coalesce(F.map_contains_key("metadata", F.col("key")), F.lit(False))), F.col("key"))


def allowed_values(c: Corpus, ns: str, p: dict) -> DataFrame:
    out = None
    for key, allowed in p.items():
        if key == "severity":
            continue
        bad = c.of(ns).withColumn("value", meta(key)).where(F.col("value").isNotNull() & ~F.col("value").isin(allowed))
        rows = findings(bad, F.lit(key), line=key_line(key), note=F.col("value"), severity=p.get("severity"))
        out = rows if out is None else out.unionByName(rows)
    return out


def metadata_format(c: Corpus, ns: str, p: dict) -> DataFrame:
    out = None
    for key, form in p.items():
        if key == "severity":
            continue
        value = meta(key)
        good = tx.date_of(value).isNotNull() if form == "date" else tx.is_datetime(value)
        bad = c.of(ns).where(value.isNotNull() & ~good)
        rows = findings(bad, F.lit(key), line=key_line(key), note=value, severity=p.get("severity"))
        out = rows if out is None else out.unionByName(rows)
    return out


def min_docs(c: Corpus, ns: str, p: dict) -> DataFrame:
    """A declared namespace has documents; anchored on the config."""
    one = c.spark.createDataFrame([(ns, "config")], "ns string, location string")
    return findings(one.join(c.of(ns).select("ns"), "ns", "left_anti"), F.col("ns"), severity=p.get("severity"))


def file_name(c: Corpus, ns: str, p: dict) -> DataFrame:
    """The number in a file's name is that of its id."""
    name = F.element_at(F.split("file", "/"), -1)
    named = F.regexp_extract(name, rf"^(?i:{ns})-([0-9]+)", 1)
    named = F.when(named != "", named).otherwise(F.regexp_extract(name, r"^([0-9]+)", 1))
    df = c.of(ns).where("file IS NOT NULL AND number IS NOT NULL").withColumn("named", named.try_cast("bigint"))
    return findings(df.where("named <> number"), F.col("id"), line=key_line("id"), note=name)


def file_budget(c: Corpus, ns: str, p: dict) -> DataFrame:
    limit = p.get("max_chars", 20_000)
    df = c.of(ns).withColumn("n", F.char_length("body")).where(F.col("n") > limit)
    return findings(df, F.col("n"), note=F.lit(f"limit {limit}"), severity=p.get("severity"))


def required_anchors(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Every configured string occurs in the body."""
    if not p.get("anchors"):
        return findings(c.of(ns).limit(0), F.lit(""))
    df = c.of(ns).select("location", "body", F.explode(F.array(*[F.lit(a) for a in p["anchors"]])).alias("anchor"))
    return findings(df.where(~F.coalesce(F.col("body").contains(F.col("anchor")), F.lit(False))), F.col("anchor"))


def required_headings(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Configured H2 headings are present, compared in normal form; a command under those of code_in."""
    docs = _subjects(c, ns, "status")
    if p.get("statuses"):
        docs = docs.where(F.col("status").isin(p["statuses"]))
    have = c.headings.where("level = 2")
    wanted = _values(c.spark, "heading", p["headings"]).withColumn("norm", tx.norm_heading_col(F.col("heading")))
    missing = docs.crossJoin(F.broadcast(wanted)).join(have.select("doc_key", "norm").distinct(), ["doc_key", "norm"], "left_anti")
    out = findings(missing, F.col("heading"))
    if p.get("code_in"):
        code = _values(c.spark, "heading", p["code_in"]).withColumn("norm", tx.norm_heading_col(F.col("heading")))
        empty = have.join(F.broadcast(code), "norm").groupBy("doc_key", "heading").agg(F.bool_or("code").alias("code"), F.min("line").alias("line"))
        empty = docs.join(empty.where("NOT coalesce(code, false)"), "doc_key")
        out = out.unionByName(findings(empty, F.col("heading"), line=F.col("line"), note="no command"))
    return out


def calendar_freshness(c: Corpus, ns: str, p: dict) -> DataFrame:
    """A review date is not older than stale_days; ``as_of`` is today unless given."""
    key, days = p.get("field", "reviewed_date"), p.get("stale_days", 30)
    as_of = F.to_date(F.lit(p["as_of"])) if p.get("as_of") else F.current_date()
    due = F.date_add(tx.date_of(meta(key)), days)
    return findings(c.of(ns).where(due < as_of), F.lit(key), line=key_line(key), note=due.cast("string"), severity=p.get("severity"))


def acceptance_complete(c: Corpus, ns: str, p: dict) -> DataFrame:
    """A terminal document has no unchecked box in its acceptance sections."""
    names = [tx.norm_heading(h) for h in p.get("headings", ["Acceptance", "Definition of Done"])]
    docs = _subjects(c, ns, "status").where(F.col("status").isin(p["terminal"]))
    boxes = c.checkboxes.where(F.col("section").isin(names))
    out = findings(docs.join(boxes.where("NOT checked"), "doc_key"), F.col("section"), line=F.col("line"))
    if p.get("require_boxes"):
        out = out.unionByName(findings(docs.join(boxes, "doc_key", "left_anti"), F.lit("no boxes")))
    return out


# --- pointers ----------------------------------------------------------------


def dep_resolved(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Every depends_on and part_of names a document; part_of only into namespaces that take members."""
    edges = c.edges.where((F.col("src_ns") == ns) & F.col("kind").isin("depends_on", "part_of"))
    at = edges.join(_subjects(c, ns), F.col("src_key") == F.col("doc_key"))
    out = findings(_resolves(at, c.docs, "dst_ns", "dst_number", "left_anti"), F.col("dst_raw"), line=F.col("line"), note=F.col("kind"))
    closed = [n.name for n in c.namespaces if not n.takes_members]
    if closed:
        wrong = at.where((F.col("kind") == "part_of") & F.col("dst_ns").isin(closed))
        out = out.unionByName(findings(wrong, F.col("dst_raw"), line=F.col("line"), note="takes no members"))
    return out


def dangling(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Pointers whose target is no known document: the bare form of dep_resolved."""
    return _resolves(edges, known, "dst_ns", "dst_number", "left_anti")


def blocking(edges: DataFrame, docs: DataFrame, terminal: list[str], satisfied_by: dict[str, list[str]] | None = None) -> DataFrame:
    """depends_on edges with the target's status and whether the target still blocks.

    A target blocks if it has a status that is neither terminal nor listed for
    its namespace in ``satisfied_by``; one without a status never does, and
    part_of never does.
    """
    settled = F.col("status").isin(terminal)
    for name, statuses in (satisfied_by or {}).items():
        settled = F.when(F.col("ns") == name, F.col("status").isin(statuses)).otherwise(settled)
    blocks = F.col("status").isNotNull() & ~settled
    # documents that share an id are one target, which blocks if one of them does
    target = docs.where("number IS NOT NULL").groupBy(F.col("ns").alias("dst_ns"), F.col("number").alias("dst_number")).agg(
        F.coalesce(F.min(F.when(blocks, F.col("status"))), F.min("status")).alias("dst_status"), F.bool_or(blocks).alias("blocks")
    )
    return edges.where("kind = 'depends_on'").join(target, ["dst_ns", "dst_number"])


def dep_status(c: Corpus, ns: str, p: dict) -> DataFrame:
    """What a terminal document depends on is terminal too."""
    done = _subjects(c, ns, "status").where(F.col("status").isin(p["terminal"]))
    edges = c.edges.where(F.col("src_ns") == ns).join(done, F.col("src_key") == F.col("doc_key"))
    open_ = blocking(edges, c.docs, p["terminal"], p.get("satisfied-by")).where("blocks")
    out = findings(open_, F.col("dst_raw"), line=F.col("line"), note=F.col("dst_status"), severity=p.get("severity"))
    containers = p.get("containers")
    if containers:
        member = edges.where((F.col("kind") == "depends_on") & F.col("dst_ns").isin(containers))
        out = out.unionByName(findings(member, F.col("dst_raw"), line=F.col("line"), note="belongs in part_of", severity="warning"))
    return out


def dep_cycle(c: Corpus, ns: str, p: dict) -> DataFrame:
    """No document of the namespace lies on a cycle of depends_on."""
    target = c.docs.where("number IS NOT NULL").select(F.col("ns").alias("dst_ns"), F.col("number").alias("dst_number"), F.col("doc_key").alias("dst"))
    edges = c.edges.where("kind = 'depends_on'").join(target, ["dst_ns", "dst_number"]).select(F.col("src_key").alias("src"), "dst")
    on = graph.cycle_members(edges).withColumnRenamed("node", "doc_key")
    return findings(_subjects(c, ns, "id", "key_lines").join(on, "doc_key"), F.coalesce("id", "doc_key"), line=key_line("depends_on"), note=F.col("cycle"))


def first_mentions(mentions: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One row a (file, target): the first mention, with the number of all."""
    w = Window.partitionBy(*by)
    return (
        mentions.withColumn("nth", F.row_number().over(w.orderBy(*order)))
        .withColumn("n", F.count("*").over(w))
        .where("nth = 1")
        .drop("nth")
    )


def cross_ref(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Ids mentioned in bodies name documents."""
    mentions = c.tokens.withColumnsRenamed({"ns": "dst_ns", "number": "dst_number"}).join(_subjects(c, ns), "doc_key")
    lost = _resolves(mentions, c.docs, "dst_ns", "dst_number", "left_anti")
    one = first_mentions(lost, ["location", "dst_ns", "dst_number"], ["line", "col"])
    return findings(one, F.col("raw"), line=F.col("line"), col=F.col("col"), note=F.concat(F.col("n"), F.lit(" mentions")))


def scanned_ref(c: Corpus) -> DataFrame:
    """Ids mentioned in scanned files name documents; runs once if any namespace binds the rule."""
    hits = c.scan_hits.withColumnsRenamed({"ns": "dst_ns", "number": "dst_number"})
    lost = _resolves(hits, c.docs, "dst_ns", "dst_number", "left_anti")
    one = first_mentions(lost, ["file", "dst_ns", "dst_number"], ["line", "col"])
    return findings(one, F.col("raw"), path="file", line=F.col("line"), col=F.col("col"), note=F.concat(F.col("n"), F.lit(" mentions")))


def link_resolved(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Relative links and images point at files; external, site-absolute and pure fragment links have no path."""
    links = c.links.where(F.col("path").isNotNull() & (F.col("kind") != "import"))
    if not p.get("images", True):
        links = links.where("kind <> 'image'")
    if p.get("allow"):
        links = links.where(~F.col("target").rlike(globs.any_of(p["allow"])) & ~F.col("path").rlike(globs.any_of(p["allow"])))
    lost = links.withColumnRenamed("path", "to").join(c.files.select(F.col("path").alias("to")), "to", "left_anti")
    df = lost.join(_subjects(c, ns), "doc_key")
    return findings(df, F.col("target"), line=F.col("line"), col=F.col("col"), severity=p.get("severity", "warning"))


def dep_shape(c: Corpus, ns: str, p: dict) -> DataFrame:
    """A document depends on the namespaces it must."""
    docs = _subjects(c, ns, "status", "key_lines")
    if p.get("statuses"):
        docs = docs.where(F.col("status").isin(p["statuses"]))
    to = c.edges.where((F.col("src_ns") == ns) & (F.col("kind") == "depends_on"))
    if p.get("admissibility"):  # only targets in these statuses count
        ok = c.docs.where(F.col("status").isin(p["admissibility"]))
        to = _resolves(to, ok, "dst_ns", "dst_number", "left_semi")
    wanted = sorted({*p.get("requires", []), *p.get("requires-any", [])})
    to = to.where(F.col("dst_ns").isin(wanted)).groupBy("src_key").agg(F.collect_set("dst_ns").alias("have"))
    df = docs.join(to, docs.doc_key == to.src_key, "left")
    have = F.coalesce("have", F.array().cast("array<string>"))
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    missing = F.array_except(arr(p.get("requires", [])), have)
    out = findings(df.where(F.size(missing) > 0), F.array_join(missing, ", "), line=key_line("depends_on"), severity=p.get("severity"))
    if p.get("requires-any"):
        none = df.where(~F.arrays_overlap(have, arr(p["requires-any"])))
        out = out.unionByName(findings(none, F.lit(" or ".join(p["requires-any"])), line=key_line("depends_on"), severity=p.get("severity")))
    return out


def successor_link(c: Corpus, ns: str, p: dict) -> DataFrame:
    """A superseded document names a successor that exists."""
    kind, trigger = p.get("field", "superseded_by"), p.get("trigger", "superseded")
    docs = _subjects(c, ns, "status", "key_lines").where(F.col("status") == trigger)
    to = c.edges.where((F.col("src_ns") == ns) & (F.col("kind") == kind))
    if p.get("namespace"):
        to = to.where(F.col("dst_ns") == p["namespace"])
    good = _resolves(to, c.docs, "dst_ns", "dst_number", "left_semi").select(F.col("src_key").alias("doc_key"))
    return findings(docs.join(good, "doc_key", "left_anti"), F.lit(kind), line=key_line(kind))


def supersedes_reciprocal(c: Corpus, ns: str, p: dict) -> DataFrame:
    """What an accepted document supersedes is superseded and names it back."""
    accepted, superseded = p.get("accepted", "accepted"), p.get("superseded", "superseded")
    docs = _subjects(c, ns, "ns", "number", "status").where(F.col("status") == accepted).withColumnsRenamed({"ns": "s_ns", "number": "s_number"})
    edges = c.edges.where((F.col("src_ns") == ns) & (F.col("kind") == "supersedes")).join(docs, F.col("src_key") == F.col("doc_key")).drop("doc_key")
    old = c.docs.select(F.col("ns").alias("dst_ns"), F.col("number").alias("dst_number"), F.col("doc_key").alias("old_key"), F.col("status").alias("old_status"))
    back = c.edges.where("kind = 'superseded_by'").select(
        F.col("src_key").alias("old_key"), F.col("dst_ns").alias("s_ns"), F.col("dst_number").alias("s_number"), F.lit(True).alias("back")
    ).distinct()
    df = edges.join(old, ["dst_ns", "dst_number"]).join(back, ["old_key", "s_ns", "s_number"], "left")
    bad = df.where((F.coalesce("old_status", F.lit("")) != superseded) | F.col("back").isNull())
    return findings(bad, F.col("dst_raw"), line=F.col("line"), note=F.when(F.col("back").isNull(), "no link back").otherwise(F.col("old_status")))


def requires_link(c: Corpus, ns: str, p: dict) -> DataFrame:
    """A document links to (or imports) each target file that exists."""
    targets = _values(c.spark, "path", p["targets"]).join(c.files.select("path"), "path", "left_semi").withColumnRenamed("path", "to")
    docs = _subjects(c, ns).crossJoin(F.broadcast(targets))
    have = c.links.select("doc_key", F.col("path").alias("to")).distinct()
    return findings(docs.join(have, ["doc_key", "to"], "left_anti"), F.col("to"), severity=p.get("severity", "error"))


def requirement_ref(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Requirement ids in "Satisfies" and "Addressed by" lists exist."""
    names = [tx.norm_heading(h) for h in p.get("headings", ["Satisfies", "Addressed by"])]
    items = c.list_items.where(F.col("section").isin(names)).select(
        "doc_key", "line", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*-[0-9]+(?:\\.[0-9]+)*)"), F.lit(1))).alias("req_id")
    )
    lost = items.join(c.requirements.select("req_id").distinct(), "req_id", "left_anti")
    return findings(lost.join(_subjects(c, ns), "doc_key"), F.col("req_id"), line=F.col("line"), severity=p.get("severity"))


def requirement_status(c: Corpus, ns: str, p: dict) -> DataFrame:
    """Each requirement has a status out of the configured mapping."""
    known = [s.lower() for s in p["statuses"]]
    bad = c.requirements.where(F.col("status").isNull() | ~F.lower("status").isin(known))
    return findings(bad.withColumnRenamed("status", "said").join(_subjects(c, ns), "doc_key"), F.col("req_id"), line=F.col("line"), note=F.col("said"))


def commit_freshness(c: Corpus, ns: str, p: dict) -> DataFrame:
    """A pinned commit is an ancestor of HEAD and its scope has not changed since.

    ``corpus.git`` gives (commit, ancestor) and (commit, path) of changed
    files; without git the rule warns.
    """
    docs = c.of(ns).select("doc_key", "location", "file", "key_lines", F.col("pin.commit").alias("commit"), F.col("pin.scope").alias("scope"))
    out = None
    if p.get("require-pin"):
        out = findings(docs.where("commit IS NULL"), F.lit("pin"), severity=p.get("severity"))
    pinned = docs.where("commit IS NOT NULL")
    if c.git is None:
        rows = findings(pinned, F.col("commit"), line=key_line("pin"), note="no git here", severity="warning")
        return rows if out is None else out.unionByName(rows)
    commits = [r.commit for r in pinned.select("commit").distinct().collect()]
    ancestors, changed = c.git.facts(c.spark, commits)
    stray = pinned.join(ancestors.where("ancestor").select("commit"), "commit", "left_anti")
    rows = findings(stray, F.col("commit"), line=key_line("pin"), note="not an ancestor of HEAD", severity=p.get("severity"))
    scope = pinned.select("commit", "location", "key_lines", F.explode("scope").alias("glob")).withColumn("rx", globs_col(F.col("glob")))
    hit = scope.join(changed, "commit").where(F.expr("path RLIKE rx"))
    hit = hit.groupBy("location", "commit", F.col("key_lines")["pin"].alias("at")).agg(F.min("path").alias("first"), F.count_distinct("path").alias("n"))
    rows = rows.unionByName(findings(hit, F.col("commit"), line=F.col("at"), note=F.concat(F.col("first"), F.lit(" and others, "), F.col("n")), severity=p.get("severity")))
    own = pinned.join(changed.select("commit", F.col("path").alias("file")).distinct(), ["commit", "file"], "left_semi")
    dirty = c.git.dirty(c.spark).select(F.col("path").alias("file"))
    rows = rows.unionByName(findings(own.join(dirty, "file", "left_semi"), F.col("commit"), line=key_line("pin"), note="the document itself is dirty", severity="warning"))
    return rows if out is None else out.unionByName(rows)


def globs_col(glob: Column) -> Column:
    """globs.to_regex for patterns of letters, *, **/ and ? that stand in a column."""
    out = F.regexp_replace(glob, r"([.+^$()|{}\[\]\\])", r"\\$1")
    out = F.regexp_replace(out, r"\*\*/", "\u0001")
    out = F.regexp_replace(out, r"\*+", ".*")
    out = F.regexp_replace(out, r"\?", ".")
    return F.concat(F.lit("^"), F.regexp_replace(out, "\u0001", "(?:.*/)?"), F.lit("$"))
