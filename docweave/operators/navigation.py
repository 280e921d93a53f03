"""Queries that navigate the graph: what points here, what is ready, what exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Corpus, key_line, meta
from . import core, graph


def refs(c: Corpus, ns: str, number: int) -> DataFrame:
    """Everything that points at a document: itself, edges, body mentions, scanned files; sorted."""
    named = lambda n, k: (F.col(n) == ns) & (F.col(k) == number)
    docs = c.docs.select("doc_key", F.col("location").alias("file"), F.coalesce("id", "location").alias("from"))
    self_ = c.docs.where(named("ns", "number")).select(
        F.col("location").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit("self").alias("kind"), F.lit(None).cast("string").alias("from")
    )
    edge = c.edges.where(named("dst_ns", "dst_number")).join(docs, F.col("src_key") == F.col("doc_key")).select("file", "line", F.lit(0).alias("col"), "kind", "from")
    body = c.tokens.where(named("ns", "number")).join(docs, "doc_key").select("file", "line", "col", F.lit("body").alias("kind"), "from")
    scan = c.scan_hits.where(named("ns", "number")).select("file", "line", "col", F.lit("scanner").alias("kind"), F.lit(None).cast("string").alias("from"))
    return self_.unionByName(edge).unionByName(body).unionByName(scan).orderBy("file", "line", "col", "kind", "from")


def definition(c: Corpus, ns: str, number: int) -> DataFrame:
    return c.docs.where((F.col("ns") == ns) & (F.col("number") == number)).select("id", "location")


def hover(c: Corpus, ns: str, number: int) -> DataFrame:
    return c.docs.where((F.col("ns") == ns) & (F.col("number") == number)).select("id", "title", "status")


def symbols(c: Corpus, text: str, prefix: bool = False) -> DataFrame:
    """Ids (and titles) by prefix or substring."""
    hit = F.col("id").startswith(text) if prefix else F.col("id").contains(text) | F.lower("title").contains(text.lower())
    return c.docs.where(hit).select("id", "title", "location").orderBy("ns", "number")


def edges(c: Corpus) -> DataFrame:
    """The graph of documents: (from, to, kind, resolved) of every pointer, ids as written."""
    docs = c.docs.select("doc_key", F.coalesce("id", "location").alias("from"))
    known = c.docs.where("number IS NOT NULL").groupBy(F.col("ns").alias("dst_ns"), F.col("number").alias("dst_number")).agg(F.min("id").alias("to_id"), F.lit(True).alias("hit"))
    rows = c.edges.join(docs, F.col("src_key") == F.col("doc_key")).join(known, ["dst_ns", "dst_number"], "left")
    return rows.select("from", F.coalesce("to_id", "dst_raw").alias("to"), "kind", F.coalesce("hit", F.lit(False)).alias("resolved")).orderBy("from", "kind", "to")


def inventory(c: Corpus) -> DataFrame:
    """All documents by namespace and number."""
    return c.docs.select("ns", "number", "id", "title", "status", "location").orderBy("ns", F.col("number").asc_nulls_last(), "location")


def namespaces(c: Corpus) -> DataFrame:
    """Declared namespaces with owner, summary and number of documents."""
    rows = [(n.name, n.owner, n.summary, n.paths) for n in c.namespaces]
    declared = c.spark.createDataFrame(rows, "ns string, owner string, summary string, paths array<string>")
    counts = c.docs.groupBy("ns").agg(F.count("*").alias("n_docs"))
    return with_counts(declared, counts)


def with_counts(declared: DataFrame, counts: DataFrame) -> DataFrame:
    return declared.join(counts, "ns", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))


def status(c: Corpus, terminal: list[str], satisfied_by: dict[str, dict] | None = None) -> DataFrame:
    """One state a document: settled, blocked, ready or untracked.

    A terminal document is settled (and marked if something it waits for is
    open), one without a status untracked, any other blocked or ready by its
    depends_on.  ``satisfied_by`` maps a source namespace to what settles its
    targets, by target namespace.
    """
    binds = {n.name: n.params.get("core.dep-status", {}) for n in c.namespaces if "core.dep-status" in n.rules}
    own = {ns: (p.get("terminal", terminal), p.get("satisfied-by")) for ns, p in binds.items()}
    for ns, by in (satisfied_by or {}).items():
        own[ns] = (own.get(ns, (terminal, None))[0], by)
    groups = [(F.col("src_ns") == ns, t, by) for ns, (t, by) in own.items()]
    groups.append((~F.col("src_ns").isin(list(own)) if own else F.lit(True), terminal, None))
    blocks = None
    for of, t, by in groups:
        part = core.blocking(c.edges.where(of), c.docs, t, by).groupBy("src_key").agg(F.bool_or("blocks").alias("blocked"))
        blocks = part if blocks is None else blocks.unionByName(part)
    df = c.docs.join(blocks, F.col("doc_key") == F.col("src_key"), "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    settled = F.col("status").isin(terminal)
    for ns, (t, _) in own.items():
        settled = F.when(F.col("ns") == ns, F.col("status").isin(t)).otherwise(settled)
    state = F.when(F.col("status").isNull(), "untracked").when(settled, "settled").when(F.col("blocked"), "blocked").otherwise("ready")
    return df.select(
        "doc_key", "ns", "number", "id", "title", "status", state.alias("state"), (settled & F.col("blocked")).alias("settled_on_open")
    )


def status_exit(states: DataFrame) -> int:
    """0 if all tracked documents are settled, else 1."""
    return int(not states.where(F.col("state").isin("ready", "blocked")).isEmpty())


def lineage(c: Corpus, roots: DataFrame) -> DataFrame:
    """Transitive dependents of documents (root, node, depth), and how many roots share each node."""
    target = c.docs.where("number IS NOT NULL").select(F.col("ns").alias("dst_ns"), F.col("number").alias("dst_number"), F.col("doc_key").alias("src"))
    back = c.edges.where("kind = 'depends_on'").join(target, ["dst_ns", "dst_number"]).select("src", F.col("src_key").alias("dst"))
    found = graph.reach(back, roots)
    return found.withColumn("shared_by", F.count("*").over(Window.partitionBy("node")))


def briefing(c: Corpus, found: DataFrame | None = None) -> DataFrame:
    """What each namespace's briefing asks for: documents by status in its order, counts, findings of rules.

    ``found`` is a diagnostics table with the column ns.
    """
    out = None
    for n in c.namespaces:
        b = n.briefing or {}
        docs = c.of(n.name)
        parts = []
        if b.get("statuses"):
            order = F.array_position(F.array(*[F.lit(s) for s in b["statuses"]]), F.col("status"))
            parts.append(docs.where(F.col("status").isin(b["statuses"]) & F.col("id").isNotNull()).select(
                "ns", F.lit("document").alias("kind"), F.col("status").alias("what"), "id", "title", order.cast("long").alias("place"), F.lit(1).cast("long").alias("n")))
        if b.get("counts"):
            counted = docs.where(F.col("status").isin(b["counts"])).groupBy("ns", "status").agg(F.count("*").alias("n"))
            parts.append(counted.select("ns", F.lit("count").alias("kind"), F.col("status").alias("what"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("title"), F.lit(1000).cast("long").alias("place"), "n"))
        if b.get("findings") and found is not None:
            rows = found.where((F.col("ns") == n.name) & F.col("code").isin(b["findings"]))
            parts.append(rows.select("ns", F.lit("finding").alias("kind"), F.col("code").alias("what"), F.col("path").alias("id"), F.col("message").alias("title"), F.lit(2000).cast("long").alias("place"), F.lit(1).cast("long").alias("n")))
        for part in parts:
            out = part if out is None else out.unionByName(part)
    empty = "ns string, kind string, what string, id string, title string, place bigint, n bigint"
    return c.spark.createDataFrame([], empty) if out is None else out.orderBy("ns", "place", "what", "id")


def next_ids(docs: DataFrame) -> DataFrame:
    """The number that a new document of each namespace gets."""
    return docs.where("number IS NOT NULL").groupBy("ns").agg((F.max("number") + 1).alias("next_id"))


def first_settled(per_tag: DataFrame, by: list[str], order: str) -> DataFrame:
    """For each document the first release (least ``order``) whose tree marks it terminal."""
    return per_tag.groupBy(*by).agg(F.min_by("tag", order).alias("tag"), F.min(order).alias("first"))


def changelog(per_tag: DataFrame, namespaces_: list[str], terminal: list[str]) -> DataFrame:
    """(tag, id, text): documents by the first release that settled them.

    ``per_tag`` holds the documents of each tag's tree: tag, tag_order, and docs columns.
    """
    done = per_tag.where(F.col("ns").isin(namespaces_) & F.col("status").isin(terminal))
    done = done.withColumn("entry", F.coalesce(meta("changelog"), F.col("title"), F.col("id")))
    best = F.min_by(F.struct("tag", "entry", "id", "tag_order"), "tag_order")
    first = done.groupBy("ns", "number").agg(best.alias("b"))
    return first.select("b.tag", "b.tag_order", "ns", "number", "b.id", F.col("b.entry").alias("text")).orderBy(F.desc("tag_order"), "ns", "number")


#: Known names that one broadcast holds; more are compared in blocks of so many.
NEAREST_BLOCK = 10_000


def nearest(names: DataFrame, known: DataFrame) -> DataFrame:
    """For each name the known name at the least edit distance, ties by name."""
    blocks = -(-known.count() // NEAREST_BLOCK)
    if blocks <= 1:
        pairs = names.crossJoin(F.broadcast(known))
    else:
        held = known.withColumn("block", F.pmod(F.hash("known_name"), F.lit(blocks)))
        asked = names.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = asked.join(held, "block")
    pairs = pairs.withColumn("distance", F.levenshtein("name", "known_name"))
    return pairs.groupBy("name").agg(F.min(F.struct("distance", "known_name")).alias("b")).select(
        "name", F.col("b.known_name").alias("nearest"), F.col("b.distance").cast("long").alias("distance")
    )


def drift(stored: DataFrame, current: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """current, drift, no baseline or gone for each key: a full outer comparison of fingerprints."""
    a = stored.select(key, F.col(fingerprint).alias("was"))
    b = current.select(key, F.col(fingerprint).alias("now"))
    state = F.when(F.col("was").isNull(), "no baseline").when(F.col("now").isNull(), "gone").when(F.col("was") == F.col("now"), "current").otherwise("drift")
    return a.join(b, key, "full").select(key, state.alias("state"))


def claims(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """(path, ns) for every pattern (ns, rx) that a path matches; patterns are configuration, so they are few."""
    return paths.join(F.broadcast(globs), F.expr("path RLIKE rx")).select("path", "ns").distinct()


def conflicts(claimed: DataFrame) -> DataFrame:
    """Paths that several namespaces claim."""
    return claimed.groupBy("path").agg(F.count_distinct("ns").alias("n_ns"), F.array_join(F.sort_array(F.collect_set("ns")), ",").alias("namespaces")).where("n_ns > 1")
