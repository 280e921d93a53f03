"""Commands: python -m docweave.cli [--root DIR] COMMAND ..."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import kernel, navigation as nav
from .plans import lint as plan, packs, report
from .plans.registry import RULES
from .sources import config as cfg, markdown
from .sources.git import Git


def session() -> SparkSession:
    spark = SparkSession.builder.appName("docweave").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _id(text: str) -> tuple[str, int]:
    found = tx.split_id(text)
    if not found:
        raise cfg.ConfigError(f"{text} is no id")
    return found


def cmd_lint(spark, a) -> int:
    if a.recursive:
        runs = {}
        for folder, _, files in os.walk(a.root):
            if cfg.CONFIG_NAME in files:
                runs[os.path.relpath(folder, a.root)] = report.summary(plan.lint(spark, folder, as_of=a.as_of).found)
        out = report.recursive(runs)
        print(report.canonical(out))
        return out["exit_code"]
    only = list(a.namespace or [])
    for name in a.pack or []:
        only += packs.discover(a.root)[name][1]["namespaces"]
    run = plan.lint(spark, a.root, only=only or None, as_of=a.as_of)
    if a.format == "json":
        print(report.json_report(run.found, kernel.count_undeclared(run.corpus)))
    else:
        print(report.text_report(run.found, run.corpus.docs.count(), len({r for n in run.corpus.namespaces for r in n.rules})))
        if a.format == "rich":
            print("rules: docweave rules --namespace NS", file=sys.stderr)
    return report.exit_status(report.summary(run.found))


def cmd_refs(spark, a) -> int:
    _, corpus, _ = plan.load(spark, a.root)
    rows = nav.refs(corpus, *_id(a.id))
    print(report.refs_json(rows) if a.format == "json" else report.refs_text(rows))
    return 0


def cmd_list(spark, a) -> int:
    _, corpus, _ = plan.load(spark, a.root)
    print(report.table(nav.inventory(corpus), a.format))
    return 0


def cmd_graph(spark, a) -> int:
    _, corpus, _ = plan.load(spark, a.root)
    print(report.table(nav.edges(corpus), a.format))
    return 0


def cmd_namespaces(spark, a) -> int:
    config, corpus, _ = plan.load(spark, a.root)
    rows = nav.namespaces(corpus)
    if a.path:
        from .functions import globs

        rows = rows.where(F.col("ns").isin([n.name for n in config.namespaces if re.match(globs.any_of(n.paths), a.path)]))
    print(report.table(rows.select("ns", "owner", "summary", "n_docs").orderBy("ns"), a.format))
    return 0


def cmd_rules(spark, a) -> int:
    config = cfg.load(a.root)
    for n in config.namespaces:
        if not a.namespace or n.name in a.namespace:
            for code in n.rules:
                if not a.code or code == a.code:
                    print(n.name, code, "built-in" if code in RULES else "external", report.json.dumps(n.params.get(code, {}), sort_keys=True))
    return 0


def cmd_status(spark, a) -> int:
    _, corpus, _ = plan.load(spark, a.root)
    states = nav.status(corpus, a.terminal.split(","))
    if a.lineage:
        ns, number = _id(a.lineage)
        roots = nav.definition(corpus, ns, number).select(F.col("location").alias("node"))
        if roots.isEmpty():
            raise cfg.ConfigError(f"{a.lineage} is no known document")
        states = states.join(nav.lineage(corpus, roots).select(F.col("node").alias("doc_key")).distinct(), "doc_key", "left_semi")
    states = states.persist()
    print(report.table(states.orderBy("state", "ns", "number").select("state", "id", "title", "settled_on_open"), a.format))
    return nav.status_exit(states) if a.exit_code else 0


def cmd_briefing(spark, a) -> int:
    run = plan.lint(spark, a.root)
    print(report.table(nav.briefing(run.corpus, run.found), a.format))
    return 0


def cmd_new(spark, a) -> int:
    config, corpus, _ = plan.load(spark, a.root)
    n = next((n for n in config.namespaces if n.name == a.namespace_name), None)
    if n is None:
        raise cfg.ConfigError(f"no namespace {a.namespace_name}")
    path, content = report.scaffold(corpus, n, a.title, a.id)
    if a.stdout:
        print(content)
    else:
        path = os.path.join(a.out, os.path.basename(path)) if a.out else os.path.join(a.root, path)
        report.write(path, content)
        print(path)
    return 0


def cmd_init(spark, a) -> int:
    """A configuration of packs, or of the namespaces that the folders suggest."""
    text = ""
    for name in a.pack or []:
        text, _, _ = packs.add(name, text, a.root)
    if not a.pack:
        for pack in packs.BUILT_IN.values():
            for ns, section in pack["namespaces"].items():
                folder = section["paths"][0].split("*")[0].rstrip("/")
                if (not a.namespaces and os.path.exists(os.path.join(a.root, folder))) or ns in (a.namespaces or "").split(","):
                    text += packs.text_of({"namespaces": {ns: section}}) + "\n"
    if a.stdout:
        print(text)
    else:
        path = os.path.join(a.root, cfg.CONFIG_NAME)
        if os.path.exists(path):
            raise cfg.ConfigError(f"{path} is there already")
        report.write(path, text)
    return 0


def cmd_pack(spark, a) -> int:
    path = os.path.join(a.root, cfg.CONFIG_NAME)
    text = open(path, encoding="utf-8").read() if os.path.exists(path) else ""
    if a.action == "list":
        for name, (origin, pack) in sorted(packs.discover(a.root).items()):
            print(name, origin, ",".join(pack["namespaces"]))
    elif a.action == "show":
        print(packs.show(a.name, a.root))
    elif a.action in ("add", "install"):
        text, added, left = packs.add(a.name, text, a.root)
        report.write(path, text)
        print("added:", ",".join(added) or "-", "left:", ",".join(left) or "-")
    elif a.action == "outdated":
        print(report.table(packs.outdated(spark, text, a.root).orderBy("ns")))
    elif a.action == "migrate":
        text, done = packs.migrate(text, a.root)
        report.write(path, text)
        print("replaced:", ",".join(done) or "-")
    return 0


def cmd_changelog(spark, a) -> int:
    """Documents by the first tag that settled them; --check compares with the file."""
    git, config = Git(a.root), cfg.load(a.root)
    per_tag = None
    for order, tag in enumerate(git.tags()):
        rows = spark.createDataFrame([(p, bytearray(x.encode())) for p, x in git.tree(tag)], "location string, content binary")
        docs = markdown.build(spark, markdown.parse_files(rows), config).docs
        part = docs.select("ns", "number", "id", "title", "status", "metadata").withColumns({"tag": F.lit(tag), "tag_order": F.lit(order)})
        per_tag = part if per_tag is None else per_tag.unionByName(part)
    if per_tag is None:
        return 0
    rows = nav.changelog(per_tag, a.namespace or config.names(), a.terminal.split(","))
    if a.format == "json":
        print(report.table(rows, "json"))
        return 0
    text, path = report.changelog_text(rows), os.path.join(a.root, "CHANGELOG.md")
    if a.check:
        return int(not os.path.exists(path) or open(path, encoding="utf-8").read() != text)
    report.write(path, text)
    return 0


def cmd_pin(spark, a) -> int:
    """Set a document's pin.commit to HEAD; refused while its scope is dirty."""
    git = Git(a.root)
    _, corpus, _ = plan.load(spark, a.root)
    ns, number = _id(a.id)
    doc = corpus.docs.where((F.col("ns") == ns) & (F.col("number") == number)).select("file", "pin").first()
    if doc is None or doc.pin is None:
        raise cfg.ConfigError(f"{a.id} has no pin")
    from .functions import globs

    dirty = [r.path for r in git.dirty(spark).collect()]
    if any(re.match(globs.any_of(doc.pin.scope), p) for p in dirty):
        print("the scope is dirty", file=sys.stderr)
        return 1
    path = os.path.join(a.root, doc.file)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    report.write(path, report.bless(text, git.run("rev-parse", "HEAD").strip()))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docweave")
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *args, **kw):
        s = sub.add_parser(name, **kw)
        s.set_defaults(run=run)
        for flags, options in args:
            s.add_argument(*flags, **options)
        s.add_argument("--format", default="text", choices=["text", "rich", "simple", "json", "markdown"])

    scope = (("--namespace",), {"action": "append"})
    terminal = (("--terminal",), {"default": "done,accepted,rejected,superseded,closed"})
    command("lint", cmd_lint, (("-r", "--recursive"), {"action": "store_true"}), scope, (("--pack",), {"action": "append"}), (("--as-of",), {}))
    command("refs", cmd_refs, (("id",), {}))
    command("list", cmd_list)
    command("graph", cmd_graph)
    command("namespaces", cmd_namespaces, (("--for",), {"dest": "path"}))
    command("rules", cmd_rules, scope, (("code",), {"nargs": "?"}))
    command("status", cmd_status, (("--lineage",), {}), (("--exit-code",), {"action": "store_true"}), terminal)
    command("briefing", cmd_briefing)
    command("new", cmd_new, (("namespace_name",), {}), (("title",), {}), (("--stdout",), {"action": "store_true"}), (("--id",), {"type": int}), (("--out",), {}))
    command("init", cmd_init, (("--pack",), {"action": "append"}), (("--namespaces",), {}), (("--stdout",), {"action": "store_true"}))
    command("pack", cmd_pack, (("action",), {"choices": ["list", "show", "add", "install", "outdated", "migrate"]}), (("name",), {"nargs": "?"}))
    command("changelog", cmd_changelog, (("--check",), {"action": "store_true"}), scope, terminal)
    command("pin", cmd_pin, (("id",), {}))
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        return a.run(spark or session(), a)
    except (cfg.ConfigError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
