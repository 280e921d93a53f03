"""Processes at the edge: document sources and rules that other programs supply.

A source prints one JSON envelope a line; a rule reads documents and prints
diagnostics, both as JSON lines.  Failures and timeouts become rows.
"""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DIAGNOSTICS, Corpus
from .config import Config
from .markdown import _PARSED_SQL, build, parse, parsed_batch

ENV = "DOCWEAVE"
TIMEOUT = 60
_ENVELOPE = "id string, body string, location string, depends_on array<string>, part_of array<string>, extra map<string,string>, warning string, _bad string"


def run_source(name: str, params: dict, root: str) -> tuple[list[str], str | None]:
    """The lines that sources/<name>/run prints, and the error of a failed run."""
    env = os.environ | {f"{ENV}_SOURCE_NAME": name, f"{ENV}_SOURCE_PARAMS": json.dumps(params, sort_keys=True)}
    try:
        run = subprocess.run([os.path.join(root, "sources", name, "run")], cwd=root, env=env, capture_output=True, text=True, check=False)
    except OSError as e:
        return [], str(e)
    error = f"exit status {run.returncode}: {run.stderr.strip()[-200:]}" if run.returncode else None
    return [x for x in run.stdout.split("\n") if x.strip()], error


def envelopes(lines: DataFrame) -> DataFrame:
    """JSON lines (source, value) as envelopes; ``problem`` says why a line is none."""
    reading = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    df = lines.withColumn("e", F.from_json("value", _ENVELOPE, reading)).select("source", "value", "e.*")
    warning = F.col("warning").isNotNull() & F.col("id").isNull()
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("id", "body", "location")])
    problem = F.when(F.col("_bad").isNotNull(), "no JSON").when(missing != "", F.concat(F.lit("lacks "), missing))
    return df.select(
        "source", "id", "body", "location", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"),
        F.coalesce("part_of", F.array().cast("array<string>")).alias("part_of"), F.coalesce("extra", F.create_map().cast("map<string,string>")).alias("extra"),
        F.when(warning, F.col("warning")).alias("warning"), F.when(~warning, problem).alias("problem"),
        F.get_json_object("value", "$.extra").alias("extra_json"),
    )


def parse_envelopes(good: DataFrame) -> DataFrame:
    """Envelopes as parsed rows: the body is read like a file's, its frontmatter wins over ``extra``."""

    def parsed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for r in b.to_pylist():
                extra = json.loads(r["extra_json"]) if r["extra_json"] else {}
                extra |= {k: r[k] for k in ("depends_on", "part_of") if r[k]}
                row = parse(r["location"], r["body"], extra)
                row["metadata"] = [*[(k, v) for k, v in row["metadata"] if k != "id"], ("id", json.dumps(r["id"]))]
                rows.append(row)
            yield parsed_batch(rows)

    return good.select("id", "body", "location", "depends_on", "part_of", "extra_json").mapInArrow(parsed, _PARSED_SQL)


def source_corpus(spark: SparkSession, config: Config, root: str) -> tuple[Corpus | None, DataFrame]:
    """Documents of all configured sources, and messages: warnings, failures, too few documents."""
    rows, errors, floors = [], [], []
    for name, params in config.sources.items():
        params = dict(params)
        floors.append((name, params.pop("expect_min", 1)))
        lines, error = run_source(name, params, root)
        rows += [(name, x) for x in lines]
        if error:
            errors.append((name, error))
    env = envelopes(spark.createDataFrame(rows, "source string, value string"))
    return build_sources(spark, env, config, errors, floors)


def build_sources(spark, env: DataFrame, config: Config, errors: list, floors: list) -> tuple[Corpus | None, DataFrame]:
    env = env.persist()
    good = env.where("problem IS NULL AND warning IS NULL")
    corpus = build(spark, parse_envelopes(good), config, "source")
    counts = good.groupBy("source").agg(F.count("*").alias("n"))
    floor = spark.createDataFrame(floors, "source string, least long")
    few = floor.join(counts, "source", "left").where("least > 0 AND coalesce(n, 0) < least")
    failed = spark.createDataFrame(errors, "source string, what string")

    def message(df: DataFrame, severity: str, code: str, text) -> DataFrame:
        return df.select(F.lit("kernel").alias("channel"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("source").alias("path"), F.lit(0).alias("line"), F.lit(0).alias("col"), text.alias("message"), F.lit(None).cast("string").alias("help"), F.lit(None).cast("string").alias("note"))

    messages = (
        message(env.where("warning IS NOT NULL"), "warning", "src.warning", F.col("warning"))
        .unionByName(message(env.where("problem IS NOT NULL"), "error", "src.envelope", F.col("problem")))
        .unionByName(message(failed, "error", "src.runtime-error", F.col("what")))
        .unionByName(message(few, "warning", "src.too-few-documents", F.concat(F.coalesce("n", F.lit(0)), F.lit(" of at least "), F.col("least"))))
    )
    return corpus, messages


def discover_rules(root: str) -> dict[str, str]:
    """code -> program for every rules/<ns>/<name>/run."""
    out, base = {}, os.path.join(root, "rules")
    for ns in sorted(os.listdir(base)) if os.path.isdir(base) else ():
        for name in sorted(os.listdir(os.path.join(base, ns))):
            run = os.path.join(base, ns, name, "run")
            if os.path.isfile(run) and os.access(run, os.X_OK):
                out[f"{ns.lower()}.{name}"] = run
    return out


def run_rule(c: Corpus, ns: str, code: str, program: str, params: dict | None = None) -> DataFrame:
    """Diagnostics of an external rule: one process gets all documents of a namespace, so it runs in one task."""
    params = dict(params or {})
    timeout = params.pop("timeout_sec", TIMEOUT)
    root = c.root or "."
    edges = c.edges.where(F.col("kind").isin("depends_on", "part_of")).groupBy("src_key").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "depends_on", F.struct("ord", "dst_raw")))).alias("d"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "part_of", F.struct("ord", "dst_raw")))).alias("p"),
    )
    docs = c.of(ns).join(edges, F.col("doc_key") == F.col("src_key"), "left").select(
        "id", "ns", "number", "location", "file", "body", F.to_json("metadata").alias("metadata"), F.col("d.dst_raw").alias("depends_on"), F.col("p.dst_raw").alias("part_of")
    )

    def call(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, lines = {}, []
        with tempfile.TemporaryDirectory() as temp:
            for batch in it:
                for r in batch.to_dict("records"):
                    if isinstance(r["file"], str):
                        path = os.path.join(root, r["file"])
                    else:  # a document of a source has no file: its body becomes one
                        path = os.path.join(temp, f"{len(known)}.md")
                        with open(path, "w", encoding="utf-8") as f:
                            f.write(r["body"] or "")
                    known[path] = r["location"]
                    number = None if pd.isna(r["number"]) else int(r["number"])
                    data = {k: json.loads(v) for k, v in json.loads(r["metadata"] or "{}").items() if v is not None}
                    listed = lambda x: [] if x is None else list(x)
                    lines.append(json.dumps({"path": path, "context": {"id": r["id"], "namespace": r["ns"], "number": number, "location": r["location"], "depends_on": listed(r["depends_on"]), "part_of": listed(r["part_of"]), "metadata": data}}, sort_keys=True))
            yield pd.DataFrame(_call(program, lines, known, code, params, timeout, root), columns=["channel", "severity", "code", "path", "line", "col", "message", "help", "note"])

    return docs.coalesce(1).mapInPandas(call, DIAGNOSTICS)


def _call(program: str, lines: list[str], known: dict, code: str, params: dict, timeout: float, root: str) -> list[tuple]:
    if not lines:
        return []
    failed = lambda what: [("kernel", "error", "ext.runtime-error", program, 0, 0, f"{code}: {what}", None, None)]
    try:
        run = subprocess.run([program], input="\n".join(lines) + "\n", cwd=root, env=os.environ | {f"{ENV}_RULE_PARAMS": json.dumps(params, sort_keys=True)}, capture_output=True, text=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired:
        return failed(f"no answer in {timeout} s")
    except OSError as e:
        return failed(str(e))
    if run.returncode:
        return failed(f"exit status {run.returncode}")
    out = []
    for line in filter(str.strip, run.stdout.split("\n")):
        try:
            d = json.loads(line)
            if d["path"] not in known:
                raise ValueError("unknown path")
            severity = d.get("severity", "error")
            out.append(("rule", severity if severity in ("error", "warning") else "error", code, known[d["path"]], int(d.get("line") or 0), int(d.get("col") or 0), str(d["message"]), None, None))
        except (ValueError, KeyError, TypeError) as e:
            out += failed(f"a line of output is not understood: {e}")
    return out


def cached_issues(spark: SparkSession, path: str, as_of: str, stale_hours: int = 24, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Envelopes of an issue cache (JSON lines with number, title, state, body, fetched_at), and a warning if it is stale."""
    raw = spark.read.schema("number long, title string, state string, body string, fetched_at string, labels array<string>").json(path)
    docs = raw.orderBy("number").limit(limit).select(
        F.lit("issues").alias("source"), F.to_json(F.struct(F.concat(F.lit("GH-"), F.col("number")).alias("id"), F.coalesce("body", F.lit("")).alias("body"), F.concat(F.lit("issues/"), F.col("number")).alias("location"), F.struct("title", F.lower("state").alias("status"), "labels").alias("extra"))).alias("value")
    )
    age = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(F.max(F.to_timestamp("fetched_at")))
    stale = raw.agg((age / 3600).alias("hours")).where(F.col("hours") > stale_hours)
    warning = stale.select(F.lit("issues").alias("source"), F.to_json(F.struct(F.concat(F.lit("the cache is "), F.round("hours").cast("long"), F.lit(" hours old")).alias("warning"))).alias("value"))
    return docs, warning
