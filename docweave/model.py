"""Entity tables of a corpus, and the shape of what rules return.

A corpus is a set of DataFrames: documents (graph nodes), edges (pointers
between them), and what is inside the documents.  A rule turns them into
findings; findings of all rules become one table of diagnostics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = (
    "doc_key string, id string, ns string, number bigint, location string, file string, source string, "
    "claim_kind string, title string, status string, body string, metadata map<string,string>, "
    "key_lines map<string,int>, parse_error string, pin struct<commit:string,scope:array<string>>"
)
EDGES = "src_key string, src_ns string, kind string, ord int, dst_raw string, dst_ns string, dst_number bigint, line int"
TOKENS = "doc_key string, ns string, number bigint, raw string, line int, col int"
HEADINGS = "doc_key string, level int, text string, norm string, line int, ord int, code boolean"
LINKS = "doc_key string, kind string, target string, path string, line int, col int"
CHECKBOXES = "doc_key string, section string, checked boolean, line int"
LIST_ITEMS = "doc_key string, section string, text string, line int"
REQUIREMENTS = "doc_key string, req_id string, status string, line int"
SCAN_HITS = "file string, ns string, number bigint, raw string, line int, col int"
FILES = "path string"
DIAGNOSTICS = (
    "channel string, severity string, code string, path string, line int, col int, message string, help string, note string"
)
#: What a rule returns: the place, what is wrong there, and optionally its own severity.
FINDINGS = "path string, line int, col int, subject string, note string, severity string"

TABLES = {
    "docs": DOCS, "edges": EDGES, "tokens": TOKENS, "headings": HEADINGS, "links": LINKS, "checkboxes": CHECKBOXES,
    "list_items": LIST_ITEMS, "requirements": REQUIREMENTS, "scan_hits": SCAN_HITS, "files": FILES,
}


@dataclass
class Namespace:
    """A declared namespace: which files it claims, which rules it binds, and their parameters."""

    name: str
    paths: list[str] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)
    owner: str | None = None
    summary: str | None = None
    linked_by: str | None = None
    params: dict[str, dict] = field(default_factory=dict)
    briefing: dict | None = None
    takes_members: bool = True


@dataclass
class Corpus:
    """The entity tables; a table that a source lacks is empty."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    namespaces: list[Namespace] = field(default_factory=list)
    root: str | None = None
    git: object | None = None
    kernel: DataFrame | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self.tables:
            self.tables[name] = self.spark.createDataFrame([], TABLES[name])
        return self.tables[name]

    def of(self, ns: str) -> DataFrame:
        """Documents of a namespace."""
        return self.docs.where(F.col("ns") == ns)

    def namespace(self, name: str) -> Namespace | None:
        return next((n for n in self.namespaces if n.name == name), None)


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """The frame with exactly the columns of a schema; those it lacks are null."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def meta(key: str) -> Column:
    """A metadata value as text; nested keys by dots (``a.b``)."""
    top, _, rest = key.partition(".")
    return F.get_json_object(F.col("metadata")[top], f"$.{rest}" if rest else "$")


def key_line(key: str) -> Column:
    """The line that anchors a metadata key, 0 if it has none."""
    return F.coalesce(F.col("key_lines")[key.partition(".")[0]], F.lit(0))


def findings(df: DataFrame, subject: Column | str, path: str = "location", line=None, col=None, note=None, severity=None) -> DataFrame:
    """A rule's rows in the common shape."""
    text = lambda x: F.lit(x) if isinstance(x, str) or x is None else x
    return df.select(
        F.col(path).alias("path"),
        F.coalesce(line if line is not None else F.lit(0), F.lit(0)).cast("int").alias("line"),
        F.coalesce(col if col is not None else F.lit(0), F.lit(0)).cast("int").alias("col"),
        text(subject).cast("string").alias("subject"),
        text(note).cast("string").alias("note"),
        text(severity).cast("string").alias("severity"),
    )


def diagnostics(found: DataFrame, code: str, severity: str, message: str, hint: str | None = None, channel: str = "rule") -> DataFrame:
    """Findings of one rule as diagnostics; ``{}`` in the message stands for the subject."""
    before, _, after = message.partition("{}")
    text = F.concat(F.lit(before), F.coalesce("subject", F.lit("")), F.lit(after)) if "{}" in message else F.lit(message)
    return found.select(
        F.lit(channel).alias("channel"),
        F.coalesce("severity", F.lit(severity)).alias("severity"),
        F.lit(code).alias("code"),
        "path",
        "line",
        "col",
        text.alias("message"),
        F.lit(hint).cast("string").alias("help"),
        "note",
    )
