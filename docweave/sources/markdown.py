"""Markdown files as entity tables.

Files are read with Spark's binaryFile source, parsed once on the executors
into one nested row each, and every entity table is a projection of that.
Nothing but the configuration and its patterns is held on the driver.
"""

from __future__ import annotations

import functools
import json
import os
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, text as tx
from ..model import DOCS, Corpus, Namespace, shaped
from .config import Config, ZERO_CONFIG

#: Folders that are left out unless a namespace claims files inside.
DEFAULT_IGNORED = ("log", "logs", "tmp", "target", "dist")
NEVER = "node_modules"

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_BOX = re.compile(r"^\s*(?:[-*+]|[0-9]+[.)])[ \t]+\[([ xX])\](?:[ \t]|$)")
_ITEM = re.compile(r"^\s*(?:[-*+]|[0-9]+[.)])[ \t]+(.*)$")
_LINK = re.compile(r"(!?)\[(?:[^\[\]\\]|\\.|\[[^\[\]]*\])*\]\(\s*(?:<([^<>\n]*)>|([^\s()]*(?:\([^\s()]*\)[^\s()]*)*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_IMPORT = re.compile(r"^@([^\s@]+)[ \t]*$")
_CODE = re.compile(r"(?<!`)(`+)(?!`)((?:(?!\n[ \t]*\n).)+?)(?<!`)\1(?!`)", re.DOTALL)
_STRIKE = re.compile(r"~~(?=\S)((?:(?!\n[ \t]*\n).)+?)(?<=\S)~~", re.DOTALL)
_KEY = re.compile(r"^([A-Za-z_][\w.-]*)[ \t]*:")
_REQUIREMENT = re.compile(r"^([A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*-[0-9]+(?:\.[0-9]+)*)\b")
_STATUS = re.compile(r"^[ \t]*(?:[-*+][ \t]+)?\**Status:?\**:?[ \t]*(.+?)[ \t]*$", re.IGNORECASE)


@functools.cache
def _yaml_loader():
    """yaml and a safe loader that leaves dates as strings; None where yaml is not installed."""
    try:
        import yaml
    except ImportError:
        return None

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {
        k: [r for r in v if r[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()
    }
    return yaml, Loader


def _load_yaml(block: str):
    """The block as a map; dates stay strings."""
    if _yaml_loader() is None:
        return _plain_yaml(block)
    yaml, loader = _yaml_loader()
    return yaml.load(block, loader)  # noqa: S506  a safe loader


def _plain_yaml(block: str) -> dict:
    """Scalars, flow and block lists, and one level of nested maps."""

    def scalar(s: str):
        s = s.strip()
        if s[:1] == "[" and s[-1:] == "]":
            return [scalar(x) for x in s[1:-1].split(",") if x.strip()]
        if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
            return s[1:-1]
        return {"": None, "true": True, "false": False, "null": None, "~": None}.get(s, int(s) if re.fullmatch(r"-?[0-9]+", s) else s)

    out: dict = {}
    key = None
    for line in block.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.match(r"^([\w.-]+):(?:[ \t]+(.*)|[ \t]*)$", line):
            key = m[1]
            out[key] = scalar(m[2] or "")
        elif key and (m := re.match(r"^\s*-[ \t]+(.*)$", line)):
            out[key] = [*(out[key] or []), scalar(m[1])]
        elif key and (m := re.match(r"^\s+([\w.-]+):[ \t]*(.*)$", line)):
            out[key] = {**(out[key] or {}), m[1]: scalar(m[2])}
        else:
            raise ValueError(f"not understood: {line.strip()}")
    return out


def frontmatter(text: str) -> tuple[dict, dict, str, int, str | None]:
    """(metadata, key lines, body, lines before the body, error)."""
    lines = text.split("\n")
    if lines[0].rstrip("\r") != "---":
        return {}, {}, text, 0, None
    end = next((i for i in range(1, len(lines)) if lines[i].rstrip(" \t\r") == "---"), None)
    if end is None:
        near = any(x.rstrip(" \t\r") == "..." for x in lines[1:])
        return {}, {}, "", len(lines), "closed by ... instead of ---" if near else "not closed"
    keys = {m[1]: i + 1 for i in range(1, end) if (m := _KEY.match(lines[i]))}
    body = "\n".join(lines[end + 1 :])
    try:
        data = _load_yaml("\n".join(lines[1:end])) or {}
        if not isinstance(data, dict):
            raise ValueError("not a map")
    except Exception as e:  # the parser's own errors are of many kinds; each becomes a row
        return {}, keys, body, end + 1, str(e).split("\n")[0] or type(e).__name__
    return {str(k): v for k, v in data.items()}, keys, body, end + 1, None


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def rendered(text: str) -> str:
    """A heading without code, emphasis and link marks."""
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"`+([^`]*)`+", r"\1", text)
    text = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    return re.sub(r"(?<![\w*])([*_])(?=\S)(.+?)(?<=\S)\1(?![\w*])", r"\2", text).strip()


def scan_body(body: str, offset: int) -> dict:
    """What is inside a body; lines count from the top of the file."""
    headings, boxes, items, links, reqs = [], [], [], [], []
    section, fence, prose = "", None, []
    commands: set[int] = set()
    lines = [x.rstrip("\r") for x in body.split("\n")]
    for i, line in enumerate(lines):
        if (m := _FENCE.match(line)) and (fence is None or (line.strip()[:1] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]))):
            if fence is None:
                commands.add(len(headings) - 1)
            fence = m[1] if fence is None else None
            prose.append("")
            continue
        prose.append("" if fence is not None else line)
        if fence is not None:
            continue
        if m := _HEADING.match(line):
            text = rendered(m[2] or "")
            section = tx.norm_heading(text)
            headings.append([len(m[1]), text, section, offset + i + 1])
            if len(m[1]) == 3 and (r := _REQUIREMENT.match(text)):
                reqs.append([r[1], None, offset + i + 1])
            continue
        if reqs and reqs[-1][1] is None and (m := _STATUS.match(line)) and headings and headings[-1][3] == reqs[-1][2]:
            reqs[-1][1] = m[1]
        if m := _BOX.match(line):
            boxes.append((section, m[1] in "xX", offset + i + 1))
        if m := _ITEM.match(line):
            items.append((section, m[1], offset + i + 1))
        if m := _IMPORT.match(line):
            links.append(("import", m[1], offset + i + 1, 1))
        if "`" in line:
            commands.add(len(headings) - 1)
    text = "\n".join(prose)
    plain = _CODE.sub(_blank, text) if "`" in text else text
    for m in _LINK.finditer(plain) if "](" in plain else ():
        row = text.count("\n", 0, m.start())
        col = m.start() - (text.rfind("\n", 0, m.start()) + 1) + 1
        links.append(("image" if m[1] else "link", m[2] if m[2] is not None else m[3], offset + row + 1, col))
    return {
        "headings": [(*h, k + 1, k in commands) for k, h in enumerate(headings)],
        "checkboxes": boxes, "list_items": items, "links": links, "requirements": [tuple(r) for r in reqs],
        "prose": _STRIKE.sub(_blank, plain) if "~~" in plain else plain,
    }


def link_path(location: str, target: str) -> str | None:
    """The file a link names, relative to the root; none for external, absolute and pure fragment links."""
    target = target.split("#", 1)[0].split("?", 1)[0]
    if not target or target.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", target):
        return None
    target = re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), target)
    return posixpath.normpath(posixpath.join(posixpath.dirname(location), target))


_STRUCT = pa.struct
_PARSED = pa.schema([
    ("location", pa.string()), ("readable", pa.bool_()), ("metadata", pa.map_(pa.string(), pa.string())), ("key_lines", pa.map_(pa.string(), pa.int32())),
    ("parse_error", pa.string()), ("body", pa.string()), ("prose", pa.string()), ("offset", pa.int32()),
    ("headings", pa.list_(_STRUCT([("level", pa.int32()), ("text", pa.string()), ("norm", pa.string()), ("line", pa.int32()), ("ord", pa.int32()), ("code", pa.bool_())]))),
    ("checkboxes", pa.list_(_STRUCT([("section", pa.string()), ("checked", pa.bool_()), ("line", pa.int32())]))),
    ("list_items", pa.list_(_STRUCT([("section", pa.string()), ("text", pa.string()), ("line", pa.int32())]))),
    ("links", pa.list_(_STRUCT([("kind", pa.string()), ("target", pa.string()), ("path", pa.string()), ("line", pa.int32()), ("col", pa.int32())]))),
    ("requirements", pa.list_(_STRUCT([("req_id", pa.string()), ("status", pa.string()), ("line", pa.int32())]))),
])
_PARSED_SQL = (
    "location string, readable boolean, metadata map<string,string>, key_lines map<string,int>, parse_error string, body string, prose string, offset int, "
    "headings array<struct<level:int,text:string,norm:string,line:int,ord:int,code:boolean>>, checkboxes array<struct<section:string,checked:boolean,line:int>>, "
    "list_items array<struct<section:string,text:string,line:int>>, links array<struct<kind:string,target:string,path:string,line:int,col:int>>, "
    "requirements array<struct<req_id:string,status:string,line:int>>"
)


def parse(location: str, text: str | None, extra: dict | None = None) -> dict:
    """One file or envelope as a row of the parsed table."""
    if text is None:
        return {"location": location, "readable": False, "metadata": [], "key_lines": [], "parse_error": None, "body": None, "prose": "", "offset": 0, **{k: [] for k in ("headings", "checkboxes", "list_items", "links", "requirements")}}
    data, keys, body, offset, error = frontmatter(text)
    found = scan_body(body, offset)
    dicts = lambda name, fields: [dict(zip(fields, x)) for x in found[name]]
    both = {**(extra or {}), **data}  # frontmatter wins
    return {
        "location": location, "readable": True, "metadata": [(k, json.dumps(v, ensure_ascii=False, default=str)) for k, v in both.items()],
        "key_lines": list(keys.items()), "parse_error": error, "body": body, "prose": found["prose"], "offset": offset,
        "headings": dicts("headings", ("level", "text", "norm", "line", "ord", "code")), "checkboxes": dicts("checkboxes", ("section", "checked", "line")),
        "list_items": dicts("list_items", ("section", "text", "line")),
        "links": [{"kind": k, "target": t, "path": link_path(location, t), "line": ln, "col": col} for k, t, ln, col in found["links"]],
        "requirements": dicts("requirements", ("req_id", "status", "line")),
    }


def parsed_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in _PARSED], schema=_PARSED)


def parse_files(files: DataFrame) -> DataFrame:
    """(location, content) -> parsed rows; bytes that are no UTF-8 make an unreadable row."""

    def parsed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for location, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    text = None if content is None else content.decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = None
                rows.append(parse(location, text))
            yield parsed_batch(rows)

    return files.select("location", "content").mapInArrow(parsed, _PARSED_SQL)


def read_files(spark: SparkSession, root: str, suffix: str | None = None) -> DataFrame:
    """location (relative to the root) and content of all files below a root."""
    local = "://" not in root
    if local and not os.path.isdir(root):
        raise FileNotFoundError(root)
    base = os.path.abspath(root) if local else root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    df = reader.load(f"file://{base}" if local else base)
    prefix = "file:" + base + "/" if local else base + "/"
    location = F.regexp_replace(F.col("path"), "^file:/+", "file:/") if local else F.col("path")
    df = df.select(location.substr(F.lit(len(prefix) + 1), F.length(location)).alias("location"), "content")
    if local:  # links to folders are not followed
        linked = [os.path.relpath(os.path.join(d, x), base) for d, names, files in os.walk(base) for x in (*names, *files) if os.path.islink(os.path.join(d, x))]
        for x in linked:
            df = df.where(~((F.col("location") == x) | F.col("location").startswith(x + "/")))
    return df


def kept(config: Config):
    """The predicate of files that are not ignored; a claim inside an ignored tree exempts what it matches."""
    at = F.col("location")
    default = at.rlike(r"(^|/)\.[^/]+(/|$)") | at.rlike(rf"(^|/)(?:{'|'.join(DEFAULT_IGNORED)})/")
    own = at.rlike(globs.any_of(config.ignore_patterns)) if config.ignore_patterns else F.lit(False)
    claimed = at.rlike(globs.any_of([g for n in config.namespaces for g in n.paths]))
    return ~at.rlike(rf"(^|/){NEVER}/") & (~(default | own) | claimed)


def _text(key: str):
    return F.get_json_object(F.col("metadata")[key], "$")


def build(spark: SparkSession, parsed: DataFrame, config: Config, claim: str = "file", files: DataFrame | None = None, declared_edges: DataFrame | None = None) -> Corpus:
    """A corpus from parsed rows: claims, documents, edges and what is inside them."""
    names = config.names()
    claims = F.array_compact(F.array(*[F.when(F.col("location").rlike(globs.any_of(n.paths)), F.lit(n.name)) for n in config.namespaces if n.paths]).cast("array<string>"))
    df = parsed.withColumn("raw_id", _text("id"))
    df = df.withColumns({"id_ns": tx.ns_of(F.col("raw_id")), "number": tx.number_of(F.col("raw_id")), "by_path": claims if claim == "file" else F.array().cast("array<string>")})
    by_id = F.col("id_ns").isNotNull()
    conflict = ~by_id & (F.size("by_path") > 1)
    df = df.withColumns({
        "ns": F.when(by_id, F.col("id_ns")).when(F.size("by_path") == 1, F.element_at("by_path", 1)),
        "claim_kind": F.when(F.lit(claim == "source"), "source").when(by_id, "id").when(F.size("by_path") == 1, "path"),
        "conflict": conflict,
    })
    df = df.unpersist().persist()  # files may have changed since an earlier run over the same folder
    docs = df.where("ns IS NOT NULL AND readable AND NOT conflict")
    inside = docs.select(F.col("location").alias("doc_key"), "ns", "metadata", "key_lines", "headings", "checkboxes", "list_items", "links", "requirements", "prose", "offset")

    def exploded(name: str, *fields: str) -> DataFrame:
        return inside.select("doc_key", F.explode(name).alias("x")).select("doc_key", *[f"x.{f}" for f in fields])

    table = docs.select(
        F.col("location").alias("doc_key"), F.col("raw_id").alias("id"), "ns", "number", "location",
        (F.col("location") if claim == "file" else F.lit(None)).cast("string").alias("file"), F.lit(claim).alias("source"), "claim_kind",
        F.coalesce(_text("title"), F.try_element_at(F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"]), F.lit(1))).alias("title"),
        _text("status").alias("status"), "body", "metadata", "key_lines", "parse_error",
        F.from_json(F.col("metadata")["pin"], "struct<commit:string,scope:array<string>>").alias("pin"),
    )
    edges = None
    for kind in ("depends_on", "part_of", "superseded_by", "supersedes"):
        raw = F.col("metadata")[kind]
        listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull() & (raw != "null"), F.array(F.get_json_object(raw, "$")))
        part = inside.select(F.col("doc_key").alias("src_key"), F.col("ns").alias("src_ns"), F.lit(kind).alias("kind"), F.coalesce(F.col("key_lines")[kind], F.lit(0)).alias("line"), F.posexplode(listed).alias("ord", "dst_raw"))
        edges = part if edges is None else edges.unionByName(part)
    edges = edges.withColumns({"dst_ns": tx.ns_of(F.col("dst_raw")), "dst_number": tx.number_of(F.col("dst_raw"))})

    used = [r.ns for r in table.where("ns IS NOT NULL").select("ns").distinct().collect()]  # namespaces, not documents
    tables = {
        "docs": shaped(table, DOCS), "edges": edges,
        "headings": exploded("headings", "level", "text", "norm", "line", "ord", "code"), "checkboxes": exploded("checkboxes", "section", "checked", "line"),
        "list_items": exploded("list_items", "section", "text", "line"), "links": exploded("links", "kind", "target", "path", "line", "col"),
        "requirements": exploded("requirements", "req_id", "status", "line"),
        "tokens": tokens(inside.select("doc_key", "prose", "offset"), sorted({*names, *used})),
    }
    if files is not None:
        tables["files"] = files
    corpus = Corpus(spark, tables, config.namespaces)
    corpus.tables["_parsed"] = df
    return corpus


def tokens(prose: DataFrame, prefixes: list[str]) -> DataFrame:
    """Mentions of ids in text that code spans and strike-through do not hide; lines and columns count from 1."""
    pattern = tx.token_pattern(prefixes)

    def found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx = re.compile(pattern)
        for b in it:
            rows = []
            for key, text, offset in zip(*(b.column(i).to_pylist() for i in range(3))):
                if "-" not in text:
                    continue
                for i, line in enumerate(text.split("\n")):
                    if "-" in line:
                        rows += [(key, m[1], int(m[2]), m[0], offset + i + 1, m.start() + 1) for m in rx.finditer(line)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_key", "ns", "number", "raw", "line", "col"])

    return prose.mapInArrow(found, "doc_key string, ns string, number bigint, raw string, line int, col int")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path of every file below a root; Spark's readers pass over empty files, so local ones are added."""
    paths = read_files(spark, root).select(F.col("location").alias("path"))
    if "://" in root:
        return paths
    base = os.path.abspath(root)
    full = [os.path.join(d, x) for d, _, files in os.walk(base) for x in files]
    empty = [(os.path.relpath(x, base),) for x in full if not os.path.islink(x) and os.path.getsize(x) == 0]
    return paths.unionByName(spark.createDataFrame(empty, "path string")) if empty else paths


def ingest(spark: SparkSession, root: str, config: Config) -> Corpus:
    """A corpus of the markdown files below a root."""
    parsed = parse_files(read_files(spark, root, ".md").where(kept(config)))
    corpus = build(spark, parsed, config, "file", listed(spark, root))
    corpus.root = root
    if config.zero or not config.namespaces:
        used = [r.ns for r in corpus.docs.select("ns").distinct().collect()]
        corpus.namespaces = [Namespace(ns, rules=list(ZERO_CONFIG)) for ns in sorted(used)]
    return corpus
