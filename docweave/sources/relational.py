"""Relational tables presented as a corpus: rows are documents, foreign keys are pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DOCS, EDGES, Corpus, Namespace, shaped

#: ns -> (table, number, status, metadata columns)
NODES = {
    "REG": ("region", "r_regionkey", None, {"title": "r_name"}),
    "NAT": ("nation", "n_nationkey", None, {"title": "n_name"}),
    "CUST": ("customer", "c_custkey", None, {"title": "c_name", "segment": "c_mktsegment", "acctbal": "c_acctbal"}),
    "SUPP": ("supplier", "s_suppkey", None, {"title": "s_name", "acctbal": "s_acctbal"}),
    "PART": ("part", "p_partkey", None, {"title": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"}),
    "ORD": ("orders", "o_orderkey", "o_orderstatus", {"date": "o_orderdate", "priority": "o_orderpriority"}),
    "DOC": ("documents", "doc_id", None, {"lang": "lang", "source": "source"}),
    "PAGE": ("pages", "page_id", None, {"url": "url"}),
    "EVT": ("events", "event_id", None, {"event_type": "event_type"}),
}

#: (source ns, target ns) -> (table, source key, target key)
EDGE_KEYS = {
    ("NAT", "REG"): ("nation", "n_nationkey", "n_regionkey"),
    ("CUST", "NAT"): ("customer", "c_custkey", "c_nationkey"),
    ("SUPP", "NAT"): ("supplier", "s_suppkey", "s_nationkey"),
    ("ORD", "CUST"): ("orders", "o_orderkey", "o_custkey"),
    ("ITEM", "ORD"): ("lineitem", None, "l_orderkey"),
    ("ITEM", "PART"): ("lineitem", None, "l_partkey"),
    ("ITEM", "SUPP"): ("lineitem", None, "l_suppkey"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(ns: str, number: Column) -> Column:
    return F.concat(F.lit(f"{ns}-"), number.cast("string"))


def json_text(value: Column) -> Column:
    """A value in JSON, as the metadata map holds it."""
    text = value.cast("string")
    quoted = F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.when(value.isNotNull(), quoted)


def nodes(spark: SparkSession, sf_dir: str, ns: str, where: str | None = None) -> DataFrame:
    """Documents of a namespace, from the table behind it."""
    if ns == "ITEM":
        return items(spark, sf_dir)
    table, key, status, extra = NODES[ns]
    df = read(spark, sf_dir, table)
    if where:
        df = df.where(where)
    pairs = [F.struct(F.lit(k).alias("k"), json_text(F.col(v)).alias("v")) for k, v in extra.items()]
    metadata = F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["v"].isNotNull()))
    return df.select(
        _key(ns, F.col(key)).alias("doc_key"), _key(ns, F.col(key)).alias("id"), F.lit(ns).alias("ns"),
        F.col(key).cast("long").alias("number"), _key(ns, F.col(key)).alias("location"), F.lit(table).alias("source"),
        F.lit("source").alias("claim_kind"), (F.col(extra["title"]) if "title" in extra else F.lit(None)).cast("string").alias("title"),
        (F.col(status) if status else F.lit(None)).cast("string").alias("status"), metadata.alias("metadata"),
        (F.col("text") if ns == "DOC" else F.col("html") if ns == "PAGE" else F.lit(None)).cast("string").alias("body"),
    )


def _item_key() -> Column:
    return F.concat_ws(".", F.concat(F.lit("ITEM-"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items; their ids (order and line number) are not unique in the data."""
    return read(spark, sf_dir, "lineitem").select(
        _item_key().alias("doc_key"), _item_key().alias("id"), F.lit("ITEM").alias("ns"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("number"), _item_key().alias("location"),
        F.lit("lineitem").alias("source"), F.col("l_linestatus").alias("status"),
    )


def edges(spark: SparkSession, sf_dir: str, src: str, dst: str, kind: str = "depends_on") -> DataFrame:
    table, key, to = EDGE_KEYS[src, dst]
    df = read(spark, sf_dir, table)
    return df.select(
        (_item_key() if src == "ITEM" else _key(src, F.col(key))).alias("src_key"), F.lit(src).alias("src_ns"), F.lit(kind).alias("kind"),
        F.lit(0).alias("ord"), _key(dst, F.col(to)).alias("dst_raw"), F.lit(dst).alias("dst_ns"),
        F.col(to).cast("long").alias("dst_number"), F.lit(0).alias("line"),
    )


def corpus(
    spark: SparkSession, sf_dir: str, namespaces: dict[str, str | None], links: list[tuple[str, str]], declared: list[Namespace] | None = None
) -> Corpus:
    """A corpus of some namespaces (each with a filter or None) and the pointers between them."""
    docs = es = None
    for ns, where in namespaces.items():
        part = shaped(nodes(spark, sf_dir, ns, where), DOCS)
        docs = part if docs is None else docs.unionByName(part)
    for src, dst in links:
        part = shaped(edges(spark, sf_dir, src, dst), EDGES)
        es = part if es is None else es.unionByName(part)
    tables = {"docs": docs} | ({"edges": es} if es is not None else {})
    return Corpus(spark, tables, declared or [Namespace(ns) for ns in namespaces])
