"""WARC records in a content-addressed archive.

An archive is two Parquet tables below one folder:

``payloads``  each distinct payload once, under its SHA-256 and length
``headers``   one row a record: the exact WARC header and HTTP head bytes,
              the payload's key, and the record's place

Equal payloads are found by SHA-256; length and SHA-1 of all members must
agree as well (else the write fails), and on reading the stored bytes are
hashed again and must give the key they are stored under.  ``records`` puts
the original record bytes together by joining the two tables, and ``read``
knows nothing but those bytes: it parses every record, hashes the payload that
stands in a response, and finds what a revisit refers to by its record id.
Both tables are bucketed by SHA-256, so in the session that wrote them their
join moves no payload again.

Of the records with equal payloads that with the largest page_id is the
response, the others are revisits that refer to it.  Payload bytes are
shuffled once, and only to be stored; digests and sizes decide all else.

Defined results: a null html is an empty payload; a null url is an empty
target; a null page_id is below every number, and is the response only if all
records of the payload have none; rows that repeat the largest page_id of a
payload are all responses, with ids of their own and one stored payload; other
columns, whatever their names, are not looked at; an empty table gives an
archive without records.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex40: Column) -> Column:
    """Base32 of a SHA-1 in hex: every 5 hex digits are 4 characters."""
    chars = []
    for i in range(8):
        bits = F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int")
        chars += [F.lit(_BASE32).substr(F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def _payload(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("sha256"))


def _uuid(page_id: Column, url: Column, nth: Column) -> Column:
    """A record's id; ``nth`` tells rows apart that are equal in page_id and url."""
    h = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("-")), nth.cast("string"), url))
    cut = [h.substr(F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write(pages: DataFrame, root: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write an archive of all pages below ``root``."""
    held = _payload(pages)
    digests = {"sha1": F.sha1("payload"), "n": F.length("payload").cast("long"), "nth": F.monotonically_increasing_id()}
    keyed = written(held.withColumns(digests).drop("payload"), "warc-keys")
    best = F.max(F.struct("page_id", "url", "nth"))
    groups = keyed.groupBy("sha256").agg(
        best.alias("best"), F.min(F.struct("sha1", "n")).alias("low"), F.max(F.struct("sha1", "n")).alias("high")
    )
    same = F.when(F.col("low") == F.col("high"), F.col("best")).otherwise(
        F.raise_error(F.lit("two payloads share a SHA-256 and differ"))
    )
    groups = groups.select("sha256", same.alias("best"))

    # copies fall together before the shuffle, so a payload that many pages have is no hot key
    stored = held.select("sha256", "payload").dropDuplicates(["sha256"])
    _save(stored.select("sha256", F.length("payload").cast("long").alias("n"), "payload"), root, "payloads")

    best_id, best_url = F.col("best.page_id"), F.col("best.url")
    clean = lambda url: F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", " ")
    responds = F.col("page_id").eqNullSafe(best_id)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.col("n").cast("string"),
        F.lit(_CRLF * 2),
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    block = F.length("http") + F.when(responds, F.col("n")).otherwise(0)
    header = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "),
        F.when(responds, F.lit("response")).otherwise(F.lit("revisit")),
        F.lit(_CRLF),
        line("WARC-Record-ID", _uuid(F.col("page_id"), clean(F.col("url")), F.col("nth"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(responds, F.lit("")).otherwise(
            F.concat(
                line("WARC-Refers-To", _uuid(best_id, clean(best_url), F.col("best.nth"))),
                line("WARC-Refers-To-Target-URI", clean(best_url)),
                line("WARC-Profile", F.lit(REVISIT_PROFILE)),
            )
        ),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(_CRLF),
    )
    heads = keyed.join(groups, "sha256").withColumn("http", http)
    heads = heads.select("page_id", "sha256", responds.alias("responds"), header.cast("binary").alias("header"), F.col("http").cast("binary").alias("http"))
    _save(heads, root, "headers")


def _table(root: str, name: str) -> str:
    return f"warc_{hashlib.md5(root.encode()).hexdigest()[:16]}_{name}"


def _save(df: DataFrame, root: str, name: str) -> None:
    """Write a table in buckets by SHA-256, as many as a shuffle has partitions, so each is one file."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.write.format("parquet").bucketBy(n, "sha256").sortBy("sha256")
    out.option("path", f"{root}/{name}").saveAsTable(_table(root, name))


def _load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table; in the session that wrote it, with its buckets."""
    known = _table(root, name)
    return spark.table(known) if spark.catalog.tableExists(known) else spark.read.parquet(f"{root}/{name}")


def forget(spark: SparkSession, root: str) -> None:
    """Drop the tables' names from the session's catalogue; the files stay."""
    for name in ("payloads", "headers"):
        spark.sql(f"DROP TABLE IF EXISTS {_table(root, name)}")


def payloads(spark: SparkSession, root: str) -> DataFrame:
    """sha256, payload; bytes that do not give their key fail the read."""
    df = _load(spark, root, "payloads")
    good = F.when((F.sha2("payload", 256) == F.col("sha256")) & (F.length("payload") == F.col("n")), F.col("payload"))
    return df.select("sha256", F.coalesce(good, F.raise_error(F.lit("a stored payload is damaged"))).alias("payload"))


def headers(spark: SparkSession, root: str) -> DataFrame:
    """page_id, sha256, whether the record is a response, and its WARC header and HTTP head."""
    return _load(spark, root, "headers")


def records(spark: SparkSession, root: str) -> DataFrame:
    """page_id and the exact bytes of every record."""
    heads, end = headers(spark, root), F.lit(_CRLF * 2).cast("binary")
    response = heads.where("responds").join(payloads(spark, root), "sha256")
    revisit = heads.where("NOT responds")
    return response.select("page_id", F.concat("header", "http", "payload", end).alias("record")).unionByName(
        revisit.select("page_id", F.concat("header", "http", end).alias("record"))
    )


def parsed(recs: DataFrame) -> DataFrame:
    """What each record says (type, ids, digest, sizes), and the size and digest of the payload that stands in it."""
    blank = _CRLF * 2
    df = recs.withColumn("chars", F.decode("record", "ISO-8859-1"))  # a character a byte
    df = df.withColumn("block_at", F.instr("chars", blank) + 4)
    df = df.withColumn("payload_at", F.call_function("locate", F.lit(blank), F.col("chars"), F.col("block_at")) + 4)
    head = F.substring(F.col("chars"), F.lit(1), F.col("payload_at") - 1)
    df = df.select("page_id", "record", "block_at", "payload_at", head.alias("head"))
    field = lambda name, k: F.get(F.regexp_extract_all("head", F.lit(rf"(?m)^{name}: ([^\r\n]*)\r?$"), F.lit(1)), F.lit(k))
    df = df.withColumns({
        "record_type": field("WARC-Type", 0), "record_id": field("WARC-Record-ID", 0), "to_id": field("WARC-Refers-To", 0),
        "said_digest": F.regexp_replace(field("WARC-Payload-Digest", 0), "^sha1:", ""),
        "block_bytes": field("Content-Length", 0).cast("long"), "said_bytes": field("Content-Length", 1).cast("long"),
    })
    n = F.col("block_bytes") - (F.col("payload_at") - F.col("block_at"))
    payload = F.substring(F.col("record"), F.col("payload_at"), n.cast("int"))
    whole = F.length("record") == F.col("block_at") - 1 + F.col("block_bytes") + 4
    df = df.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("a record has not the length that it says")).cast("boolean")))
    return df.select(
        "page_id", "record_type", "record_id", "to_id", "said_digest", "said_bytes",
        F.length(payload).cast("long").alias("payload_bytes"), base32(F.sha1(payload)).alias("payload_digest"),
    )


def read(spark: SparkSession, root: str) -> DataFrame:
    """One row a record: size and digest of the full payload are those of the bytes in the archive."""
    facts = written(parsed(records(spark, root)), "warc-facts")
    checked = F.when(
        (F.col("said_digest") == F.col("payload_digest")) & (F.col("said_bytes") == F.col("payload_bytes")), F.col("payload_digest")
    )
    bad = F.raise_error(F.lit("a header's digest or length is not the payload's"))
    full = facts.where("record_type = 'response'").withColumn("payload_digest", F.coalesce(checked, bad))
    to = full.select(F.col("record_id").alias("to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    said = facts.where("record_type = 'revisit'").select("page_id", "to_id", "said_digest", "said_bytes")
    revisit = said.join(to, "to_id", "left").withColumn("payload_digest", F.coalesce(checked, bad))
    columns = ["page_id", "payload_bytes", "payload_digest"]
    response = full.select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return response.unionByName(revisit.select(*columns, F.lit("revisit").alias("record_type"), F.col("refers_to").cast("long")))


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    root = shared_dir(spark, "warc")
    write(pages, root)
    found = read(spark, root)
    forget(spark, root)
    return found


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS response_id, sha1(html) AS hex FROM p GROUP BY html),
d AS (
  SELECT html, response_id, array_to_string(list_transform(range(0, 32), lambda j:
    substr('{_BASE32}', ((('0x' || substr(hex, (5 * (j // 4) + 1)::INT, 5))::INT >> ((3 - j % 4) * 5)::INT) & 31) + 1, 1)), '') AS digest
  FROM g
)
SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM response_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM response_id THEN response_id END AS refers_to
FROM p JOIN d ON p.html = d.html
"""
