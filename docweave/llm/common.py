"""Helpers that several operators share."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of these characters alone lower-case, normalise and split alike in
#: Python's ``re`` and in the tokenizers library; any other text is given to
#: the library whole.  (ASCII without the separators 1C-1F, Latin-1 letters.)
PLAIN_TEXT = re.compile("[\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The word-level vocabulary's split of lower-cased plain text.
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes a core below which a table is dealt out.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of a few megabytes a core dealt out evenly: it may lie in one row group, which one task reads.

    By the optimizer's estimate of size, without a job; larger tables stay as they lie.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(size) < SPREAD_BYTES * cores else df


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, a null text as the empty one."""
    return spread(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col)))


def map_texts(df: DataFrame, schema: str, rows: Callable[[list, list], dict]) -> DataFrame:
    """Apply ``rows(ids, texts) -> {column: values}`` to Arrow batches of a two-column frame."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = rows(b.column(0).to_pylist(), b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(batches, schema)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    The session's own setting is read.  Only where there is none, and driver and
    executors are one process (tests), is a local folder used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/docweave-checkpoints"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, in columns."""
    return _written(df, shared_dir(df.sparkSession, what))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Intermediate tables of one run, below one shared folder that is deleted at the end."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.n = spark, shared_dir(spark, what), 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return _written(df, f"{self.root}/{self.n:03d}-{name}")

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.root)


def delete(spark: SparkSession, uri: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Schemes that Spark's connectors and pyarrow call differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def arrow_uri(uri: str) -> str:
    """The URI by which pyarrow knows a folder that Spark names by ``uri``."""
    scheme, colon, rest = uri.partition(":")
    return f"{_SCHEMES.get(scheme, scheme)}{colon}{rest}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for code that reads and writes files inside tasks."""
    return pafs.FileSystem.from_uri(arrow_uri(uri))


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, once per Python process, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@functools.lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
