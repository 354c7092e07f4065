"""What the operators for training data share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.plans.durable import shared_folder

#: Rows handed to Python are cut into pieces of about so many characters, whatever the length of the texts.
PIECE_CHARS = 4_000_000


def importable(spark: SparkSession) -> None:
    """Let the Python workers of a session find this library where the driver found it (a cluster ships it instead)."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        known["PYTHONPATH"] = ":".join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> Column:
    """A 128-bit key of a row by its content, as ids may be null or repeated: the columns with their nulls, in order."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat(*parts)))


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder on the storage that all executors share."""
    return f"{shared_folder(spark)}-{kind}"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, as Python tasks open it (local, HDFS, S3, GCS)."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def unique_name(kind: str, partition: int) -> str:
    """No two attempts of a task share a file; only files of attempts that succeeded are ever named in an index."""
    return f"{kind}-{partition:06d}-{uuid.uuid4().hex}"


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", chars: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that memory follows the longest text and not the row count."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        first = used = 0
        for row, size in enumerate(sizes):
            if used and used + (size or 0) > chars:
                yield batch.slice(first, row - first)
                first, used = row, 0
            used += size or 0
        if first < batch.num_rows:
            yield batch.slice(first)


def sorted_set(values: np.ndarray) -> np.ndarray:
    """Each value once, in order; for millions of values several times faster than ``np.unique``."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[:len(values)]]


_LETTERS: dict[str, re.Pattern[str]] = {}


def letters(text: str) -> bool:
    """Whether the text has any letter."""
    if "any" not in _LETTERS:
        _LETTERS["any"] = re.compile(r"[^\W\d_]")
    return _LETTERS["any"].search(text) is not None
