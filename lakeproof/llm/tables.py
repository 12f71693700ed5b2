"""Reading tables and cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeproof.session import ship

#: Tables written so far, with the scope they were written in.
_DIRS: list[tuple[SparkSession, str, str]] = []
_SCOPE = [""]


#: Rows of an Arrow batch of texts. Spark's own 10,000 hold tens of MB on either side of the pipe to Python, per core.
ARROW_ROWS = 1_000
#: Bytes of an Arrow batch, from which on it takes no further row: 1,000 long texts, or pairs of shingle sets, would be 64 MB.
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # nobody has chosen another size
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(64 << 20):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; only a local session may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lakeproof-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lakeproof-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _DIRS.append((spark, path, _SCOPE[-1]))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, scope: str = "") -> None:
    """Delete the tables that :func:`cut` has written for ``spark`` in a scope; their DataFrames can't be read any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for own in [x for x in _DIRS if x[0] is spark and x[2] == scope]:
        p = jvm.org.apache.hadoop.fs.Path(own[1])
        p.getFileSystem(conf).delete(p, True)
        _DIRS.remove(own)


@contextmanager
def scope(name: str) -> Iterator[None]:
    """What :func:`cut` writes inside belongs to ``name``, for :func:`release`."""
    _SCOPE.append(name)
    try:
        yield
    finally:
        _SCOPE.pop()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front where the columns of ``df`` take it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(rows, column: int | None = None, size: int = 8 << 20):
    """Slices of an Arrow batch or array of about ``size`` bytes of text in a string column; a longer text is a slice of its own.

    Python objects made of one slice at a time stay within that size, whatever the batch holds."""
    import pyarrow.compute as pc

    texts = rows if column is None else rows.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield rows.slice(at, upto - at)
        at = upto


def crc(column: Column) -> Column:
    """crc32 of a value's text, as an unsigned long."""
    return F.crc32(column.cast("string").cast("binary"))


def held_out(key: Column, parts: int) -> Column:
    """True for the rows kept out of learning: crc32 of the key's text is a multiple of ``parts``; a null key never is."""
    return F.coalesce(crc(key) % parts == 0, F.lit(False))


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """A public tokenizer file: in the folder that ``LAKEPROOF_TOKENIZERS`` names, else where the installed package has it."""
    if own := os.environ.get("LAKEPROOF_TOKENIZERS"):
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)
