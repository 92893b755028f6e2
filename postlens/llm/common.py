"""What several of these operators share: the shared folder, checkpoints, column names and the held-out split."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may do without the setting; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="postlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows in a reliable checkpoint: a lost executor does not repeat what led to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of a narrow table that comes out of a shuffle, in a few partitions per core.

    Such tables are read several times; as many partitions as the shuffle had would only multiply the blocks that the
    next shuffles exchange. A task goes through its partitions one by one, so it needs no more memory.
    """
    return checkpointed(df.coalesce(max(16, 2 * df.sparkSession.sparkContext.defaultParallelism)))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back; later reads are pruned to their columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the first variant of it that is no column of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    name, n = wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


def fold_of(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 3. Fold 1 is held out; a null id belongs to no fold and counts as not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 3, F.lit(0))


def held_out(doc_id: Column | str) -> Column:
    return fold_of(doc_id) == 1


def texts(column: pa.Array) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def by_bytes(texts_: list[bytes | None], limit: int) -> Iterator[slice]:
    """Consecutive slices whose texts have at most ``limit`` bytes together, or a single longer text."""
    return _by_size((len(text or b"") for text in texts_), limit)


def pieces_of(column: pa.Array, limit: int = 4 << 20) -> Iterator[slice]:
    """The same slices of a string column of an Arrow batch, whose texts stay in Arrow."""
    return _by_size(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit)


def _by_size(sizes: Iterable[int], limit: int) -> Iterator[slice]:
    start = size = end = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield slice(start, i)
            start, size = i, 0
        size += n
        end = i + 1
    if start < end:
        yield slice(start, end)
