"""Shared by the operators of this subpackage: words, written tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import auditspark
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(auditspark)  # workers need not have the package installed

#: White space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on the same set.
SPACE = " \t\n\x0b\x0c\r"
#: Upper-case letters that the rules fold; other alphabets stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def count_of(text: Column, characters: str) -> Column:
    """How many code points of ``text`` are among ``characters`` (null text: 0)."""
    kept = F.coalesce(text, F.lit(""))
    return (F.length(kept) - F.length(F.translate(kept, characters, ""))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and continue from the written copy.

    The copy cuts the lineage: a lost executor rereads it instead of repeating what made it.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_arrow(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` over batches small enough that very long texts fit a worker's memory."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df.mapInArrow(function, schema)


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type)
                       else pa.binary()).to_pylist()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed_sha256(pieces: DataFrame, keys: list[str], order: list[str], piece: str, joint: str) -> DataFrame:
    """``keys`` and ``sha256``, lowercase hex, of the texts ``piece`` of equal keys joined by ``joint``.

    The pieces of a key stream through one hash in ``order``; they are never put together.
    """
    kinds = dict(pieces.dtypes)
    n = len(keys)

    def run(batches):
        import hashlib

        import pyarrow as pa

        key, digest, done = None, None, []
        types = None

        def out(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*keys, "sha256"])

        for batch in batches:
            types = [*[batch.schema.field(i).type for i in range(n)], pa.string()]
            for *now, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now == key:
                    digest.update((joint + text).encode())
                    continue
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(text.encode())
            if done:
                yield out(done)
                done = []
        if key is not None:
            yield out([(*key, digest.hexdigest())])

    dealt = pieces.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, piece)
    return by_arrow(dealt, run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "sha256 string"]))
