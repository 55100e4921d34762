"""Session plumbing shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..checkpoints import reliable, write_out  # noqa: F401
from ..workers import ship
from .textops import trim

BATCH_ROWS = 4096
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches handed to Python workers by rows and by bytes.

    Documents may be very long, so the default of 10,000 rows a batch is no
    memory bound at all.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def append_columns(df: DataFrame, columns: list[tuple[str, str]], of: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """df with further columns (name, type) that a function makes of each Arrow batch.

    The other columns pass through, so a decision on a row needs no join by its id.
    """
    taken = {c.lower() for c in df.columns}
    if clash := [name for name, _ in columns if name.lower() in taken]:
        raise ValueError(f"columns exist already: {clash}")
    schema = StructType(list(df.schema.fields))
    for name, kind in columns:
        schema = schema.add(name, kind)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *of(b)], [*b.schema.names, *(name for name, _ in columns)])
        trim()

    return df.mapInArrow(run, schema)


def cut(df: DataFrame, rows_per_file: int = 100_000) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, in as few files as its
    rows need.

    The rows are held in the cache until they have been counted and written; a lost
    executor's share of them is computed again.  ``reliable`` keeps partitions as they are.
    """
    held = df.persist()
    files = -(-held.count() // rows_per_file)
    done = reliable(held.coalesce(max(1, files)))
    held.unpersist()
    return done
