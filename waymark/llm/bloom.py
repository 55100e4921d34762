"""A Bloom filter of ids, so that a join by id shuffles few of the rows that can't match.

The filter has BITS bits (16 MB) whatever it holds: that bounds its broadcast.  Some 13
million ids give one false hit in a hundred; with more ids hits get more frequent, up to
all rows.  Whoever uses it must follow with an exact join of the hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, HASHES, BUCKET = 1 << 27, 4, 32_768


def positions(key: Column) -> Column:
    """The bits of an id; a null id has none."""
    return F.when(key.isNotNull(), F.array(*(F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BITS)).cast("int") for i in range(HASHES))))


class Bloom:
    def __init__(self, ids: DataFrame, column: str) -> None:
        bits = ids.select(F.explode(positions(F.col(column).cast("long"))).alias("p"))
        parts = bits.groupBy(F.expr(f"p div {BUCKET}").alias("bucket")).agg(F.bitmap_construct_agg(F.expr(f"cast(p % {BUCKET} as bigint)")).alias("bits"))
        found = np.zeros(BITS // 8, dtype=np.uint8)
        for row in parts.toLocalIterator():
            piece = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
            found[row["bucket"] * BUCKET // 8 :][: len(piece)] = piece
        self.shared = ids.sparkSession.sparkContext.broadcast(found)

    def close(self) -> None:
        """Lets go of the broadcast; only after everything that asks it has been written."""
        self.shared.destroy()

    def hits(self, lists: pa.ListArray) -> np.ndarray:
        """Which of some lists of positions may be in the filter; null lists never are."""
        out = np.zeros(len(lists), dtype=bool)
        some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
        at = lists.flatten().to_numpy().reshape(-1, HASHES)
        out[some] = ((self.shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
        return out
