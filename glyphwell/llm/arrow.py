"""Small helpers around ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from glyphwell.llm.kernels import SLICE_BYTES

#: Most bytes of an Arrow batch that go through Python at once.
BATCH_BYTES = 8 * SLICE_BYTES


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut by rows so that none but a single long row is over BATCH_BYTES."""
    for batch in batches:
        n, size = batch.num_rows, batch.nbytes
        step = max(1, n * BATCH_BYTES // max(size, 1))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``f`` over the pieces of each batch; a narrow step without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            out = f(piece)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def record(schema: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    """A record batch of the given columns in the order of ``schema``."""
    arrays = [c if isinstance(c := columns[name], pa.Array) and c.type == kind else pa.array(c, type=kind) for name, kind in schema.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(schema))
