"""What the operators of this subpackage share: scratch tables, holdout folds, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.plans.scratch import materialize, partitions_for, scratch_path, shared_dir

__all__ = ["extended", "fold", "materialize", "partitions_for", "scratch_path", "shared_dir", "sliced", "texts_of"]


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids count as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """A text column as Python strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that a batch's derived data stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def extended(schema: StructType, more: str) -> StructType:
    """A new schema with the fields of a DDL string appended."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])
