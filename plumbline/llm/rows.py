"""Arrow row mapping: add computed columns to rows without leaving the scan's partitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from plumbline.llm.common import sliced, utf8

#: From the UTF-8 texts of some rows to a list or array for each new column.
Compute = Callable[[list[bytes]], dict[str, object]]


def _array(values: object, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def with_computed(df: DataFrame, text_col: str, made: StructType, start: Callable[[], Compute], keep: list[str] | None = None, limit: int = 4 << 20) -> DataFrame:
    """Columns `keep` of `df` (None: all) plus the columns `made`, computed from `text_col` in slices of about `limit` bytes.

    `start` runs once for each task and gives the function that computes slices. Null texts arrive as b"".
    Columns of `df` named like a made column are replaced.
    """
    names = {f.name for f in made.fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = StructType([df.schema[c] for c in keep] + [StructField(f.name, f.dataType, True) for f in made.fields])
    wanted = list(dict.fromkeys([*keep, text_col]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        compute = start()
        arrow = {f.name: to_arrow_type(f.dataType) for f in made.fields}
        for part in sliced(batches, text_col, limit):
            new = compute(utf8(part, text_col))
            columns = [part.column(part.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(columns + [_array(new[n], arrow[n]) for n in arrow], names=keep + list(arrow))

    return df.select(*[df[c] for c in wanted]).mapInArrow(run, schema)
