"""Row functions on Arrow batches, a slice of a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows that are Python objects at a time, whatever the size of the batch that Spark sends.
ROWS = 64


def _pairs(value, kind: pa.DataType):
    """``value`` with maps as pairs, which Arrow takes."""
    if value is None:
        return None
    if pa.types.is_map(kind):
        return [(k, _pairs(v, kind.item_type)) for k, v in value.items()]
    if pa.types.is_struct(kind):
        return {f.name: _pairs(value.get(f.name), f.type) for f in kind}
    if pa.types.is_list(kind):
        return [_pairs(v, kind.value_type) for v in value]
    return value


def by_rows(fn: Callable, kind: str) -> Callable[..., Column]:
    """A column function that calls ``fn`` on each row: structs and maps are dicts, there and in what it returns."""
    type_ = to_arrow_type(DataType.fromDDL(kind))

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)  # one column comes by itself
            if not len(columns[0]):
                yield pa.array([], type_)
            for lo in range(0, len(columns[0]), ROWS):
                rows = zip(*[c.slice(lo, ROWS).to_pylist(maps_as_pydicts="lossy") for c in columns])
                yield pa.array([_pairs(fn(*r), type_) for r in rows], type_)

    return F.arrow_udf(run, kind)
