"""Helpers shared by the operators: Arrow maps over chosen columns, column names that clash with nothing, layers.

The conventions of all operators in this package: a text column may hold nulls, which count as empty; extra
columns are passed through or ignored, never read; input rows are never dropped, capped or sampled.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ROWS_AT_ONCE = 512  # rows whose texts are Python objects at a time


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def others(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The columns of ``df`` that are not among ``names`` (compared without case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


_KEPT: dict = {}
_USED: set = set()


def kept(key, build: Callable):
    """A large object that a Python worker keeps for its next task, such as a compiled vocabulary with what it has met.

    A worker keeps only what its current pass asks for, so the memory of passes does not add up.
    """
    _USED.add(key)
    if key not in _KEPT:
        _release()
        _KEPT[key] = build()
    return _KEPT[key]


def _release() -> None:
    gone = [k for k in _KEPT if k not in _USED]
    for k in gone:
        del _KEPT[k]
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()


def _start(make: Callable):
    _USED.clear()
    fn = make()
    _release()
    return fn


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_fields(schema: T.StructType) -> list[pa.Field]:
    return [pa.field(f.name, to_arrow_type(f.dataType), True) for f in schema.fields]


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    make: Callable[[], Callable[..., Sequence[Sequence]]],
    outputs: str,
    drop: Sequence[str] = (),
    keep_where: str | None = None,
) -> DataFrame:
    """``df`` with columns computed from ``inputs``, in one narrow Arrow pass.

    ``make`` runs once per task and returns a function from the input columns (lists) to the output columns
    (lists or arrays), in the order of the DDL ``outputs``. An output named like a column replaces it;
    ``drop`` leaves columns out; ``keep_where`` names a boolean output that selects the rows and is dropped.
    """
    new = T.StructType.fromDDL(outputs)
    gone = {f.name for f in new.fields} | set(drop)
    passed = [df.schema[c] for c in others(df, gone)]
    shown = T.StructType(passed + [f for f in new.fields if f.name != keep_where])
    fields, names = arrow_fields(new), [f.name for f in passed]
    out_schema = pa.schema([f for f in fields if f.name != keep_where])

    def run(batches):
        fn = _start(make)
        for batch in slices(batches):
            got = fn(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs])
            made = [g if isinstance(g, pa.Array) else pa.array(g, f.type) for g, f in zip(got, fields)]
            old = [batch.column(batch.schema.get_field_index(c)) for c in names]
            table = pa.Table.from_arrays(
                old + [m for m, f in zip(made, fields) if f.name != keep_where], names + out_schema.names
            )
            if keep_where:
                table = table.filter(made[[f.name for f in fields].index(keep_where)])
            yield from table.to_batches()

    return df.mapInArrow(run, shown)


def explode_rows(
    df: DataFrame, inputs: Sequence[str], make: Callable[[], Callable[..., Sequence]], outputs: str
) -> DataFrame:
    """New rows computed from ``inputs`` in one narrow Arrow pass; ``make`` as above, but columns of any length."""
    schema = T.StructType.fromDDL(outputs)
    fields = arrow_fields(schema)

    def run(batches):
        fn = _start(make)
        for batch in slices(batches):
            got = fn(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs])
            made = [g if isinstance(g, pa.Array) else pa.array(g, f.type) for g, f in zip(got, fields)]
            yield pa.RecordBatch.from_arrays(made, names=[f.name for f in fields])

    return df.select(*[f"`{c}`" for c in inputs]).mapInArrow(run, schema)
