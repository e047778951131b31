"""Models that take a bounded number of rows a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resliced(batches: Iterator, size: int, by: list[str]) -> Iterator:
    """(Arrow batch of at most ``size`` rows, whether it is the first of its group) in the order of the rows.

    Arrow batches are joined and cut anew: a batch is full unless its group ends,
    which are neighbouring rows of equal values in ``by``, or all rows of the task.
    """
    import pyarrow as pa

    held, rows, now, opened = [], 0, None, False

    def let_go():
        nonlocal held, rows
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held, rows = [], 0
        return whole

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * batch.num_rows
        at = 0
        while at < batch.num_rows:
            if keys[at] != now:
                if held:
                    yield let_go(), not opened
                now, opened = keys[at], False
            end = at + 1
            while end < batch.num_rows and end - at < size - rows and keys[end] == now:
                end += 1
            held.append(batch.slice(at, end - at))
            rows, at = rows + end - at, end
            if rows == size:
                yield let_go(), not opened
                opened = True
    if held:
        yield let_go(), not opened


def embedded(frames: DataFrame, schema: str, embed: Callable[[Iterator], Iterator], size: int, by: list[str] | tuple = (), order: list[str] | tuple = ()) -> tuple[DataFrame, Observation]:
    """(rows of ``schema``, their counters): a model that is called with at most ``size`` rows at a time.

    ``embed`` maps Arrow batches to batches of as many rows, one by one, and loads
    its model once a task. With ``by``, the rows of a group (the crops of a frame)
    come together in their order, and no call mixes groups: a group of n rows
    takes n / size calls, rounded up. The counters are there after an action:
    inferences (groups, or tasks without ``by``), calls, rows and largest call.
    """
    by = list(by)
    if by:
        frames = frames.repartition(*by).sortWithinPartitions(*by, *order)
    out = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_rows", T.LongType()), T.StructField("_first", T.LongType())])

    def run(batches):
        import pyarrow as pa

        first = []

        def fed():
            for batch, opens in resliced(batches, size, by):
                first.append(opens)
                yield batch

        for n, made in enumerate(embed(fed())):
            lead = lambda x: pa.array([x] + [0] * (made.num_rows - 1), pa.int64())
            yield pa.RecordBatch.from_arrays([*made.columns, lead(made.num_rows), lead(int(first[n]))], names=[f.name for f in out.fields])

    seen = Observation()
    rows = frames.mapInArrow(run, out).observe(seen, F.coalesce(F.sum("_first"), F.lit(0)).alias("inferences"), F.count_if(F.col("_rows") > 0).alias("calls"), F.count("*").alias("rows"), F.coalesce(F.max("_rows"), F.lit(0)).alias("largest"))
    return rows.drop("_rows", "_first"), seen
