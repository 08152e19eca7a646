"""Global order without a one-partition window.

``row_number().over(Window.orderBy(...))`` moves every row to one task. Here the input
is range-partitioned and sorted per partition, materialised (reliable checkpoint, so a
lost executor recomputes nothing order-dependent), numbered by partition counts plus
partition offsets. Offsets come from a Spark window over one row per partition, so only
partition metadata is ever in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.session import ensure_checkpoint_dir, shared_dir

_PID, _MID = "__pid", "__mid"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``materialize``, as a Parquet table in the shared folder: columns are compressed, a
    checkpoint's rows are not."""
    path = shared_dir(df.sparkSession, f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sorted_and_tagged(df: DataFrame, order: list[Column], num_partitions: int | None) -> DataFrame:
    parted = (df.repartitionByRange(num_partitions, *order) if num_partitions
              else df.repartitionByRange(*order))
    return (parted.sortWithinPartitions(*order)
            .withColumn(_PID, F.spark_partition_id())
            .withColumn(_MID, F.monotonically_increasing_id()))


def _partition_offsets(tagged: DataFrame, value_cols: dict[str, Column]) -> DataFrame:
    """Exclusive prefix of per-partition totals, one row per partition."""
    totals = tagged.groupBy(_PID).agg(*[agg.alias(name) for name, agg in value_cols.items()])
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(_PID, *[F.coalesce(F.sum(name).over(w), F.lit(0)).alias(f"__off_{name}")
                                 for name in value_cols])


def with_global_row_number(df: DataFrame, order: list[Column], name: str = "rank",
                           num_partitions: int | None = None) -> DataFrame:
    """Add 1-based positions in the total order ``order`` (must be a total order)."""
    tagged = materialize(_sorted_and_tagged(df, order, num_partitions))
    offsets = _partition_offsets(tagged, {"n": F.count(F.lit(1))})
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), _PID)   # one row per partition: bounded
            .withColumn(name, F.col("__off_n") + local + 1)
            .drop(_PID, _MID, "__off_n"))


def with_prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, str],
                     num_partitions: int | None = None) -> DataFrame:
    """Add exclusive running sums ``{out_name: input_col}`` in the global order ``order``.

    Within a partition the running sum is taken over its sorted batches as they pass, so nothing is
    exchanged again; then the partition's offset is added. Inputs count as long or double; a NULL
    adds nothing.
    """
    tagged = materialize(_sorted_and_tagged(df, order, num_partitions))
    offsets = _partition_offsets(tagged, {out: F.sum(col) for out, col in sums.items()})
    kinds = {out: "double" if dict(df.dtypes)[col] in ("double", "float") else "long" for out, col in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = dict.fromkeys(sums, 0)
        for b in batches:
            columns, names = list(b.columns), list(b.schema.names)
            for out, col in sums.items():
                x = pc.fill_null(b.column(names.index(col)), 0).to_numpy(zero_copy_only=False).astype(np.float64 if kinds[out] == "double" else np.int64)
                upto = np.cumsum(x) + before[out]
                columns.append(pa.array(upto - x if kinds[out] == "long" else np.concatenate(([before[out]], upto[:-1]))[:len(x)]))
                before[out] = upto[-1] if len(x) else before[out]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(f"__in_{o}" for o in sums)])

    schema = T.StructType([*tagged.schema.fields, *(T.StructField(f"__in_{o}", T.DoubleType() if k == "double" else T.LongType()) for o, k in kinds.items())])
    out = tagged.mapInArrow(run, schema).join(F.broadcast(offsets), _PID)   # one row per partition
    for name in sums:
        out = out.withColumn(name, F.col(f"__off_{name}") + F.col(f"__in_{name}"))
    return out.drop(_PID, _MID, *[f"__off_{o}" for o in sums], *[f"__in_{o}" for o in sums])
