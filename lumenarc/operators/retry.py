"""Batches that fail as a whole, tested until the rows at fault stand alone.

Some tools take many files a call and refuse all of them for one. Distributed
group testing: each round runs every group that is left as one call; of a
failed group, the rows that the error names stand alone in the next round and
the others go on together; if it names none (or all), each half goes on. Groups that went
through leave at once, so only failing batches cost more than one call, and the
rounds are at most log2 of the largest batch, and one where errors name names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.operators.tags import bad_paths
from lumenarc.runtime import Workspace, ship


def strict_dates(payloads: list[str]) -> None:
    """Reads EXIF dates; one that is none refuses them all."""
    pd.to_datetime(payloads, format="%Y:%m:%d", errors="raise")


def bisected(ops: DataFrame, act: Callable[[list], object], by_name: bool = False) -> DataFrame:
    """op_id, batch, ok, error, tries of ops(op_id, batch, payload), each run by ``act(payloads of a group)``.

    Batches hold as many rows as the tool takes, op_ids differ. ``by_name``:
    payloads are paths, and an error may name those at fault. A row whose group
    failed is tried again in a smaller one, so ``act`` must bear repetition. A
    null batch is one of its own; an empty table gives an empty one.
    """
    spark = ops.sparkSession
    ship(spark)
    work = Workspace(spark, "retry")
    kept = ops.select("op_id", "batch", "payload")
    schema = ", ".join(f"{n} {t}" for n, t in kept.dtypes) + ", part string, error string, size long"

    def tested(frame: pd.DataFrame) -> pd.DataFrame:
        # Groups are runs of one key, as rows come sorted; lists, since pandas takes longer for a small group than most tools.
        keys, payloads = frame["key"].to_numpy(), list(frame["payload"])
        ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        errors, sizes, start = [], [], 0
        for end in ends:
            try:
                act(payloads[start:end])
                error = None
            except Exception as e:  # noqa: BLE001 - whatever the tool raises is a result
                error = f"{type(e).__name__}: {e}"
            errors += [error] * (end - start)
            sizes += [end - start] * (end - start)
            start = end
        return frame.assign(error=pd.Series(errors, frame.index, object), size=pd.Series(sizes, frame.index, "int64")).drop(columns="key")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last group may go on in the next frame; it is as small as a batch
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = frame["key"] == frame["key"].iloc[-1]
            rest = frame[last]
            if not last.all():
                yield tested(frame[~last])
        if rest is not None:
            yield tested(rest)

    rows, found, n = kept.withColumn("part", F.lit("")), None, 0
    while True:
        n += 1
        keyed = rows.withColumn("key", F.to_json(F.struct("batch", "part"))).repartition("key").sortWithinPartitions("key", "op_id")
        tried = work.save(keyed.mapInPandas(run, schema), f"tried-{n}")
        settled = tried.filter("error IS NULL OR size = 1").select("op_id", "batch", F.col("error").isNull().alias("ok"), "error", F.lit(n).alias("tries"))
        found = settled if found is None else found.unionByName(settled)
        failed = tried.filter("error IS NOT NULL AND size > 1")
        if failed.isEmpty():
            return found
        half = F.when((F.row_number().over(Window.partitionBy("batch", "part").orderBy("op_id")) - 1) * 2 >= F.col("size"), "1").otherwise("0")
        rows = failed.withColumn("half", half)
        if by_name:
            # One error text a group, not one a row.
            texts = failed.groupBy("batch", "part").agg(F.first("error").alias("error"))
            named = bad_paths(texts, keep=["batch", "part"]).select("batch", "part", F.col("path").alias("payload"), F.lit(True).alias("named"))
            marked = rows.join(named, [rows["batch"].eqNullSafe(named["batch"]), rows["part"] == named["part"], rows["payload"] == named["payload"]], "left").select(*(rows[c] for c in rows.columns), "named")
            some = F.count("named").over(Window.partitionBy("batch", "part"))
            alone = F.when(F.col("named"), F.concat(F.lit("!"), F.col("op_id").cast("string"))).otherwise("+")
            rows = marked.withColumn("half", F.when((some > 0) & (some < F.col("size")), alone).otherwise(F.col("half")))
        rows = rows.select("op_id", "batch", "payload", F.concat("part", "half").alias("part"))
