"""New scans arrive as files; summaries and changes follow without reading old scans again."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import classify as c
from voxloom.sources.sinks import write_upsert


def object_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Object tables of new scans, read as their files appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_census(throats: DataFrame) -> DataFrame:
    """(specimen, scan, n, cohesive, gap_mean): kept up to date; map-side sums, so state is one row per specimen and scan."""
    mode = c.mode_at(F.col("cover_a"), F.col("cover_b"), c.MODE_HIGH)
    return throats.groupBy("specimen", "scan").agg(F.count("*").alias("n"), F.count_if(mode == "cohesive").alias("cohesive"), F.avg("gap_vox").alias("gap_mean"))


def scan_changes(summaries: DataFrame) -> DataFrame:
    """(specimen, scan, value, step, change): of each scan's value against the scan before and the first.

    ``summaries`` has (specimen, scan, value). Scans are strictly ordered; one that is not after the last seen is
    passed over. State per specimen is the first value, the last value and the last scan.
    """

    def follow(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, seen = state.get if state.exists else (None, None, None)
        rows = []
        for part in parts:
            for r in part.sort_values("scan").itertuples():
                if seen is not None and r.scan <= seen:
                    continue
                rows.append((key[0], int(r.scan), float(r.value), None if last is None else float(r.value) - last, 0.0 if first is None else float(r.value) - first))
                first, last, seen = (float(r.value) if first is None else first), float(r.value), int(r.scan)
        state.update((first, last, seen))
        yield pd.DataFrame(rows, columns=["specimen", "scan", "value", "step", "change"])

    out = "specimen string, scan int, value double, step double, change double"
    return summaries.groupBy("specimen").applyInPandasWithState(follow, out, "first double, last double, seen int", "append", "NoTimeout")


def keep_summary(stream: DataFrame, path: str, checkpoint: str):
    """Write changed summaries into a table by upsert; a batch that runs again replaces its own rows."""

    def put(batch: DataFrame, epoch: int) -> None:
        write_upsert(batch.sparkSession, batch, path, ["specimen", "scan"], "specimen")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
