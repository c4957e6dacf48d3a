"""Results of a stream as parts that can be merged: one folder per batch, compacted now and then."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from visitloom.sources.staging import folder_names, remove_folder, rename_folder


class MergedStore:
    """Rows of many batches, of which ``merge`` makes the result.

    ``merge`` must give the same whatever its input was merged from before, in
    any order: sums, minima, distinct rows. Then no batch needs to read what
    others wrote, an event counts however late it comes, and how the input
    falls into batches cannot matter.

    A batch writes ``batch=N`` and replaces that folder when it is repeated.
    ``compact`` puts all batches so far into ``upto=N`` by one rename; readers
    take the newest such folder and the batches after it. Folders that it makes
    needless stay until the next compaction, for readers that had begun.
    """

    def __init__(self, spark: SparkSession, target: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.target, self.schema, self.merge = spark, target.rstrip("/"), schema, merge

    def write(self, rows: DataFrame, number: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.target}/batch={number}")

    def _folders(self) -> tuple[int, list[int]]:
        """Number of the newest compaction, -1 without one, and the batches."""
        found: dict[str, list[int]] = {"upto": [-1], "batch": []}
        for name in folder_names(self.spark, self.target):
            if m := re.fullmatch(r"(upto|batch)=(\d+)", name):
                found[m[1]].append(int(m[2]))
        return max(found["upto"]), sorted(found["batch"])

    def _parts(self) -> tuple[DataFrame | None, int]:
        done, batches = self._folders()
        folders = [f"{self.target}/upto={done}"] if done >= 0 else []
        folders += [f"{self.target}/batch={n}" for n in batches if n > done]
        if not folders:
            return None, done
        return self.spark.read.schema(self.schema).parquet(*folders), max([done, *batches])

    def read(self) -> DataFrame:
        """All that was written, merged; no rows before the first batch."""
        rows, _ = self._parts()
        return self.merge(self.spark.createDataFrame([], self.schema) if rows is None else rows)

    def compact(self) -> None:
        """Merges everything so far; not to be run beside itself. What fails on the way changes nothing."""
        done, batches = self._folders()
        rows, last = self._parts()
        if rows is None or last == done:
            return
        fresh = f"{self.target}/_{uuid.uuid4().hex}"
        self.merge(rows).select(*self.schema.names).write.parquet(fresh)
        rename_folder(self.spark, fresh, f"{self.target}/upto={last}")
        for n in batches:
            if n <= done:
                remove_folder(self.spark, f"{self.target}/batch={n}")
        for name in folder_names(self.spark, self.target):
            if (m := re.fullmatch(r"upto=(\d+)", name)) and int(m[1]) < done:
                remove_folder(self.spark, f"{self.target}/{name}")
