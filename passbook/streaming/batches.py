"""Tables written one folder per micro-batch, so that a repeated batch counts once.

The folder of a batch carries the id of its query and a number. A query's numbers go on
where those of the queries before it ended, so a query that lost its checkpoint, and counts
its batches from 0 again, adds to what is there instead of writing over it. The engine
gives a repeated batch the rows that it had, so a folder that is complete is kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_BATCH = -1
#: Batches after which the rows of all of them are merged, for a table that can be.
MERGE_EVERY = 50

_FOLDER = re.compile(r"run=(\d+)-([^/]*)/batch_id=(-?\d+)$")


class BatchTable:
    """Rows under ``path/run=<first number>-<query>/batch_id=<number>``.

    All effects of a batch go into one write. ``merge`` maps the rows of many batches to fewer
    that mean the same; every ``every`` batches they are merged into a folder of their own,
    and readers start from the newest of these.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        merge: Callable[[DataFrame], DataFrame] | None = None,
        every: int = MERGE_EVERY,
    ) -> None:
        self.spark = spark
        self.path = path
        self.columns = schema.names
        self.schema = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        self.merge, self.every = merge, every

    def _complete(self, pattern: str) -> list[str]:
        """Folders below the path that were written to the end."""
        jvm = self.spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}/_SUCCESS")
        found = mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(mark)
        return [str(f.getPath().getParent().toString()) for f in found or []]

    def _batches(self) -> dict[int, str]:
        """Complete batch folders by number."""
        return {int(_FOLDER.search(p)[3]): p for p in self._complete("run=*/batch_id=*")}

    def _query(self) -> str:
        """The id of the running query, which its checkpoint keeps over restarts."""
        return self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"

    def number(self, batch_id: int) -> tuple[int, str]:
        """Number and folder of a batch of the running query."""
        query, last = self._query(), NO_BATCH
        for path in self._complete("run=*/batch_id=*"):
            first, owner, number = _FOLDER.search(path).groups()
            if owner == query:
                return int(first) + batch_id, f"run={first}-{query}/batch_id={int(first) + batch_id}"
            last = max(last, int(number))
        return last + 1 + batch_id, f"run={last + 1}-{query}/batch_id={last + 1 + batch_id}"

    def create(self) -> BatchTable:
        """Make sure that the folder can be read before the first batch."""
        if not self._batches():
            empty = self.spark.createDataFrame([], self.schema).select(*self.columns)
            empty.write.mode("overwrite").parquet(f"{self.path}/run=0-new/batch_id={NO_BATCH}")
        return self

    def write(self, df: DataFrame, batch_id: int) -> None:
        number, folder = self.number(batch_id)
        if number not in self._batches():
            df.select(*self.columns).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        if self.merge and (number + 1) % self.every == 0 and not self._complete(f"merged={number}"):
            self.merge(self.read()).select(*self.columns).write.mode("overwrite").parquet(f"{self.path}/merged={number}")

    def rows_of(self, batch_id: int) -> DataFrame:
        """What a batch of the running query wrote."""
        schema = T.StructType([f for f in self.schema.fields if f.name in self.columns])
        return self.spark.read.schema(schema).parquet(self._batches()[self.number(batch_id)[0]])

    def previous(self, batch_id: int) -> DataFrame:
        """What the batch before this one wrote, and nothing else; batches are numbered on end."""
        schema = T.StructType([f for f in self.schema.fields if f.name in self.columns])
        return self.spark.read.schema(schema).parquet(self._batches()[self.number(batch_id)[0] - 1])

    def read(self, before: int | None = None, after: int = NO_BATCH) -> DataFrame:
        """Rows of all batches, merged as far as they are; or of those after number ``after``
        that a retry of the running query's batch ``before`` may start from."""
        end = None if before is None else self.number(before)[0]
        merged = [int(p.rsplit("=", 1)[1]) for p in self._complete("merged=*")] if after == NO_BATCH else []
        start = max((n for n in merged if end is None or n < end), default=NO_BATCH)
        own = T.StructType([f for f in self.schema.fields if f.name in self.columns])
        paths = [p for n, p in sorted(self._batches().items()) if n > max(start, after) and (end is None or n < end)]
        reader = self.spark.read.schema(self.schema).option("basePath", self.path)
        df = reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        df = df.select(*self.columns, "batch_id")
        if start == NO_BATCH:
            return df
        old = self.spark.read.schema(own).parquet(f"{self.path}/merged={start}")
        return old.withColumn("batch_id", F.lit(start).cast("long")).unionByName(df)
