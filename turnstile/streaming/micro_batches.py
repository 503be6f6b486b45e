"""Window features over a stream: each micro-batch updates a state table.

Rows of a batch see the state of all earlier batches and each other, as ``Fitted.update``
does. State and features are written under the batch's number, so a batch that is run
again after a failure overwrites its own output and reads the state it read before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import Fitted, Generator


@dataclass(frozen=True)
class StreamedFeatures:
    generator: Generator
    folder: str  # on a file system that all executors share

    def process(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        g = self.generator
        batch = batch.persist()
        if number == 0:
            features, after = g.fit(batch)
            state = after.state
        else:
            before = spark.read.parquet(f"{self.folder}/state/{number - 1}")
            features, after = Fitted(g, before).update(batch)
            state = after.state
        state.write.mode("overwrite").parquet(f"{self.folder}/state/{number}")
        features.write.mode("overwrite").parquet(f"{self.folder}/features/batch={number}")
        batch.unpersist()
        if number > 1:  # a batch that is run again reads the state before it; older ones have no reader
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state/{number - 2}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Runs over ``stream``, rows of which arrive in order of their dates."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
