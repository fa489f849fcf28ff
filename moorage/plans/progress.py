"""What a flow's stages have done, from metrics that Spark counts as their rows are written."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..session import cut_lineage

SCHEMA = "ord int, stage string, n_rows long, metrics map<string,long>, seconds double"


@dataclass
class Progress:
    """Cuts the lineage of each stage's table and keeps a row of counts for it; ``on_stage`` hears of each as it is written."""

    on_stage: Callable[[dict], None] | None = None
    rows: list[tuple] = field(default_factory=list)

    def cut(self, stage: str, df: DataFrame, **metrics: Column) -> DataFrame:
        """``df`` written and read back; its rows, and ``metrics`` (aggregates that give whole numbers), are counted in the same pass."""
        seen = Observation(f"{stage}-{len(self.rows)}")
        began = time.time()
        out = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[m.cast("long").alias(k) for k, m in metrics.items()]))
        told = {k: v for k, v in seen.get.items() if v is not None}
        row = (len(self.rows), stage, told.pop("n_rows"), told, round(time.time() - began, 3))
        self.rows.append(row)
        if self.on_stage:
            self.on_stage(dict(zip(("ord", "stage", "n_rows", "metrics", "seconds"), row)))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """The stages so far, one row each."""
        return spark.createDataFrame(self.rows, SCHEMA)


class StreamProgress(StreamingQueryListener):
    """The batches of streams, with the metrics that their plans observe; ``on_batch`` hears of each."""

    def __init__(self, on_batch: Callable[[dict], None] | None = None):
        self.batches: list[dict] = []
        self.ended: list[str] = []
        self.on_batch = on_batch

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        row = {"name": p.name, "batch": p.batchId, "n_rows": p.numInputRows, "metrics": {k: v.asDict() for k, v in p.observedMetrics.items()}}
        self.batches.append(row)
        if self.on_batch:
            self.on_batch(row)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.append(str(event.id))
