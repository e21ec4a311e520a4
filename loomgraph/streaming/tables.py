"""A table that numbered batches write, cut into buckets by key, each with a few parts.

A batch writes only the buckets it touches, under its own number. One small file, the manifest, tells of which batches' parts each bucket
consists, after the last batch and after the one before it. A batch that comes again, whether it had got to the manifest or not, starts
from what stood before it and so gives the same table. Parts that neither of the two states names are deleted: after any number of
batches, there are no more than ``2 * parts`` folders a bucket. A reader that holds on to a state longer than one batch must copy it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.files import Files, retried

State = dict[int, list[int]]


@dataclass
class BucketTable:
    """The rows of ``schema`` under ``path``; ``keys`` place a row in a bucket."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: list[str]
    buckets: int = 64

    def __post_init__(self) -> None:
        self.files = Files(self.spark)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def states(self) -> list[tuple[int, State]]:
        """Batch and buckets of the last state and of that before it."""
        text = retried(lambda: self.files.read_text(f"{self.path}/manifest.json"))
        return [(s["batch"], {int(k): v for k, v in s["parts"].items()}) for s in json.loads(text)] if text else []

    def state_before(self, batch_id: int) -> State:
        return next((parts for batch, parts in self.states() if batch < batch_id), {})

    def state(self) -> State:
        found = self.states()
        return found[0][1] if found else {}

    def rows(self, state: State) -> DataFrame:
        """The rows of some buckets. Only their parts' folders are opened; none is looked for."""
        paths = [f"{self.path}/rows/batch={b}/bucket={k}" for k, batches in sorted(state.items()) for b in batches]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, batch: DataFrame) -> list[int]:
        """At most as many numbers as there are buckets."""
        return sorted(r.bucket for r in batch.select(self.bucket().alias("bucket")).distinct().collect())

    def write(self, batch_id: int, rows: DataFrame, before: State, whole: set[int]) -> None:
        """Writes a batch's rows; the buckets in ``whole`` consist of them alone from then on, others have one part more."""
        at = f"{self.path}/rows/batch={batch_id}"
        out = rows.select(*self.schema.names, self.bucket().alias("bucket"))
        # rows of a bucket lie together, in one file or, if a shuffle has more tasks than there are buckets, in as many as keep these busy. A
        # stream's plans aren't adaptive: a hint to rebalance does nothing there, and every task would write a file to every bucket
        pieces = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        out.repartition("bucket", F.pmod(F.hash(*self.keys), F.lit(pieces))).write.mode("overwrite").partitionBy("bucket").parquet(at)
        written = {int(n.removeprefix("bucket=")) for n in self.files.children(at) if n.startswith("bucket=")}
        kept = {k: v for k, v in before.items() if k not in whole}
        now = {k: [*kept.get(k, []), *([batch_id] if k in written else [])] for k in {*kept, *written}}
        previous = [s for s in self.states() if s[0] < batch_id][:1]
        said = [{"batch": b, "parts": parts} for b, parts in [(batch_id, now), *previous]]
        retried(lambda: self.files.write_text(f"{self.path}/manifest.json", json.dumps(said)))
        self._vacuum([now, *(parts for _, parts in previous)], batch_id)

    def _vacuum(self, states: list[State], batch_id: int) -> None:
        live = {(b, k) for s in states for k, batches in s.items() for b in batches}
        for name in self.files.children(f"{self.path}/rows"):
            batch = int(name.removeprefix("batch="))
            if not any(b == batch for b, _ in live):
                if batch != batch_id:
                    self.files.delete(f"{self.path}/rows/{name}")
                continue
            for part in self.files.children(f"{self.path}/rows/{name}"):
                if part.startswith("bucket=") and (batch, int(part.removeprefix("bucket="))) not in live:
                    self.files.delete(f"{self.path}/rows/{name}/{part}")
