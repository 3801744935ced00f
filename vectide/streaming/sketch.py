"""Clustering and index maintenance over Structured Streaming."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vectide.operators import cluster, searchers
from vectide.operators.cluster import Sketch
from vectide.plans.ship import ship

OUTPUT = "shard long, count long, cutoff double, n_centroids long, total_weight double"


def _packed(s: Sketch) -> str:
    v, w = s.centroids()
    return json.dumps({"target": s.target, "cutoff": s.cutoff, "count": s.count, "v": v.tolist(), "w": w.tolist(), "rng": s.rng.bit_generator.state})


def _unpacked(text: str, start: dict) -> Sketch:
    kept = json.loads(text)
    s = Sketch(**(start | {"target": kept["target"], "cutoff": kept["cutoff"]}))
    s.count = kept["count"]
    s.restore(np.array(kept["v"], float), kept["w"])
    s.rng.bit_generator.state = kept["rng"]
    return s


class ShardSketch(StatefulProcessor):
    """One sketch a shard: its centroids, cutoff, target, row count and generator survive between batches."""

    def __init__(self, start: dict):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sketch", "packed string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shard = int(key[0])
        start = self.start | {"seed": self.start.get("seed", 0) * 1_000_003 + shard}
        sketch = _unpacked(self.state.get()[0], start) if self.state.exists() else Sketch(**start)
        every = pd.concat(list(rows)).sort_values("id")
        sketch.extend(np.stack(every["v"].to_numpy()), every["w"].to_numpy())
        self.state.update((_packed(sketch),))
        yield pd.DataFrame({"shard": [shard], "count": [sketch.count], "cutoff": [sketch.cutoff], "n_centroids": [len(sketch.w)], "total_weight": [float(sum(sketch.w))]})

    def close(self) -> None:
        pass


def streaming_sketches(points: DataFrame, start: dict, shards: int = 8) -> DataFrame:
    """A streaming DataFrame of each shard's sketch after each batch (update mode)."""
    ship(points.sparkSession)
    # The state runner on the driver starts without the shipped sources: these modules travel by value.
    for module in (cluster, searchers, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)
    dealt = points.withColumn("shard", F.pmod("id", F.lit(shards)))
    return dealt.groupBy("shard").transformWithStateInPandas(ShardSketch(start), OUTPUT, "Update", "None")


def feed(points: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Hand each batch of a stream to ``take``, such as ``FastIndex.add`` followed by compaction."""
    writer = points.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
