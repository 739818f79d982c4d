"""Stateful streams (ST4, ST5): the previous frame of each video, and a cache of the contents last seen.

State is kept by key in the state store and comes back from the checkpoint, so a stream that is stopped goes on as if it had not been.
Rows of a key are taken in the order of `ord` within a micro-batch, batches in theirs.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tessera.functions.images import SCENE_THRESHOLD

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CAPACITY = 1000


def _sorted(rows: Iterator[pd.DataFrame], ord_: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(ord_, kind="stable", ignore_index=True)


def _with(df: DataFrame, fields: str) -> StructType:
    out = StructType(list(df.schema.fields))
    for f in fields.split(", "):
        out = out.add(*f.split())
    return out


def _stateful(df: DataFrame, by: str, processor: StatefulProcessor, fields: str, time_mode: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the one that has these states
    return df.groupBy(by).transformWithStateInPandas(processor, _with(df, fields), "Append", time_mode)


class SceneProcessor(StatefulProcessor):
    """One value by key: the pixels of the frame before."""

    def __init__(self, ord_: str, pixels: str, threshold: float) -> None:
        self.ord, self.pixels, self.threshold = ord_, pixels, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", "pixels array<double>")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        batch = _sorted(rows, self.ord)
        last = np.array(self.before.get()[0], float) if self.before.exists() else None
        difference: list[float | None] = []
        for now in batch[self.pixels]:
            now = np.asarray(now, float)
            # frames of another size have no difference, as those without pixels, and count as a change
            difference.append(float(np.abs(now - last).mean()) if last is not None and len(now) == len(last) and len(now) else None)
            last = now
        self.before.update((last.tolist(),))
        change = [d is None or d > self.threshold for d in difference]
        yield batch.assign(difference=pd.Series(difference, dtype="float64"), change=change)

    def close(self) -> None:
        pass


def scene_stream(df: DataFrame, by: str, ord_: str, pixels: str, threshold: float = SCENE_THRESHOLD) -> DataFrame:
    """ST4: what images.scene_changes() gives, of a stream: difference to the video's frame before, null for the first, and change."""
    return _stateful(df, by, SceneProcessor(ord_, pixels, threshold), "difference double, change boolean", "None")


class CacheProcessor(StatefulProcessor):
    """A map by key: hash of a content to the number of its last use. Entries go when they are the least lately used beyond the
    capacity, or by age."""

    def __init__(self, ord_: str, content: str, capacity: int, life_ms: int | None) -> None:
        self.ord, self.content, self.capacity, self.life_ms = ord_, content, capacity, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "hash string", "used long", self.life_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        batch = _sorted(rows, self.ord)
        held = {k[0]: v[0] for k, v in self.seen.iterator()}
        cache = OrderedDict(sorted(held.items(), key=lambda x: x[1]))
        clock = max(held.values(), default=0)
        hashes, hits = [], []
        for content in batch[self.content]:
            raw = b"" if content is None else content.encode() if isinstance(content, str) else bytes(content)
            digest, clock = hashlib.md5(raw).hexdigest(), clock + 1
            hashes.append(digest)
            hits.append(digest in cache)
            cache[digest] = clock
            cache.move_to_end(digest)
            if len(cache) > self.capacity:
                cache.popitem(last=False)
        for digest in held.keys() - cache.keys():
            self.seen.removeKey((digest,))
        for digest, used in cache.items():
            if held.get(digest) != used:
                self.seen.updateValue((digest,), (used,))
        yield batch.assign(content_md5=hashes, hit=hits)

    def close(self) -> None:
        pass


def cached_stream(df: DataFrame, by: str, ord_: str, content: str, capacity: int = CAPACITY, life_ms: int | None = None) -> DataFrame:
    """ST5: rows with content_md5 and hit, whether the key's cache of the `capacity` contents last used holds it. A null content is an empty one.

    life_ms: entries not used for so long go, also those of keys that come no more. Spark then runs batches without data on and on, so that a
    trigger of what is available never ends; use it with streams that run all the time."""
    return _stateful(df, by, CacheProcessor(ord_, content, capacity, life_ms), "content_md5 string, hit boolean", "None" if life_ms is None else "ProcessingTime")
