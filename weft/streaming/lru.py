"""LRU cache with time to live: batch replay, and the same as a stateful stream."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUT = "cache long, hits long, misses long, evictions long"


class Lru:
    """Hits refresh an entry; an entry older than ``ttl`` seconds counts as a miss; the oldest goes when full.

    With ``most_bytes``, the oldest go until all sizes fit, before entries are counted; an entry keeps the size that it came with.
    """

    def __init__(self, capacity: int, ttl: float | None = None, entries: list | None = None, most_bytes: int | None = None):
        self.capacity, self.ttl, self.most_bytes = capacity, ttl, most_bytes
        self.entries: OrderedDict = OrderedDict(entries or [])
        self.sizes: dict = {}
        self.held = 0
        self.hits = self.misses = self.evictions = 0

    def _drop_oldest(self) -> None:
        gone, _ = self.entries.popitem(last=False)
        self.held -= self.sizes.pop(gone, 0)
        self.evictions += 1

    def access(self, key: int, at: float, size: int = 0) -> bool:
        stored = self.entries.get(key)
        if stored is not None and (self.ttl is None or at - stored <= self.ttl):
            self.entries.move_to_end(key)
            self.hits += 1
            return True
        self.misses += 1
        if self.entries.pop(key, None) is None:
            self.sizes[key] = size
            self.held += size
        self.entries[key] = at
        while self.most_bytes is not None and self.held > self.most_bytes and self.entries:
            self._drop_oldest()
        while len(self.entries) > self.capacity:
            self._drop_oldest()
        return False


def replay(accesses: DataFrame, capacity: int, ttl: float | None = None, most_bytes: int | None = None) -> DataFrame:
    """``accesses`` (cache, key, at seconds, seq, and size with ``most_bytes``) -> (cache, hits, misses, evictions): each cache on its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "seq"], kind="stable")
        lru = Lru(capacity, ttl, most_bytes=most_bytes)
        for key, at, size in zip(pdf["key"], pdf["at"], pdf["size"] if most_bytes is not None else [0] * len(pdf)):
            lru.access(key, at, size)
        return pd.DataFrame({"cache": [pdf["cache"].iloc[0]], "hits": [lru.hits], "misses": [lru.misses], "evictions": [lru.evictions]})

    return accesses.groupBy("cache").applyInPandas(run, OUT)


def stream(accesses: DataFrame, capacity: int, ttl: float | None = None) -> DataFrame:
    """The same over a stream; each trigger gives the running totals of the caches that were used.

    State is the cache itself, at most ``capacity`` entries a cache.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, times, hits, misses, evictions = state.get if state.exists else ([], [], 0, 0, 0)
        lru = Lru(capacity, ttl, list(zip(keys, times)))
        lru.hits, lru.misses, lru.evictions = hits, misses, evictions
        for k, at in pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")[["key", "at"]].itertuples(index=False):
            lru.access(k, at)
        state.update((list(lru.entries), list(lru.entries.values()), lru.hits, lru.misses, lru.evictions))
        yield pd.DataFrame({"cache": [key[0]], "hits": [lru.hits], "misses": [lru.misses], "evictions": [lru.evictions]})

    saved = "keys array<bigint>, times array<double>, hits bigint, misses bigint, evictions bigint"
    return accesses.groupBy("cache").applyInPandasWithState(run, OUT, saved, "update", GroupStateTimeout.NoTimeout)
