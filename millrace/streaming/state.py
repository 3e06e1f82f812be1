"""Streams with state: near duplicates, a bounded cache of hosts, and spacing of a host's requests.

State lives in the RocksDB store (``use_rocksdb``). Clocks are event times: a watermark is the
clock, so a replay gives the same rows, and timers clear what is past.
"""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import content_hash
from ..operators import dedup
from ..session import released, written
from .sink import KeyedLog

#: A host's rules are kept for a day, and so many hosts at most.
LIVE_SECONDS, MOST_HOSTS = 86_400, 1000


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """From now on streams of the session keep their state in RocksDB, as those of this module need."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """RocksDB for the streams that start within."""
    before = spark.conf.get(_PROVIDER)
    use_rocksdb(spark)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


# ---- near duplicates -------------------------------------------------------------------------


#: Parts of each table of blocks. A part is one group of the state, so that a batch has a bounded number of groups and not one for each block.
SHARDS = 64


class _Blocks(StatefulProcessor):
    """Per block of fingerprints, the distinct (hash, fingerprint) pairs that it has met, each with the first row that had it; a row is linked to the earlier ones that are alike.

    The blocks of a part are the keys of one map, read and written once a batch each, and only those that the batch asks.
    """

    def __init__(self, live_ms: int | None):
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "v long", "content_hash array<string>, p array<long>, id array<long>, at array<long>", self.live_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        t, stored = int(key[0]), self.seen.exists()
        now = timerValues.getCurrentProcessingTimeInMs() if self.live_ms else 0
        a, b, same = [], [], []
        # the answers of a batch do not depend on the order of its rows within a group
        asked = pd.concat(list(rows)).sort_values(["v", "id"])
        for v, block in itertools.groupby(zip(*[asked[c].tolist() for c in ("v", "id", "content_hash", "p")]), key=itemgetter(0)):
            held = self.seen.getValue((v,)) if stored else None
            known = {(h, p): (i, at) for h, p, i, at in zip(*held) if not self.live_ms or at + self.live_ms > now} if held else {}
            before = len(known)
            for _, i, h, p in block:
                own = (h, p)
                copy = own in known
                if copy:
                    found = [known[own][0]] if t < 0 else []  # a copy is linked once
                elif t < 0:  # the table of hashes: a row without a fingerprint has 0 there, and is like those of its hash alone
                    found = [first for (other, _), (first, _) in known.items() if other == h]
                else:
                    differ = [((q ^ p) & _BITS, first) for (_, q), (first, _) in known.items()]
                    found = [first for x, first in differ if x.bit_count() <= dedup.NEAR and _first_shared(x) == t]
                if not copy:
                    known[own] = (i, now)
                if t < 0:
                    found = [*found, None]  # every row is heard of once
                a += found
                b += [i] * len(found)
                same += [copy and x is not None for x in found]
            if len(known) > before:
                self.seen.updateValue((v,), ([h for h, _ in known], [p for _, p in known], [i for i, _ in known.values()], [at for _, at in known.values()]))
        if b:
            yield pd.DataFrame({"a": pd.array(a, "Int64"), "b": b, "same": same})

    def close(self) -> None:
        pass


_BITS = (1 << dedup.BITS) - 1
_CHOICES = list(itertools.combinations(range(len(dedup.BLOCKS)), 3))


def _first_shared(differ: int) -> int:
    """The first table of blocks in which two fingerprints are alike, given their differing bits."""
    alike = [k for k, (start, width) in enumerate(dedup.BLOCKS) if not differ >> start & ((1 << width) - 1)]
    return _CHOICES.index(tuple(alike[:3]))


def near_links(rows: DataFrame, live_seconds: int | None = None, marks: tuple[str, str] | None = None) -> DataFrame:
    """Links (a, b, same) of each row b (id, text) of a stream to the earlier rows a that have its content hash or a
    fingerprint within three bits (``same``: both are equal), and one with null a for every row. What is older than ``live_seconds`` is forgotten.

    A row asks the blocks of its fingerprint and the block of its hash; each pair is found in one block alone. Copies
    of a text are linked to the first one only and leave nothing in the state. ``marks`` names columns that hold hash and fingerprint already.
    """
    value = (F.col(marks[0]), F.col(marks[1])) if marks else (content_hash(F.col("text")), dedup.simhash(F.col("text")))
    own = rows.select("id", value[0].alias("content_hash"), value[1].alias("p"))
    tables = dedup.block_tables("p")
    whole = F.struct(F.lit(-1).alias("t"), F.xxhash64("content_hash").alias("v"))
    asked = own.select("id", "content_hash", F.coalesce("p", F.lit(0)).alias("p"), F.explode(F.when(F.col("p").isNull(), F.array(whole)).otherwise(F.concat(F.array(whole), F.array(*tables)))).alias("x"))
    keyed = asked.select("id", "content_hash", "p", "x.t", "x.v").withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(SHARDS)).cast("int"))
    processor = _Blocks(live_seconds * 1000 if live_seconds else None)
    return keyed.groupBy("t", "shard").transformWithStateInPandas(processor, "a long, b long, same boolean", "append", "processingTime" if live_seconds else "none")


def settled(links: DataFrame, log: KeyedLog, batch_id: int) -> None:
    """Decide a batch's rows by the sequential rule: a row is dropped if an earlier row that it is linked to is
    kept. Earlier batches are read from the log; decisions (id, kept) are written to it under the batch's number.
    """
    pairs = written(links, "links")
    heard = written(pairs.groupBy(F.col("b").alias("id")).agg(F.bool_or("same").alias("copy")), "heard")
    linked = pairs.where("a is not null and not same").select("a", "b").distinct()
    before = log.rows(before=batch_id).select(F.col("id").alias("a"), "kept")
    old = linked.join(before, "a").groupBy(F.col("b").alias("id")).agg(F.bool_or("kept").alias("near_kept"))
    edges = written(linked.join(heard.select(F.col("id").alias("a")), "a", "left_semi"), "edges")
    # copies share the fate of the row they repeat, or repeat it; rows near a kept one of an earlier batch are dropped; the others settle round by round
    first = F.when(F.col("copy") | F.coalesce("near_kept", F.lit(False)), F.lit(False))
    state = written(heard.join(old, "id", "left").select("id", first.alias("kept")), "state")
    while True:
        seen = edges.join(state.select(F.col("id").alias("a"), "kept"), "a").groupBy(F.col("b").alias("id")).agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("near_kept"), F.bool_or(F.col("kept").isNull()).alias("open"))
        both = state.join(seen, "id", "left")
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("near_kept", F.lit(False)), F.lit(False)).when(F.coalesce("open", F.lit(False)), F.lit(None).cast("boolean")).otherwise(F.lit(True))
        after = written(both.select("id", decided.alias("kept")), "state")
        released(state)
        state = after
        if state.where("kept is null").isEmpty():
            break
    log.write(state, batch_id)
    released(pairs, heard, edges, state)


def first_kept_stream(rows: DataFrame, folder: str, checkpoint: str, live_seconds: int | None = None, marks: tuple[str, str] | None = None):
    """Start the stream that keeps the first of each group of near copies of rows (id, text): decisions in a KeyedLog.

    Order is by arrival: batches as they come, ids within a batch. Ids are distinct.
    """
    log = KeyedLog(rows.sparkSession, folder, ["id"], "id long, kept boolean")
    stream = near_links(rows, live_seconds, marks).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return stream.foreachBatch(lambda links, batch_id: settled(links, log, batch_id)).trigger(availableNow=True).start()


# ---- a bounded cache of hosts ----------------------------------------------------------------


class LeastRecent:
    """Keys with the time that each was fetched: those past their time to live are gone, and beyond ``most`` the least recently used goes."""

    def __init__(self, most: int, live: float, entries=()):
        self.most, self.live, self.held = most, live, OrderedDict(entries)

    def ask(self, key, now: float) -> str:
        """``hit``, ``miss`` or ``expired``; after it the key is held and the most recently used."""
        at = self.held.get(key)
        if at is not None and now - at < self.live:
            self.held.move_to_end(key)
            return "hit"
        if at is not None:
            del self.held[key]
        while len(self.held) >= self.most:
            self.held.popitem(last=False)
        self.held[key] = now
        return "miss" if at is None else "expired"

    def expire(self, now: float) -> int:
        """Drop what is past its time to live; how many."""
        old = [k for k, at in self.held.items() if now - at >= self.live]
        for k in old:
            del self.held[k]
        return len(old)


class _Hosts(StatefulProcessor):
    """A shard's cache as one list, least recently used first, read and written once a batch; a timer at the end of each entry's time clears those that nobody asks for again."""

    def __init__(self, most: int, live: float):
        self.most, self.live = most, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "host string, fetched double")

    def _load(self) -> LeastRecent:
        return LeastRecent(self.most, self.live, [(r[0], r[1]) for r in self.held.get()] if self.held.exists() else [])

    def _store(self, cache: LeastRecent) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if cache.held:
            self.held.put([(h, at) for h, at in cache.held.items()])
            self.handle.registerTimer(int((min(cache.held.values()) + self.live) * 1000))
        else:
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cache, out = self._load(), []
        for r in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples(index=False):
            out.append((r.event_id, r.host, cache.ask(r.host, r.at), r.ts))
        self._store(cache)
        yield pd.DataFrame(out, columns=["event_id", "host", "outcome", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cache = self._load()
        cache.expire(timerValues.getCurrentWatermarkInMs() / 1000)
        self._store(cache)
        return iter([])

    def close(self) -> None:
        pass


def cached_hosts(events: DataFrame, late: str = "1 hour", most: int = MOST_HOSTS, live: float = LIVE_SECONDS, shards: int = 16) -> DataFrame:
    """event_id, host, outcome (hit, miss or expired) and ts of requests (event_id, ts, host): what a cache of host rules
    with a time to live and a bound would have answered. Hosts are dealt to shards that hold ``most`` each, so no state grows beyond that.
    """
    shard = F.pmod(F.xxhash64("host"), F.lit(shards)).cast("int")
    rows = events.withWatermark("ts", late).select("event_id", "ts", "host", F.unix_micros("ts").cast("double").alias("at"), shard.alias("shard"))
    rows = rows.withColumn("at", F.col("at") / 1e6)
    return rows.groupBy("shard").transformWithStateInPandas(_Hosts(most, live), "event_id long, host string, outcome string, ts timestamp", "append", "eventTime")


# ---- spacing of a host's requests ------------------------------------------------------------


class _Spacing(StatefulProcessor):
    """When a host's last request may start; a timer forgets a host whose next request cannot be early."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        asked = pd.concat(list(rows)).sort_values(["at", "event_id"])
        # in whole microseconds; the n-th request starts n spaces after the latest of what each earlier one, counted back by its own spaces, asked for
        step = round(self.seconds * 1e6)
        spaces = np.arange(len(asked), dtype=np.int64) * step
        free = (asked["at"].to_numpy() * 1e6).round().astype(np.int64) - spaces
        if held is not None:
            free[0] = max(free[0], round(held[0] * 1e6) + step)
            self.handle.deleteTimer(self._past(held[0]))
        start = (np.maximum.accumulate(free) + spaces) / 1e6
        self.last.update((float(start[-1]),))
        self.handle.registerTimer(self._past(float(start[-1])))
        yield pd.DataFrame({"host": key[0], "event_id": asked["event_id"].to_numpy(), "start_at": start})

    def _past(self, last: float) -> int:
        """When a host is forgotten whose last request starts at ``last``."""
        return int((last + self.seconds) * 1000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def spaced_hosts(events: DataFrame, seconds: float = 1.0, late: str = "1 hour") -> DataFrame:
    """host, event_id and start_at (seconds since 1970) of requests (event_id, ts, host), those of a host ``seconds`` apart or more; hosts that are silent leave the state."""
    rows = events.withWatermark("ts", late).select("event_id", "ts", F.col("host").cast("string").alias("host"), (F.unix_micros("ts") / 1e6).alias("at"))
    return rows.groupBy("host").transformWithStateInPandas(_Spacing(seconds), "host string, event_id long, start_at double", "append", "eventTime")
