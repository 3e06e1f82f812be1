"""Stateful streams against the same rows at once, and what a replay changes."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pandas as pd
import pytest
from millrace.operators import dedup
from millrace.plans import landed
from millrace.streaming import progress, sink, state
from pyspark.sql import functions as F


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    state.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def land(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:04d}")


def stream(spark, folder, schema):
    """One batch for each landed folder, in order of their times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def texts(rng, n):
    words = [f"word{k}" for k in range(400)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(rng.choice([" ".join(w), " ".join(w), "short", rng.choice(base)]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_first_kept_of_a_stream(spark, tmp_path, seed):
    """For batches of any size in any order, the rows that a stream keeps are those of the sequential rule over arrivals."""
    rng = random.Random(seed)
    rows = [(k, t) for k, t in enumerate(texts(rng, 70))]
    cuts = sorted(rng.sample(range(1, 70), 3))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 70])]
    for b in batches:
        rng.shuffle(b)
    land(spark, str(tmp_path / "in"), batches, "id long, text string")
    state.first_kept_stream(stream(spark, str(tmp_path / "in"), "id long, text string"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    log = sink.KeyedLog(spark, str(tmp_path / "out"), ["id"], "id long, kept boolean")
    found = {r.id: r.kept for r in log.table().collect()}
    expected = {r.id: not r.is_duplicate for r in dedup.first_kept(spark.createDataFrame(rows, "id long, text string"), order="id").collect()}
    assert found == expected and 0 < sum(found.values()) < 70 and len(log.batches()) >= 4
    # the last batch written again: nothing changes
    last = log.batches()[-1]
    ids = [r.id for r in log.rows().where(F.col("batch") == last).collect()]
    log.write(spark.createDataFrame([(i, found[i]) for i in ids], "id long, kept boolean"), last)
    assert {r.id: r.kept for r in log.table().collect()} == found


def test_least_recent_on_a_manual_clock():
    cache = state.LeastRecent(2, 10.0)
    assert [cache.ask("a", 0), cache.ask("b", 1), cache.ask("a", 2), cache.ask("c", 3)] == ["miss", "miss", "hit", "miss"]
    assert list(cache.held) == ["a", "c"] and cache.ask("b", 4) == "miss" and list(cache.held) == ["c", "b"]  # a was asked before c
    assert cache.ask("c", 12.9) == "hit" and cache.ask("c", 13) == "expired" and cache.ask("b", 13.5) == "hit"
    assert cache.expire(14) == 1 and list(cache.held) == ["c"] and cache.expire(23) == 1 and not cache.held


def requests(rng, n, hosts):
    at = datetime(2026, 1, 1)
    out = []
    for k in range(n):
        at += timedelta(seconds=rng.choice([1, 60, 3600, 9000]))
        out.append((k, at, f"h{int(rng.paretovariate(1)) % hosts}"))
    return out


def test_cached_hosts_expire_and_give_way(spark, tmp_path):
    rows = requests(random.Random(4), 240, 12)
    land(spark, str(tmp_path / "in"), [rows[k : k + 60] for k in range(0, 240, 60)], "event_id long, ts timestamp, host string")
    events = stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, host string")
    found = {r.event_id: r.outcome for r in progress.run_once(state.cached_hosts(events, most=3, live=86_400.0, shards=1), "hosts_once").collect()}
    held, expected = OrderedDict(), {}
    for event, ts, host in rows:
        now = ts.timestamp()
        at = held.pop(host, None)
        expected[event] = "miss" if at is None else "hit" if now - at < 86_400 else "expired"
        if expected[event] == "hit":
            held[host] = at
        else:
            if len(held) >= 3:
                held.popitem(last=False)
            held[host] = now
    # timers clear what has expired, so the stream may say miss where a list without timers says expired
    same = lambda x: "miss" if x == "expired" else x
    assert {k: same(v) for k, v in found.items()} == {k: same(v) for k, v in expected.items()}
    assert {"hit", "miss"} <= set(found.values()) and "expired" in expected.values()


def test_spacing_forgets_silent_hosts(spark, tmp_path):
    rows = requests(random.Random(5), 150, 5)
    land(spark, str(tmp_path / "in"), [rows[k : k + 50] for k in range(0, 150, 50)], "event_id long, ts timestamp, host string")
    found = {r.event_id: r.start_at for r in progress.run_once(state.spaced_hosts(stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, host string"), 5000.0), "spaced_hosts_once").collect()}
    last = {}
    for event, ts, host in rows:
        last[host] = max(ts.timestamp(), last.get(host, float("-inf")) + 5000)
        assert abs(found[event] - last[host]) < 1e-3


class Held(dict):
    """A map or value of the state that counts what is asked of it."""

    asked = 0

    def exists(self):
        return bool(self)

    def getValue(self, key):
        self.asked += 1
        return dict.get(self, key)

    def updateValue(self, key, value):
        self[key] = value

    def get(self):
        return dict.get(self, 0)

    def update(self, value):
        self[0] = value


class Handle:
    def __init__(self):
        self.map, self.value, self.timers = Held(), Held(), set()
        self.getMapState, self.getValueState = (lambda *a: self.map), (lambda *a: self.value)
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove


class Clock:
    def __init__(self, ms):
        self.getCurrentProcessingTimeInMs = lambda: ms


def test_blocks_of_a_part_are_asked_once_and_forgotten_alone():
    """One group holds many blocks; a batch reads those that it asks, once each, and an entry is forgotten by its own age."""
    handle, blocks = Handle(), state._Blocks(1000)
    blocks.init(handle)
    p = [0, 1 << 63 >> 5, 0b1011 << 40]
    batch = lambda rows, ms: sorted((r.b, -1 if pd.isna(r.a) else int(r.a)) for out in blocks.handleInputRows((-1, 3), iter([pd.DataFrame(rows, columns=["id", "content_hash", "p", "v"])]), Clock(ms)) for r in out.itertuples())
    rows = [(k, f"h{k % 5}", p[0], k % 5) for k in range(40)]
    first = batch(rows, 0)
    assert first == sorted([(k, -1) for k in range(40)] + [(k, k % 5) for k in range(5, 40)]) and handle.map.asked == 0
    assert batch([(50, "h1", p[1], 1), (51, "h1", p[0], 1), (52, "new", p[0], 9)], 600) == [(50, -1), (50, 1), (51, -1), (51, 1), (52, -1)]
    assert handle.map.asked == 2
    # row 1 is past its time, row 50 is not
    assert batch([(60, "h1", p[2], 1)], 1200) == [(60, -1), (60, 50)]
    assert batch([(70, "h1", p[0], 1)], 5000) == [(70, -1)]


def test_spacing_is_that_of_a_loop_to_the_microsecond():
    rng, handle, spacing = random.Random(8), Handle(), state._Spacing(2.5)
    spacing.init(handle)
    last, at = None, 1_704_067_200_000_000
    for _ in range(5):
        times = []
        for _ in range(rng.randrange(1, 40)):
            at += rng.choice([0, 1, 2_499_999, 2_500_000, 7_000_003])
            times.append(at)
        asked = pd.DataFrame({"event_id": range(len(times)), "at": [t / 1e6 for t in times]}).sample(frac=1, random_state=1)
        found = next(spacing.handleInputRows(("h",), iter([asked[:3], asked[3:]]), None))
        for t, start in zip(times, found.sort_values("event_id")["start_at"]):
            last = t if last is None else max(t, last + 2_500_000)
            assert start == last / 1e6
        assert handle.timers == {int((last / 1e6 + 2.5) * 1000) + 1}


def test_landings_are_whole_batches_of_several_files(spark):
    """Rows land in their order, each landing one micro-batch that no single task has to write or read."""
    seen, small = {}, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "0"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        start = lambda stream, to: stream.writeStream.option("checkpointLocation", f"{to}/checkpoint").foreachBatch(lambda rows, k: seen.update({k: sorted(r.id for r in rows.collect())})).trigger(availableNow=True).start()
        folder = landed._arrived(spark, spark.range(1000).select((999 - F.col("id")).alias("id")), ["id"], 3, start)
    finally:
        for key in small:
            spark.conf.unset(key)
    assert [seen[k] for k in sorted(seen)] == [list(range(334)), list(range(334, 667)), list(range(667, 1000))]
    assert all(spark.read.parquet(f"{folder}/in/{k:03d}").inputFiles()[1:] for k in range(3))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    log = sink.KeyedLog(spark, str(tmp_path / "log"), ["k"], "k long, v string")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    table = lambda: {r.k: (r.v, r.batch) for r in log.table().collect()}
    assert table() == {} and log.batches() == []
    log.write(frame([(1, "a"), (2, "b")]), 0)
    log.write(frame([(2, "c"), (3, None)]), 1)
    log.write(frame([]), 2)
    assert table() == {1: ("a", 0), 2: ("c", 1), 3: (None, 1)}
    log.write(frame([(2, "c"), (3, None)]), 1)
    log.write(frame([(1, "a"), (2, "b")]), 0)
    assert table() == {1: ("a", 0), 2: ("c", 1), 3: (None, 1)}
    log.compact()
    assert log.batches() == [2] and {k: v for k, (v, _) in table().items()} == {1: "a", 2: "c", 3: None}
    log.write(frame([(1, "z")]), 0)  # folded already
    assert {k: v for k, (v, _) in table().items()} == {1: "a", 2: "c", 3: None}
    log.write(frame([(1, "new")]), 3)
    assert table()[1] == ("new", 3)


def test_progress_in_update_mode_equals_the_batch(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").collect()]
    land(spark, str(tmp_path / "in"), [rows[k::3] for k in range(3)], progress.EVENTS)
    log = sink.KeyedLog(spark, str(tmp_path / "log"), ["window_start", "event_type"], "window_start timestamp, event_type string, n long, total double")
    sink.keyed(progress.progress(stream(spark, str(tmp_path / "in"), progress.EVENTS), late="1000 days"), log, str(tmp_path / "cp")).awaitTermination()
    key = lambda found: {(r.window_start, r.event_type): (r.n, round(r.total, 6)) for r in found.collect()}
    assert key(log.table()) == key(progress.progress(spark.createDataFrame(rows, progress.EVENTS))) and len(log.batches()) == 3


def test_jobs_are_claimed_once(spark, tmp_path):
    at = datetime(2026, 1, 1)
    schema = "id long, submitted_at timestamp, keyword string"
    batches = [[(k, at + timedelta(minutes=10 - k % 7, hours=b), f"k{k}") for k in range(b * 4, b * 4 + 4)] for b in range(3)]
    batches[1].append(batches[0][0])  # submitted twice
    land(spark, str(tmp_path / "in"), batches, schema)
    log = sink.KeyedLog(spark, str(tmp_path / "log"), ["id"], schema + ", status string")
    change = sink.claimed(log, 3)
    sink.keyed(stream(spark, str(tmp_path / "in"), schema), log, str(tmp_path / "cp"), "append", change).awaitTermination()
    by_batch = {b: {r.id for r in log.rows().where((F.col("batch") == b) & (F.col("status") == "processing")).collect()} for b in log.batches()}
    waiting, taken = [], set()
    for b, rows in zip(sorted(by_batch), batches):
        known = taken | {r[0] for r in waiting}
        waiting += [r for r in rows if r[0] not in known]
        waiting.sort(key=lambda r: (r[1], r[0]))
        now, waiting = waiting[:3], waiting[3:]
        assert by_batch[b] == {r[0] for r in now}
        taken |= by_batch[b]
    assert len(taken) == 9
    before = {r.id: r.status for r in log.table().collect()}
    last = log.batches()[-1]
    log.write(change(spark.createDataFrame(batches[2], schema), last), last)
    assert {r.id: r.status for r in log.table().collect()} == before
