"""Writers and streams that die between two steps, or meet each other."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestar.sources import commits, store
from lodestar.streaming import events as V

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_null_keys_are_one_key(spark):
    old, new = frame(spark, [(1, "a"), (None, "b")], "id long, name string"), frame(spark, [(None, "c"), (2, "d")], "id long, name string")
    assert sorted((r.id or 0, r.name) for r in store.upsert(old, new, "id").collect()) == [(0, "c"), (1, "a"), (2, "d")]


# --- tables changed together


def test_a_batch_of_verbs_is_one_version(spark, tmp_path):
    tables = commits.Tables(spark, str(tmp_path / "t"))
    nodes = frame(spark, [("a#f", "a"), ("a#g", "a"), ("b#h", "b")], "id string, file_path string")
    edges = frame(spark, [("a#f", "b#h", "call", 1, 1), ("a#f", "a#g", "call", 2, 1)], "source string, target string, kind string, line int, col int")
    first = tables.commit(lambda v: commits.apply_verbs(v, [("upsert", "nodes", nodes, "id"), ("insert_edges", edges)]))
    assert first.number == 1 and ids(first.read("nodes")) == ["a#f", "a#g", "b#h"]
    gone = frame(spark, [("b",)], "path string")
    more = frame(spark, [("c#k", "c")], "id string, file_path string")
    second = tables.commit(lambda v: commits.apply_verbs(v, [("remove_files", gone), ("upsert", "nodes", more, "id"), ("insert_edges", edges.where("line = 2"))]))
    assert ids(second.read("nodes")) == ["a#f", "a#g", "c#k"] and second.read("edges").count() == 1
    # A reader that began before still sees all of its version.
    assert ids(first.read("nodes")) == ["a#f", "a#g", "b#h"] and tables.version(1).read("edges").count() == 2
    with pytest.raises(ValueError):
        commits.apply_verbs(second, [("drop", "nodes")])


def test_a_crash_between_two_tables_changes_none(spark, tmp_path):
    tables = commits.Tables(spark, str(tmp_path / "t"))
    one = spark.range(3).toDF("id")
    tables.commit(lambda v: {"a": one, "b": one})
    bad = spark.range(5).select(F.expr("if(id = 4, raise_error('dies'), id)").alias("id"))
    with pytest.raises(Exception, match="dies"):
        tables.commit(lambda v: {"a": spark.range(9).toDF("id"), "b": bad})
    now = tables.version()
    assert now.number == 1 and now.read("a").count() == now.read("b").count() == 3
    tables.commit(lambda v: {"b": spark.range(4).toDF("id")})
    tables.commit(lambda v: {"b": spark.range(5).toDF("id")})
    # What a writer may have under way stays; what only old versions name goes.
    assert tables.vacuum(keep=1) == 2 and tables.version().read("a").count() == 3
    assert tables.vacuum(keep=1, orphans_after_s=-1) >= 1 and tables.version().read("b").count() == 5


def test_two_writers_lose_nothing(spark, tmp_path):
    tables, seen = commits.Tables(spark, str(tmp_path / "t")), []
    tables.commit(lambda v: {"a": spark.range(0, 1).toDF("id")})

    def add(k):
        def change(v):
            seen.append(v.number)
            time.sleep(0.3)
            return {"a": v.read("a").union(spark.range(k, k + 1).toDF("id"))}

        tables.commit(change)

    threads = [threading.Thread(target=add, args=(k,)) for k in (10, 20, 30)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert ids(tables.version().read("a")) == [0, 10, 20, 30] and tables.version().number == 4 and len(seen) > 3
    with pytest.raises(commits.Conflict):
        tables.commit(lambda v: commits.Tables(spark, tables.path).commit(lambda w: {"a": w.read("a")}) and {"a": v.read("a")}, retries=2)


def test_swaps_leave_others_unfinished_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    store.swap(spark.range(1), path)
    (tmp_path / "s" / "v-underway").mkdir()
    for n in (2, 3, 4):
        store.swap(spark.range(n), path)
    names = {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()}
    assert "v-underway" in names and len(names) == 3 and store.read_snapshot(spark, path).count() == 4
    assert not [p for p in (tmp_path / "s").iterdir() if "next" in p.name]


# --- logs and leases


def test_deviations_of_a_slot_are_written_once(spark, tmp_path, monkeypatch):
    log, schema = str(tmp_path / "log"), "event_id long, probe string"
    batch = lambda k: frame(spark, [(k, "error"), (k + 100, "ok")], schema)
    add = lambda k: store.append_ring(batch(k), log, F.col("probe") == "error", slot_bytes=1, keep=2)
    add(0), add(1)
    real, fails = store._files, [True]

    def dying(spark_, path):
        fs, root, make = real(spark_, path)

        class Dies:
            def __getattr__(self, name):
                return getattr(fs, name)

            def delete(self, p, deep):
                if fails and "slot=" in p.toString():
                    fails.clear()
                    raise OSError("killed")
                return fs.delete(p, deep)

        return Dies(), root, make

    monkeypatch.setattr(store, "_files", dying)
    with pytest.raises(OSError, match="killed"):
        add(2)  # the deviations are kept, the slot is not gone yet
    add(3)
    assert sorted(r.event_id for r in store.read_ring(spark, log, schema, "deviations").collect()) == [0, 1]


def test_a_lease_passes_on_when_its_holder_dies(spark, tmp_path):
    path = str(tmp_path / "x" / "flight")
    a, b, c = store.Lease(spark, path, 0.6), store.Lease(spark, path, 60), store.Lease(spark, path, 60)
    assert a.take() and not b.take()
    a.renew()
    time.sleep(0.7)
    assert b.take() and not c.take()
    with pytest.raises(RuntimeError, match="taken over"):
        a.renew()
    a.release()
    assert not c.take()
    b.release()
    assert c.take()


def test_backfill_goes_on_after_a_killed_run(spark, tmp_path):
    spark.range(40).repartition(8).write.parquet(str(tmp_path / "in"))
    files = lambda: V.stream_files(spark, str(tmp_path / "in"), "id long", files_per_batch=3)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    killed = store.Lease(spark, f"{check}.flight", 0.5)  # died without a word
    assert killed.take() and not V.backfill(files(), lambda df, k: None, check)
    time.sleep(0.6)
    assert V.backfill(files(), lambda df, k: df.write.mode("append").parquet(out), check)
    assert spark.read.parquet(out).count() == 40 and V.backfill(files(), lambda df, k: None, check)


# --- state of streams


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_byte_ring_stream(spark, tmp_path, rocks):
    rows = [(p, k, 10 + k % 7) for p in ("a", "b") for k in range(60)] + [("a", 60, 500), ("b", 60, 3)]
    frame(spark, rows, "probe string, seq long, bytes long").repartitionByRange(5, "seq").sortWithinPartitions("seq").write.parquet(str(tmp_path / "in"))
    out = {}
    ring = V.byte_ring(V.stream_files(spark, str(tmp_path / "in"), "probe string, seq long, bytes long", files_per_batch=1), 100)
    V.run_to_end(ring, lambda df, k: out.update({r.probe: tuple(r)[1:] for r in df.collect()}), str(tmp_path / "state"), "update")
    held = []
    for _, seq, size in [r for r in rows if r[0] == "b"]:
        held.append((seq, size))
        while sum(s for _, s in held) > 100:
            held.pop(0)
    assert out["b"] == (len(held), sum(s for _, s in held), held[0][0], held[-1][0]) and out["a"] == (1, 500, 60, 60)


def test_changes_are_flushed_by_timers(spark, tmp_path, rocks):
    source, got = tmp_path / "in", []
    source.mkdir()

    def put(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(dict(zip(("project", "path", "change", "time_ms"), r, strict=True))) for r in rows))
        (tmp_path / name).rename(source / name)

    changes = spark.readStream.schema("project string, path string, change string, time_ms long").json(str(source))
    failed = []

    def handle(df, batch):
        rows = df.collect()
        if rows and not failed:
            failed.append([tuple(r) for r in rows])
            raise RuntimeError("the batch fails once")
        got.extend(rows)

    start = lambda: V.flush_stream(changes, 300, 60_000).writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="100 milliseconds").start()
    put("0.json", [("p", "a", "added", 1), ("p", "a", "changed", 3), ("p", "b", "added", 2), ("q", "a", "deleted", 1)])
    q = start()
    with pytest.raises(Exception, match="fails once"):
        q.awaitTermination(120)
    q = start()
    try:
        end = time.time() + 90
        while len(got) < 3 and time.time() < end:
            time.sleep(0.3)
        put("1.json", [("p", "a", "deleted", 9)])
        while len(got) < 4 and time.time() < end:
            time.sleep(0.3)
    finally:
        q.stop()
    assert sorted((r.project, r.path, r.change, r.n) for r in got) == [("p", "a", "changed", 2), ("p", "a", "deleted", 1), ("p", "b", "added", 1), ("q", "a", "deleted", 1)]
    assert len({r.flush_ms for r in got if r.project == "p"}) == 2 and failed
