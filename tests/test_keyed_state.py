"""State that grows by its changes: the keyed store, the timers of triggers, assignment in parts."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from khata.operators.assign import assign_in_parts
from khata.operators.connected import components
from khata.streaming import triggers
from khata.streaming.keyed_store import KeyedStore, newest_version

from .conftest import rows

SCHEMA = "a string, b long, value string"


def bytes_under(path) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def changed(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def test_newest_rows_of_keys(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), SCHEMA, ["a", "b"], ["a"], buckets=4, most_parts=2)
    want = {}
    rng = random.Random(1)
    for epoch in range(7):
        new = {(rng.choice("xyzuv"), rng.randrange(5)): f"{epoch}-{i}" for i in range(6)}
        gone = [k for k in want if rng.random() < 0.2 and k not in new]
        for again in range(2):  # every batch twice, as after a failure
            store.write(changed(spark, *((*k, v) for k, v in new.items())), store.base_version(epoch), epoch,
                        spark.createDataFrame(gone, "a string, b long") if gone else None)
        want = {k: v for k, v in (want | new).items() if k not in gone}
        assert newest_version(spark, str(tmp_path)) == epoch
        assert rows(store.read(epoch), "a", "b", "value") == sorted((*k, v) for k, v in want.items())
    assert max(len(r["parts"]) for r in store.commit(6)) <= 2
    only = store.buckets_of(changed(spark, ("x", 0, "")))
    assert len(only) == 1 and {k for k in want if k[0] == "x"} <= {(r["a"], r["b"]) for r in store.read(6, only).collect()}
    assert store.read(-1).count() == 0


def test_a_batch_writes_its_changes_only(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), SCHEMA, ["a", "b"], buckets=8)
    store.write(spark.range(200_000).select(F.lit("k").alias("a"), F.col("id").alias("b"), F.sha2(F.col("id").cast("string"), 256).alias("value")), -1, 0)
    whole = bytes_under(tmp_path)
    for epoch in range(1, 4):
        before = bytes_under(tmp_path)
        store.write(changed(spark, ("k", epoch, "new")), epoch - 1, epoch)
        assert bytes_under(tmp_path) - before < whole / 100
    assert store.read(3).count() == 200_000 and rows(store.read(3).where("value = 'new'"), "b") == [(1,), (2,), (3,)]


def test_a_rewritten_bucket_frees_its_parts(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), SCHEMA, ["a", "b"], buckets=1, most_parts=2)
    for epoch in range(9):
        store.write(changed(spark, ("k", epoch % 2, str(epoch))), epoch - 1, epoch)
    held = [d for d, _, files in os.walk(tmp_path) if "store_bucket=" in os.path.basename(d) and files]
    assert len(held) <= 6 and rows(store.read(8), "b", "value") == [(0, "8"), (1, "7")]
    assert rows(store.read(7), "b", "value") == [(0, "6"), (1, "7")]  # the version before stays whole


# --- triggers as keyed state

KEY = ("T", "R", "G", "1")
START = datetime(2024, 1, 1)


def told(spark, *given, bucket="missing_in_2b", review=True, auto=True):
    return spark.createDataFrame(
        [(*KEY, bucket, e, START + timedelta(days=d), i, review, auto) for i, (e, d) in enumerate(given)],
        "tenant_id string, registration_gstin string, counterparty_gstin string, invoice_no string, bucket string, event string, at timestamp, seq long, require_review boolean, auto_followup boolean")


def actions_of(spark, tmp_path, name="run"):
    schema = told(spark, ("open", 0)).schema
    triggers.use_timers(spark)
    out = []
    stream = triggers.trigger_actions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect())).option(
        "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    run.awaitTermination(120)
    return [(r["action"], round((r["at"] - START) / timedelta(days=1), 3), r["trigger_count"]) for r in sorted(out, key=lambda r: (r["at"], r["step"]))]


def test_vendor_follow_up_is_sent_again_until_resolved(spark, tmp_path):
    told(spark, ("open", 0), ("open", 10), ("gone", 75), ("open", 80), ("approve", 81)).write.parquet(str(tmp_path / "in"))
    assert actions_of(spark, tmp_path) == [
        ("created", 0, 0), ("sent", 0, 1), ("sent", 30, 2), ("sent", 60, 3), ("resolved", 75, 3), ("reopened", 80, 3)]  # day 90 hasn't come


def test_timers_fire_and_survive_a_restart(spark, tmp_path):
    told(spark, ("open", 0)).write.parquet(str(tmp_path / "in"))
    assert actions_of(spark, tmp_path) == [("created", 0, 0), ("sent", 0, 1)]
    # time goes on by what is told about another trigger; this one has no rows of its own
    other = told(spark, ("open", 65)).withColumn("invoice_no", F.lit("2"))
    other.write.mode("append").parquet(str(tmp_path / "in"))
    got = actions_of(spark, tmp_path)
    assert [x for x in got if x[1] in (30, 60)] == [("sent", 30, 2), ("sent", 60, 3)]
    told(spark, ("gone", 70), ("open", 200)).write.mode("append").parquet(str(tmp_path / "in"))
    got = actions_of(spark, tmp_path)
    assert [x for x in got if x[0] != "sent"] == [("resolved", 70, 3), ("reopened", 200, 3)] and ("sent", 200, 4) in got


@pytest.mark.parametrize("review,auto,bucket,want", [
    (True, True, "not_in_books", [("created", 0, 0), ("approved", 5, 0), ("sent", 5, 1), ("sent", 35, 2)]),
    (False, False, "not_in_books", [("created", 0, 0), ("sent", 0, 1), ("sent", 30, 2)]),
    (True, False, "missing_in_2b", [("created", 0, 0)]),
])
def test_policies(spark, tmp_path, review, auto, bucket, want):
    told(spark, ("gone", -1), ("open", 0), ("approve", 5), ("reject", 6), ("open", 40), bucket=bucket, review=review, auto=auto).write.parquet(str(tmp_path / "in"))
    assert actions_of(spark, tmp_path) == want


# --- assignment

def served(pairs):
    taken, done, out = set(), set(), []
    for g, a, b in sorted(pairs, key=lambda p: (str(p[0]), p[1], p[2])):
        if (g, a) not in done and (g, b) not in taken:
            done.add((g, a))
            taken.add((g, b))
            out.append((a, b))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_large_groups_are_served_in_parts(spark, seed):
    rng = random.Random(seed)
    pairs = {("g", rng.randrange(300), 1000 + rng.randrange(200)) for _ in range(700)}
    pairs |= {("h", i, j) for i in range(60) for j in (i, i + 1)} | {("h", 500, 700 + j) for j in range(90)} | {("h", 600 + i, 900) for i in range(90)} | {(None, 1, 1)}
    df = spark.createDataFrame(sorted(pairs, key=str), "g string, l int, r int").repartition(5)
    for most in (50, 10_000):
        assert sorted(map(tuple, assign_in_parts(df, "l", "r", within=("g",), most_pairs=most).collect())) == served(pairs)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), *((i, i + 1) for i in range(100, 180)), *((200, i) for i in range(201, 230))]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a int, b int")).collect()))
    assert got[3] == 1 and got[9] == 8 and got[5] == 5 and got[180] == 100 and got[229] == 200 and len(got) == 3 + 2 + 1 + 81 + 30


# --- gaps in texts

@pytest.mark.parametrize("few", [0, 3, 64])
def test_gaps_are_found_however_many_a_gstin_has(spark, few):
    from khata.operators import state

    crowded, quiet = "27AAAAA0000A1Z5", "06BBBBB0000B1Z5"
    gaps = spark.createDataFrame(
        [(crowded, f"INV/{i:05}", "05-01-2024") for i in range(40)] + [(quiet, "Q-1", "05-01-2024"), (quiet, "Q-2", "05-03-2024"), ("", "X", "05-01-2024")],
        "gst_no string, supplier_inv string, invoice_date string")
    docs = spark.createDataFrame(
        [(1, "2024-01-01", f"to {crowded} inv 00003 INV/00007"), (2, "2024-02-01", f"{crowded.lower()} inv-00011 {quiet} q 1"), (3, "2024-03-01", f"{crowded} INV/00020"),
         (4, "2024-01-01", "INV/00030 of nobody"), (5, "2024-03-01", f"{quiet} Q2"), (6, "2024-01-01", None)], "doc_id int, month string, text string")
    got = state.verify_gaps(gaps, docs.withColumn("month", F.col("month").cast("date")), few=few)
    assert got.count() == 43
    assert rows(got.where("in_drive = 'Yes'"), "supplier_inv") == [("INV/00003",), ("INV/00007",), ("INV/00011",), ("Q-1",), ("Q-2",)]


def test_triggers_take_rows_not_frames(spark, tmp_path):
    from pyspark.sql import Row

    class Kept:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Handle:
        registerTimer = deleteTimer = staticmethod(lambda at_ms: None)

    follow = triggers.FollowUp(timedelta(days=30), processing=False)
    follow.handle, follow.state = Handle(), Kept()
    given = [Row(event=e, at_us=at, seq=i, require_review=True, auto_followup=True) for i, (e, at) in enumerate([("gone", 9_000), ("open", 2_000)])]
    key = ("T", "R", "G", "1", "missing_in_2b")
    got = [(r.at_ms, r.action, r.status, r.trigger_count) for r in follow.handleInputRows(key, iter(given), None)]
    assert got == [(2, "created", "queued", 0), (2, "sent", "sent", 1), (9, "resolved", "resolved", 1)]
    assert follow.state.get()[0] == "resolved"
