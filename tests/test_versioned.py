"""Versioned tables, upserts with compaction, key tables."""

import random

import pytest
from pyspark.sql import functions as F

from relaylake.sinks.versioned import ConcurrentWrite, UpsertTable, VersionedTable
from relaylake.streaming.keytable import KeyTable

LEDGER = "run_key string, status string, seq long"


def test_versions_switch_atomically(spark, tmp_dir):
    t = VersionedTable(spark, f"{tmp_dir}/t", "id long, note string")
    rows = lambda n: spark.range(n).select("id", F.lit("x").alias("note"))
    assert t.version() == -1 and t.read().count() == 0
    t.overwrite(rows(3))
    t.append(rows(2), batch=7)
    assert t.append(rows(2), batch=7) == t.version() == 1  # a replay
    assert t.read().count() == 5 and t.read(0).count() == 3
    bad = spark.range(3).select("id", F.raise_error(F.lit("no")).cast("string").alias("note"))
    with pytest.raises(Exception):
        t.overwrite(bad)
    assert t.version() == 1 and t.read().count() == 5  # a failed write leaves the old version
    base = t.manifest()
    t.overwrite(rows(1))
    with pytest.raises(ConcurrentWrite):
        t.commit(base, base["entries"])
    t.vacuum(keep=1)
    assert t.versions() == [2] and t.read().count() == 1


def test_upserts_keep_the_latest_row(spark, tmp_dir):
    rng = random.Random(1)
    rows = [(f"k{rng.randint(0, 30)}", rng.choice(["in_progress", "succeeded", "failed", None]), seq) for seq in range(200)] + [("k1", "succeeded", None), (None, "failed", 3)]
    rng.shuffle(rows)
    t = UpsertTable(spark, f"{tmp_dir}/t", LEDGER, ["run_key"], ["seq"], max_deltas=3)
    files = []
    for batch, at in enumerate(range(0, len(rows), 20)):
        part = spark.createDataFrame(rows[at:at + 20], LEDGER)
        t.upsert(part, batch)
        t.upsert(part, batch)  # replayed after a failure
        files.append(len(t.manifest()["entries"]))
    assert max(files) <= 4 and t.manifest()["batch"] == len(files) - 1
    want = {}
    for k, s, seq in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0)):
        want[k] = (s, seq)
    assert {r.run_key: (r.status, r.seq) for r in t.latest().collect()} == want
    t.upsert(spark.createDataFrame(rows[:20], LEDGER), 0)  # an old batch once more
    assert {r.run_key: (r.status, r.seq) for r in t.latest().collect()} == want


def test_key_table_opens_few_files(spark, tmp_dir):
    keys = lambda a, b: spark.range(a, b).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    t = KeyTable(spark, f"{tmp_dir}/t", keys_per_file=100, max_deltas=2)
    assert t.without_known(keys(0, 5), "key").count() == 5  # an empty table
    t.add(keys(0, 20_000), 0)
    t.add(keys(0, 20_000), 0)
    t.compact()
    t.add(keys(20_000, 20_050), 1)
    assert len(t.table.manifest()["entries"]) == 2
    all_files = t._parts(t.table.manifest(), "files").count()
    assert all_files >= 200
    new = keys(50_000, 50_100)  # 100 keys, none of them there
    assert len(t.files_for(new)) <= 10
    mixed = new.unionByName(keys(19_990, 20_010)).unionByName(spark.createDataFrame([(None,)], "key string"))
    assert len(t.files_for(mixed.where("key IS NOT NULL"))) <= 25
    left = t.without_known(mixed, "key")
    assert sorted(r.key or "" for r in left.collect()) == sorted(["", *(r.key for r in new.collect())])
    t.add(keys(20_050, 20_060), 2)
    t.add(keys(20_060, 20_070), 3)
    assert len(t.table.manifest()["entries"]) == 1  # compacted
    assert t.without_known(keys(0, 20_080), "key").count() == 10
