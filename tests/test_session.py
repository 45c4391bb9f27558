"""Session helpers: cluster sizing, split estimate, checkpoint folder."""

from relaylake import session
from relaylake.sources import tables


def test_cluster_settings_scale_with_input():
    small = session.cluster_settings(1 << 30, 64)
    big = session.cluster_settings(100 * 10**12, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 3 * 64          # at least three waves of tasks
    assert int(big["spark.sql.shuffle.partitions"]) == -(-100 * 10**12 // (256 << 20))
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(big["spark.sql.adaptive.autoBroadcastJoinThreshold"]) == 64 << 20


def test_scan_is_spread_only_where_the_session_says_so(spark):
    plain = tables.table(spark, "/root/testdata/sf0.001", "orders", spread=True)
    assert plain.rdd.getNumPartitions() == 1
    spark.conf.set(tables.SCAN_PARTITIONS, "3")
    spread = tables.table(spark, "/root/testdata/sf0.001", "orders", spread=True)
    spark.conf.unset(tables.SCAN_PARTITIONS)
    assert spread.rdd.getNumPartitions() == 3 and spread.count() == plain.count()


def test_checkpoint_dir_is_read_from_the_session(spark):
    d = session.checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir()
    assert session.scratch_path(spark, "x").startswith(d)


def test_unset_folder_raises_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from relaylake.session import checkpoint_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
