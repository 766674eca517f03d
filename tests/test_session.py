from types import SimpleNamespace

import pytest

from pairloom import session


def fake(master, configured=None):
    context = SimpleNamespace(
        master=master, chosen=None, getCheckpointDir=lambda: context.chosen,
        setCheckpointDir=lambda d: setattr(context, "chosen", d),
        getConf=lambda: SimpleNamespace(get=lambda key: None),
    )
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: configured or default))


def test_checkpoints_go_where_the_session_says(spark):
    assert session.checkpoint_root(fake("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(fake("yarn"))
    assert session.checkpoint_root(fake("local[2]")).startswith("/")
    configured = spark.conf.get("spark.checkpoint.dir")
    assert configured in session.checkpoint_root(spark)


def test_materialize_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    stored = session.materialize(spark.range(100).mapInArrow(count, "id long"))
    assert stored.count() == stored.distinct().count() == 100 and seen.value == 100


def test_stored_tables_are_dropped(spark):
    import os
    stored = session.materialize(spark.range(3))
    path = stored.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    session.drop_materialized(spark)
    assert not os.path.exists(path)


def test_batches_are_bounded_in_any_session():
    set_ = {session.BATCHES[0]: "70"}
    conf = SimpleNamespace(get=lambda key, default: set_.get(key, default), set=lambda key, value: set_.update({key: value}))
    session.bound_batches(SimpleNamespace(conf=conf))
    assert set_ == {session.BATCHES[0]: "70", session.BATCHES[1]: str(8 * 1024 * 1024)}


def test_queries_bound_batches(spark):
    fresh = spark.newSession()
    for key in session.BATCHES:
        fresh.conf.unset(key)
    session.ship_package(fresh)
    assert all(fresh.conf.get(key) for key in session.BATCHES)
    assert int(fresh.conf.get(session.BATCHES[1]).rstrip("b")) <= 8 * 1024 * 1024
