import datetime as dt

from pairloom import schemas
from pairloom.streaming.watch import watch_ledger

T0 = dt.datetime(2024, 1, 1)


def write(spark, path, rows):
    data = [("r", p, s, T0 + dt.timedelta(hours=i)) for i, (p, s) in enumerate(rows)]
    spark.createDataFrame(data, schemas.LEDGER).coalesce(1).write.mode("append").parquet(path)


def test_each_success_once_over_batches_and_restarts(spark, tmp_path):
    ledger, state, seen = str(tmp_path / "ledger"), str(tmp_path / "state"), []

    def process(packages, batch_id):
        seen.append((batch_id, sorted(r.package for r in packages.collect())))

    write(spark, ledger, [("a", "success"), ("a", "success"), ("b", "failed")])
    write(spark, ledger, [("a", "failed"), ("b", "success"), ("c", "success")])
    watch_ledger(spark, ledger, process, state, files_per_batch=1).awaitTermination()
    assert len(seen) == 2 and sorted(p for _, ps in seen for p in ps) == ["a", "b", "c"]

    write(spark, ledger, [("c", "success"), ("d", "success")])
    watch_ledger(spark, ledger, process, state).awaitTermination()
    assert seen[2:] == [(2, ["d"])]


def test_failed_batch_is_repeated_with_the_same_work(spark, tmp_path):
    ledger, state, seen = str(tmp_path / "ledger"), str(tmp_path / "state"), []

    def process(packages, batch_id):
        seen.append((batch_id, sorted(r.package for r in packages.collect())))
        if len(seen) == 1:
            raise RuntimeError("lost")

    write(spark, ledger, [("a", "success")])
    try:
        watch_ledger(spark, ledger, process, state).awaitTermination()
    except Exception:
        pass
    watch_ledger(spark, ledger, process, state).awaitTermination()
    assert seen == [(0, ["a"]), (0, ["a"])]


def test_forced_watch_repeats(spark, tmp_path):
    ledger, seen = str(tmp_path / "ledger"), []
    write(spark, ledger, [("a", "success")])
    write(spark, ledger, [("a", "success")])
    watch_ledger(spark, ledger, lambda p, b: seen.append(p.count()), str(tmp_path / "state"), force=True,
                 files_per_batch=1).awaitTermination()
    assert seen == [1, 1]


def test_a_late_failure_takes_a_success_back_until_it_has_settled(spark, tmp_path):
    ledger, seen = str(tmp_path / "ledger"), []

    def batch(*rows):
        data = [("r", p, s, T0 + dt.timedelta(minutes=m)) for p, s, m in rows]
        spark.createDataFrame(data, schemas.LEDGER).coalesce(1).write.mode("append").parquet(ledger)
        watch_ledger(spark, ledger, lambda packages, _: seen.extend(r.package for r in packages.collect()),
                     str(tmp_path / "state"), settle="10 minutes").awaitTermination()

    batch(("a", "success", 0), ("b", "success", 1))
    assert seen == []
    batch(("a", "failed", 5))
    batch(("c", "failed", 60), ("c", "failed", 61))
    assert seen == ["b"]
    batch(("b", "success", 62), ("c", "failed", 120))
    batch(("c", "failed", 240))
    assert seen == ["b"]


def test_state_is_kept_for_the_packages_of_a_batch_only(spark, tmp_path):
    ledger, seen = str(tmp_path / "ledger"), []
    write(spark, ledger, [(f"p{i}", "success") for i in range(300)])
    query = watch_ledger(spark, ledger, lambda p, b: seen.append(p.count()), str(tmp_path / "state"))
    query.awaitTermination()
    write(spark, ledger, [("p7", "success"), ("new", "success")])
    query = watch_ledger(spark, ledger, lambda p, b: seen.append(p.count()), str(tmp_path / "state"))
    query.awaitTermination()
    assert seen == [300, 1]
    assert sum(op["numRowsUpdated"] for op in query.lastProgress["stateOperators"]) == 2
