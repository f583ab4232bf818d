"""The ensemble that refuses: against batch statistics, and each reason by a history of its own."""

import pytest
from pyspark.sql import functions as F

from halyard.streaming.checked import EnsembleStore, RefusedHistories

SCHEMA = "h string, t int, time double, state string, p double"


def history(name, seed, n=12, step=1.0):
    """Two states that sum to one."""
    out = []
    for t in range(n):
        a = ((seed * 37 + t * 11) % 19) / 20
        out += [(name, t, t * step, "a", a), (name, t, t * step, "b", 1 - a)]
    return out


def changed(rows, place, **new):
    names = SCHEMA.replace(",", "").split()[::2]
    return [tuple(new.get(c, x) for c, x in zip(names, r)) if k == place else r for k, r in enumerate(rows)]


def expected(rows):
    import statistics as st

    out = {}
    for _, t, _, s, p in rows:
        out.setdefault((t, s), []).append(p)
    return {k: (len(v), st.mean(v), st.stdev(v) / len(v) ** 0.5 if len(v) > 1 else None) for k, v in out.items()}


def check(store, rows):
    found = {(r["t"], r["state"]): (r["n"], r["mean"], r["sem"]) for r in store.result().collect()}
    wanted = expected(rows)
    assert found.keys() == wanted.keys()
    for k, (n, mean, sem) in wanted.items():
        assert found[k][0] == n and found[k][1] == pytest.approx(mean, abs=1e-12)
        assert found[k][2] is None if sem is None else found[k][2] == pytest.approx(sem, abs=1e-12)


def test_each_reason_and_a_batch_run_again(spark, tmp_path):
    store = EnsembleStore(spark, str(tmp_path / "store"))
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    one = history("h1", 1)
    falling = [(h, t, -time, s, p) for h, t, time, s, p in history("h0", 8)]
    store.fold(make(one + falling), 0)
    check(store, one)
    bad = {
        "copy": ("duplicate", [("copy", *r[1:]) for r in one]),
        "null": ("value", changed(history("null", 3), 4, p=None)),
        "short": ("shape", history("short", 4, n=11)),
        "twice": ("shape", history("twice", 5) + history("twice", 5)[:1]),
        "ragged": ("shape", history("ragged", 5)[1:]),
        "grid": ("time grid", history("grid", 6, step=1.5)),
        "last": ("time grid", changed(changed(history("last", 6), 22, time=11.5), 23, time=11.5)),
        "range": ("range", changed(changed(history("range", 7), 4, p=1.9), 5, p=-0.9)),
        "sum": ("sum", changed(history("sum", 8), 6, p=0.99)),
    }
    two, three = history("h2", 2), history("h3", 3)
    batch = make(two + three + [("h9", *r[1:]) for r in three] + [r for _, rows in bad.values() for r in rows])
    store.fold(batch, 1)
    check(store, one + two + three)
    store.fold(batch, 1)  # the same batch again
    store.fold(make(one), 2)  # the same name again
    check(store, one + two + three)
    told = {(r["h"], r["batch"]): r["reason"] for r in store.refused().collect()}
    assert told == {("h0", 0): "time grid", ("h9", 1): "duplicate", ("h1", 2): "duplicate"} | {(h, 1): reason for h, (reason, _) in bad.items()}


def test_strict_takes_nothing_and_empty_batches_change_nothing(spark, tmp_path):
    store = EnsembleStore(spark, str(tmp_path / "store"), strict=True)
    with pytest.raises(ValueError):
        store.result()
    one, two = history("h1", 1), history("h2", 2)
    store.fold(spark.createDataFrame(one, SCHEMA), 0)
    with pytest.raises(RefusedHistories, match="h3: time grid"):
        store.fold(spark.createDataFrame(two + history("h3", 3, step=2.0), SCHEMA), 1)
    store.fold(spark.createDataFrame([], SCHEMA), 2)
    check(store, one)
    store.fold(spark.createDataFrame(two, SCHEMA), 3)
    check(store, one + two)


def test_a_stream_that_starts_again(spark, tmp_path):
    files, rows = str(tmp_path / "in"), []
    store = EnsembleStore(spark, str(tmp_path / "store"))
    for k in range(3):
        new = history(f"h{k}", k + 1)
        rows += new
        arriving = spark.createDataFrame(new + [("again", *r[1:]) for r in new if k == 1], SCHEMA)
        arriving.coalesce(1).write.mode("append").parquet(files)
        stream = spark.readStream.schema(SCHEMA).parquet(files)
        query = stream.writeStream.foreachBatch(store.on_batch()).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        query.stop()
    # of equal rows in one batch the least name stays
    check(store, rows)
    assert [r["reason"] for r in store.refused().collect()] == ["duplicate"]
    assert store.refused().filter(F.col("h") == "h1").count() == 1
