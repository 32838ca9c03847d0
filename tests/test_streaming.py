import os
import random

from lakeward.operators import outcomes as oc
from lakeward.streaming import upsert as st

SCHEMA = "entity string, space string, seq int, isCompleted boolean, runtime bigint"


def _results(spark):
    return spark.createDataFrame([(f"e{i}", "S", False, None) for i in range(6)],
                                 "entity string, space string, isCompleted boolean, runtime bigint")


def _write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(1).write.mode("append").parquet(path)


def _run(spark, src, res, ckpt):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    st.stream_upsert(stream, res, ckpt).awaitTermination()


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _batch(spark, results, runs):
    return _rows(oc.upsert_results(results, spark.createDataFrame(runs, SCHEMA), ["seq"]))


def test_stream_equals_batch_and_survives_restart(spark, scratch):
    src, res, ckpt = (os.path.join(scratch, n) for n in ("src", "res", "ckpt"))
    st.init_results(_results(spark), res, SCHEMA)
    assert _rows(st.current_results(spark, res, ["seq"])) == _rows(_results(spark))
    first = [("e0", "S", 5, True, 10), ("e1", "S", 1, True, 3), ("ghost", "S", 2, True, 1)]
    second = [("e0", "S", 2, False, None),  # arrives late but is older: must not win
              ("e1", "S", 9, False, None), ("e2", "S", 3, True, 0)]
    _write(spark, src, first)
    _run(spark, src, res, ckpt)
    _write(spark, src, second)
    _run(spark, src, res, ckpt)  # restart from the same checkpoint: only the new file is processed
    assert st.outcome_log(spark, res).count() == 6
    got = _rows(st.current_results(spark, res, ["seq"]))
    assert got == _batch(spark, _results(spark), first + second)
    assert ("e0", "S", True, 10) in got and ("e1", "S", False, None) in got


def test_fresh_checkpoint_keeps_what_was_logged(spark, scratch):
    src, more, res = (os.path.join(scratch, n) for n in ("src", "more", "res"))
    st.init_results(_results(spark), res, SCHEMA)
    first = [[("e1", "S", i, False, None)] for i in range(3)]
    for rows in first:
        _write(spark, src, rows)
    _run(spark, src, res, os.path.join(scratch, "old"))
    later = [("e1", "S", 9, True, 4), ("e2", "S", 1, True, 2)]
    _write(spark, more, later)
    _run(spark, more, res, os.path.join(scratch, "new"))  # starts at batch 0 again
    assert st.outcome_log(spark, res).count() == 5
    assert _rows(st.current_results(spark, res, ["seq"])) == _batch(spark, _results(spark), sum(first, []) + later)


def test_two_streams_share_a_store(spark, scratch):
    res = os.path.join(scratch, "res")
    st.init_results(_results(spark), res, SCHEMA)
    runs = {"a": [("e0", "S", 4, True, 1), ("e3", "S", 1, True, 1)], "b": [("e0", "S", 3, False, None), ("e3", "S", 2, False, None)]}
    queries = []
    for name, rows in runs.items():
        src = os.path.join(scratch, name)
        _write(spark, src, rows)
        queries.append(st.stream_upsert(spark.readStream.schema(SCHEMA).parquet(src), res, os.path.join(scratch, "c" + name)))
    for q in queries:
        q.awaitTermination()
    assert _rows(st.current_results(spark, res, ["seq"])) == _batch(spark, _results(spark), runs["a"] + runs["b"])


def test_replayed_batch_is_idempotent(spark, scratch):
    res = os.path.join(scratch, "res")
    st.init_results(_results(spark), res, SCHEMA)
    batch = spark.createDataFrame([("e3", "S", 1, True, 4)], SCHEMA)
    for _ in range(2):  # the same batch id twice, as after a failure
        st.append_batch(batch, res, "r", 0)
    assert st.outcome_log(spark, res).count() == 1
    cur = st.current_results(spark, res, ["seq"])
    assert cur.count() == 6 and cur.filter("entity = 'e3' AND isCompleted").count() == 1


def test_set_up_again_empties_the_store(spark, scratch):
    res = os.path.join(scratch, "res")
    st.init_results(_results(spark), res, SCHEMA)
    st.append_batch(spark.createDataFrame([("e3", "S", 1, True, 4)], SCHEMA), res, "r", 0)
    st.init_results(_results(spark), res, SCHEMA)
    assert st.outcome_log(spark, res).count() == 0
    assert _rows(st.current_results(spark, res, ["seq"])) == _rows(_results(spark))


def test_many_batches_last_by_order_wins(spark, scratch):
    res = os.path.join(scratch, "res")
    st.init_results(_results(spark), res, SCHEMA)
    for bid in range(12):
        st.append_batch(spark.createDataFrame([("e1", "S", bid, bid % 2 == 0, bid)], SCHEMA), res, "r", bid)
    row = st.current_results(spark, res, ["seq"]).filter("entity = 'e1'").first()
    assert (row["isCompleted"], row["runtime"]) == (False, 11)


def test_random_arrival_order_matches_batch(spark, scratch):
    rng = random.Random(5)
    res = os.path.join(scratch, "res")
    results = spark.createDataFrame([(f"e{i}", rng.choice(["S", None]), False, None) for i in range(12)],
                                    "entity string, space string, isCompleted boolean, runtime bigint")
    st.init_results(results, res, SCHEMA)
    keys = [(r["entity"], r["space"]) for r in results.collect()] + [("ghost", "S")]
    runs = [(e, s, seq, rng.random() < 0.5, rng.choice([None, rng.randint(0, 50)])) for seq in range(90)
            for e, s in [rng.choice(keys)]]
    shuffled = runs[:]
    rng.shuffle(shuffled)
    for bid, chunk in enumerate([shuffled[:30], shuffled[30:60], shuffled[60:]]):
        st.append_batch(spark.createDataFrame(chunk, SCHEMA), res, "r", bid)
    assert _rows(st.current_results(spark, res, ["seq"])) == _batch(spark, results, runs)
