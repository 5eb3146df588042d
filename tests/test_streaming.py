import json
import os
import random

from pyspark.sql import functions as F

from auditspark.operators.compare import tally
from auditspark.operators.reviewlog import latest_dispositions
from auditspark.sources.results import read_results, RESULTS
from auditspark.streaming import logs


def test_live_tally_equals_batch(spark, tmp_path):
    src = tmp_path / "rows"
    src.mkdir()
    rng = random.Random(1)
    rows = [{"run_id": f"r{i}", "arm": "ab"[i % 2], "leakage_caught": rng.choice(
        [True, False, None])} for i in range(300)]
    for k in range(3):
        part = rows[k * 100:(k + 1) * 100] + rows[:5]  # some runs reported again
        (src / f"{k}.json").write_text("\n".join(json.dumps(r) for r in part))
    stream = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).json(str(src))
    query = (logs.live_tally(stream, ["leakage_caught"], ["arm"]).writeStream.format("memory")
             .queryName("live").outputMode("complete").trigger(availableNow=True).start())
    query.awaitTermination()
    live = {r.arm: (r.successes, r.n, r.excluded) for r in spark.table("live").collect()}
    batch = read_results(spark, str(src)).dropDuplicates(["run_id"])
    assert live == {r.arm: (r.successes, r.n, r.excluded) for r in tally(
        batch, ["leakage_caught"], ["arm"]).collect()}


def test_live_dispositions_equal_batch_whatever_the_arrival(spark, tmp_path):
    rng = random.Random(2)
    rows = [("r", f"o{i % 20}", i // 20, rng.choice(["resolved", "still_open", "withdrawn"]))
            for i in range(200)]
    schema = "run_id string, objection_id string, iteration int, disposition string"
    rng.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k * 50:(k + 1) * 50], schema).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    keys = ["run_id", "objection_id"]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in"))
    logs.write_versions(logs.live_dispositions(stream), str(tmp_path / "out"),
                        str(tmp_path / "ck"), keys).awaitTermination()
    live = logs.latest_versions(spark, str(tmp_path / "out"), keys)
    batch = latest_dispositions(spark.createDataFrame(rows, schema))
    columns = [*keys, "disposition", "iteration"]
    assert sorted(map(tuple, live.select(*columns).collect())) == sorted(
        map(tuple, batch.select(*columns).collect()))
    assert live.filter(logs.open_now()).count() == batch.filter(
        ~F.col("disposition").isin("resolved", "withdrawn")).count()


def test_tally_state_stays_flat_and_repeats_inside_the_limit_count_once(spark, tmp_path):
    src = tmp_path / "rows"
    src.mkdir()
    unique = 0
    for day in range(10):
        rows = [{"run_id": f"{day}-{i}", "arm": "a", "leakage_caught": i % 3 == 0,
                 "at": f"2024-01-{day + 1:02d}T12:00:00"} for i in range(50)]
        unique += len(rows)
        if day:  # the day before reports again
            rows += [{**r, "run_id": f"{day - 1}-{i}"} for i, r in enumerate(rows)]
        (src / f"{day:02d}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(src / f"{day:02d}.json", (1_700_000_000 + day, 1_700_000_000 + day))  # in this order
    schema = "run_id string, arm string, leakage_caught boolean, at timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    query = (logs.live_tally(stream, ["leakage_caught"], ["arm"], at="at", within="36 hours")
             .writeStream.format("memory").queryName("flat").outputMode("complete")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    held = [next(o["numRowsTotal"] for o in p["stateOperators"] if o["operatorName"].startswith("dedup"))
            for p in map(lambda p: json.loads(p.json), query.recentProgress) if p["stateOperators"]]
    assert len(held) >= 10 and max(held[:5]) == max(held[5:]) <= 200 < unique, held
    row = spark.table("flat").first()
    assert (row.n, row.successes) == (unique, 17 * 10)


def test_reads_meet_one_base_and_few_changes(spark, tmp_path):
    schema = "run_id string, objection_id string, iteration int, disposition string"
    out, keys = str(tmp_path / "out"), ["run_id", "objection_id"]

    def replay():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        logs.write_versions(logs.live_dispositions(stream), out, str(tmp_path / "ck"), keys,
                            compact_every=3).awaitTermination()

    (tmp_path / "in").mkdir()
    replay()
    assert logs.latest_versions(spark, out, keys).count() == 0
    for k in range(8):
        spark.createDataFrame([("r", f"o{i}", k, "resolved" if (k + i) % 2 else "still_open")
                               for i in range(k, k + 3)], schema).coalesce(1).write.mode("append").parquet(
                                   str(tmp_path / "in"))
    replay()
    base, changes = logs.standing_versions(spark, out)
    assert base >= 2 and len(changes) <= 3
    got = {r.objection_id: (r.iteration, r.disposition) for r in logs.latest_versions(spark, out, keys).collect()}
    last = {f"o{i}": max(k for k in range(8) if k <= i < k + 3) for i in range(10)}
    assert got == {o: (k, "resolved" if (k + int(o[1:])) % 2 else "still_open") for o, k in last.items()}
