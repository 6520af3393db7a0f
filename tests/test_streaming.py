import datetime as dt
import random

from pyspark.sql import functions as F

from citegraph.operators import identity
from citegraph.streaming import coalesce, ingest, latest, refresh
from tests.helpers import rows

RECORD = "record_id string, seq int, scheme string, value string"


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["canonical_id"], set()).add(r["record_id"])
    return sorted(map(sorted, out.values()))


def test_batches_and_replays_give_the_one_batch_partition(spark, tmp_path):
    data = [("a", 1, "doi", "x"), ("b", 2, "pmid", "y"), ("c", 3, "doi", "x"), ("c", 3, "pmid", "y"), ("d", 4, "s2", "z"), ("e", 5, None, None)]
    root = str(tmp_path / "state")
    order = [[data[0], data[4]], [data[1]], data[2:4], [data[5]]]
    for number, batch in enumerate(order):
        ingest.ingest_batch(spark.createDataFrame(batch, RECORD), number, root)
    ingest.ingest_batch(spark.createDataFrame(order[2], RECORD), 2, root)  # retried: replaces its own output
    ingest.ingest_batch(spark.createDataFrame([], RECORD), 9, root)  # no data: nothing happens
    want = groups(identity.resolve_identity(spark.createDataFrame(data, RECORD)).record_nodes)
    assert groups(ingest.current_records(spark, root)) == want == [["a", "b", "c"], ["d"], ["e"]]
    ingest.ingest_batch(spark.createDataFrame(data[:4], RECORD), 4, root)  # seen before: nothing changes
    assert groups(ingest.current_records(spark, root)) == want
    held = ingest.current_aliases(spark, root)
    assert held.count() == 3 and held.select("canonical_id").distinct().count() == 2


def test_late_and_repeated_assertions_leave_nothing(spark, tmp_path):
    schema = "canonical_id string, source string, attrs string, fetched_at string"
    state = latest.open_state(spark, str(tmp_path), part_rows=2, fan=2)
    batches = (
        [("n", "p", "new", "2024-02"), ("m", "p", "only", None)],
        [("n", "p", "late", "2024-01"), ("n", "q", "x", "1"), ("n", "p", "new", "2024-02"), ("m", "p", "only", None)],
        [("n", "p", "newer", "2024-03"), ("n", "p", "older", "2024-02"), (None, "p", "no node", "1")],
        [("n", "q", "x", "1"), ("n", "p", "new", "2024-02")],
    )
    for number, batch in enumerate(batches):
        latest.latest_batch(spark.createDataFrame(batch, schema), number, state)
    latest.latest_batch(spark.createDataFrame(batches[2], schema), 2, state)  # comes again
    assert rows(latest.current_state(state), "canonical_id", "source", "attrs") == [(None, "p", "no node"), ("m", "p", "only"), ("n", "p", "newer"), ("n", "q", "x")]
    held = [spark.read.parquet(f"{tmp_path}/runs/{r.name}/latest").count() for r in state.manifest().runs if r.parts["latest"]]
    assert sum(held) <= 5  # a row without a node is written each time it comes; of the others no version but the newest


def test_bursts_match_brute_force_and_the_stream(spark, tmp_path):
    rng = random.Random(2)
    start, at, data = dt.datetime(2024, 1, 1), 0, []
    for _ in range(60):
        at += rng.choice([10, 100, 399, 401, 900])
        data.append(("k", start + dt.timedelta(milliseconds=at)))
    want, previous = [], None
    for _, ts in data:
        if previous is None or (ts - previous).total_seconds() > 0.4:
            want.append([ts, ts, 0])
        want[-1][1:] = [ts, want[-1][2] + 1]
        previous = ts
    df = spark.createDataFrame(data, "key string, ts timestamp")
    got = coalesce.coalesce_changes(df).orderBy("first_ts").collect()
    assert [(r["first_ts"], r["last_ts"], r["changes"]) for r in got] == [tuple(w) for w in want]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    query = (
        coalesce.coalesce_stream(stream, lateness="0 seconds").writeStream.outputMode("append").format("memory").queryName("bursts").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    seen = {(r["first_ts"], r["changes"]) for r in spark.sql("SELECT * FROM bursts").collect()}
    assert len(seen) >= len(want) - 1 and seen <= {(w[0], w[2]) for w in want}


def test_a_node_is_due_a_while_after_its_newest_claim(spark):
    at = lambda day: dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc)
    claims = spark.createDataFrame([("a", at(1)), ("a", at(3)), ("a", at(2)), ("a", at(9)), ("b", at(5))], "canonical_id string, ts timestamp")
    periods = refresh.fresh_periods(claims, "2 days")
    got = periods.select("canonical_id", F.dayofmonth("since").alias("s"), F.dayofmonth("last_claim").alias("l"), F.dayofmonth("due_at").alias("d"), "claims")
    assert rows(got) == [("a", 1, 3, 5, 3), ("a", 9, 9, 11, 1), ("b", 5, 5, 7, 1)]
    assert rows(refresh.due(periods, "2024-01-10 00:00:00"), "canonical_id") == [("b",)]
