"""Registered queries for the streaming jobs. Inputs are table rows that Spark writes as files and streams back."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from citegraph.plans import fixtures as fx
from citegraph.plans.oracle_views import ISO_MICROS, with_views
from citegraph.plans.queries_identity import COMPONENT_SQL, PARTITION_SQL, RECORDS_SQL
from citegraph.plans.queries_sources import NOW, openalex_lines
from citegraph.plans.registry import Registry
from citegraph.session import work_folder
from citegraph.sources import openalex
from citegraph.streaming import coalesce, emissions, ingest, latest, refresh

REG = Registry()
BATCHES, SLICES = 3, 4


def _stream_of(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """`rows` written by all cores and read back in `BATCHES` micro-batches, in no order; rows that share the first column come together."""
    files = max(BATCHES, spark.sparkContext.defaultParallelism)
    rows.repartition(files, rows.columns[0]).write.mode("overwrite").parquet(folder)
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    return reader.option("maxFilesPerTrigger", math.ceil(files / BATCHES)).parquet(folder)


@REG.query("I1_streaming_ingest", with_views("", PARTITION_SQL, extra=RECORDS_SQL + "," + COMPONENT_SQL, recursive=True))
def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in several batches; the partition is the one a single batch gives."""
    root = work_folder(spark, "ingest")
    stream = _stream_of(spark, fx.records(spark, sf_dir), f"{root}/input")
    ingest.ingest_stream(stream, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    pairs = ingest.current_records(spark, f"{root}/state")
    least = pairs.groupBy("canonical_id").agg(F.min("record_id").alias("root"), F.count(F.lit(1)).alias("members"))
    return pairs.join(least, "canonical_id").select("record_id", "root", "members")


@REG.query(
    "I1_streaming_emissions",
    """WITH refs AS (SELECT DISTINCT p_partkey AS src, unnest([p_size, p_partkey + 1]) AS dst FROM part)
       SELECT 'edge' AS what, 'W' || src AS a, 'W' || dst AS b, 1 AS n FROM refs
       UNION ALL SELECT 'kind', 'openalex:' || id, kind, 1 FROM (
         SELECT 'W' || p_partkey AS id, 'work' AS kind FROM part UNION SELECT 'W' || dst, 'work' FROM refs
         UNION SELECT 'A' || s_suppkey, 'author' FROM supplier UNION SELECT 'T' || r_regionkey, 'topic' FROM region UNION SELECT 'S' || c_custkey, 'venue' FROM customer)
       UNION ALL SELECT 'claim', 'openalex:' || id, 'openalex', 1 FROM (
         SELECT 'W' || p_partkey AS id FROM part UNION ALL SELECT 'A' || s_suppkey FROM supplier UNION ALL SELECT 'T' || r_regionkey FROM region UNION ALL SELECT 'S' || c_custkey FROM customer)
       UNION ALL SELECT 'one venue', 'M' || c_nationkey, min('S' || c_custkey), count(*) FROM customer GROUP BY c_nationkey""",
)
def streaming_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's records and edges arrive in several batches: edges, kinds and claims by their nodes' aliases.

    Works are cited before their records come, and venues of several batches turn out to be one.
    """
    root = work_folder(spark, "emissions")
    given = openalex.parse(openalex_lines(spark, sf_dir), NOW)
    rows = emissions.stream_rows(given).withColumn("k", F.xxhash64("record.record_id", "edge.src.value", "edge.dst.value"))
    stream = _stream_of(spark, rows.select("k", "record", "edge"), f"{root}/input").select("record", "edge")
    ledger = emissions.open_ledger(spark, f"{root}/ledger")
    emissions.emission_stream(stream, ledger, f"{root}/checkpoint").awaitTermination()
    store = emissions.current_store(ledger)
    named = store.aliases.where("scheme = 'openalex'").select("canonical_id", "value")
    end = lambda c, name: named.select(F.col("canonical_id").alias(c), F.col("value").alias(name))
    text = F.concat(F.lit("openalex:"), F.col("value"))
    edges = store.edges().join(end("src_id", "a"), "src_id").join(end("dst_id", "b"), "dst_id").select(F.lit("edge").alias("what"), "a", "b", F.lit(1).alias("n"))
    kinds = named.join(store.live_nodes(), "canonical_id").select(F.lit("kind").alias("what"), text.alias("a"), F.col("kind").alias("b"), F.lit(1).alias("n"))
    claims = named.join(store.assertions, "canonical_id").select(F.lit("claim").alias("what"), text.alias("a"), F.col("source").alias("b"), F.lit(1).alias("n"))
    issn = store.aliases.where("scheme = 'issn' AND value LIKE 'M%'").select("canonical_id", F.col("value").alias("a"))
    venues = issn.join(named, "canonical_id").groupBy("a").agg(F.min("value").alias("b"), F.count(F.lit(1)).cast("int").alias("n")).select(F.lit("one venue").alias("what"), "a", "b", "n")
    return edges.unionByName(kinds).unionByName(claims).unionByName(venues)


BURSTS_SQL = """SELECT key, min(us) AS first_us, max(us) AS last_us, count(*) AS changes FROM (
         SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY us, event_id) AS burst FROM (
           SELECT *, lag(us) OVER (PARTITION BY key ORDER BY us, event_id) AS prev FROM (
             SELECT event_type AS key, epoch_us(ts) AS us, event_id FROM events))) GROUP BY key, burst"""


@REG.query("I2_coalesce_changes", BURSTS_SQL)
def coalesce_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one type are changes of one store; on this clock ten quiet minutes end a burst."""
    changes = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "ts")
    bursts = coalesce.coalesce_changes(changes, quiet_millis=600_000)
    return bursts.select("key", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "changes")


SENTINEL = "end of input"


def _sliced_stream(spark: SparkSession, changes: DataFrame, root: str, job, schema: str) -> DataFrame:
    """Run `job` over changes (key, ts) as a stream that takes a slice of time per batch, a few rows late but within half an hour.

    All slices are laid out by one write, each as many files as there are tasks; a slice is given to the stream by a
    rename. A sentinel long after the last change moves the watermark past everything; it is no result itself.
    """
    span = changes.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    width = max(1, (hi - lo + SLICES) // SLICES)
    late = F.pmod(F.xxhash64("key", "ts"), F.lit(20)) == 0  # one row in twenty comes up to half an hour late
    arrives = F.unix_micros("ts") + F.when(late, 1_800_000_000).otherwise(0)
    placed = changes.withColumn("slice", F.least(F.floor((arrives - lo) / width), F.lit(SLICES)).cast("int"))
    after = spark.range(2).select(
        F.lit(SENTINEL).alias("key"), F.timestamp_micros(F.lit(hi + 40 * 86_400_000_000) * (1 + F.col("id") * 0)).alias("ts"), (F.lit(SLICES + 1) + F.col("id")).cast("int").alias("slice")
    )
    placed.unionByName(after).write.partitionBy("slice").parquet(f"{root}/slices")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(f"{root}/input"))
    for k in range(SLICES + 3):
        if not fs.exists(path(f"{root}/slices/slice={k}")):
            continue
        fs.rename(path(f"{root}/slices/slice={k}"), path(f"{root}/input/{k}"))
        stream = spark.readStream.schema("key string, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{root}/input")
        query = (
            job(stream).writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/out")


@REG.query("I2_coalesce_stream", BURSTS_SQL)
def coalesce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream."""
    changes = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    out = _sliced_stream(
        spark, changes, work_folder(spark, "bursts"), lambda rows: coalesce.coalesce_stream(rows, "10 minutes", "1 hour"),
        "key string, first_ts timestamp, last_ts timestamp, changes long",
    ).where(F.col("key") != SENTINEL)
    return out.select("key", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "changes")


@REG.query(
    "I4_refresh_due",
    """SELECT canonical_id, min(us) AS since_us, max(us) + 172800000000 AS due_us, count(*) AS claims FROM (
         SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY canonical_id ORDER BY us, event_id) AS period FROM (
           SELECT *, lag(us) OVER (PARTITION BY canonical_id ORDER BY us, event_id) AS prev FROM (
             SELECT 'u' || user_id AS canonical_id, epoch_us(ts) AS us, event_id FROM events))) GROUP BY canonical_id, period""",
)
def refresh_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a user stays fresh for two days after each event; periods come out of a stream with late rows."""
    claims = fx.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    job = lambda rows: refresh.fresh_periods(rows.withColumnRenamed("key", "canonical_id"), "2 days", "1 hour")
    schema = "canonical_id string, since timestamp, last_claim timestamp, due_at timestamp, claims long"
    out = _sliced_stream(spark, claims, work_folder(spark, "refresh"), job, schema).where(F.col("canonical_id") != SENTINEL)
    return out.select("canonical_id", F.unix_micros("since").alias("since_us"), F.unix_micros("due_at").alias("due_us"), "claims")


@REG.query(
    "I3_latest_assertion",
    f"""SELECT canonical_id, source, fetched_at FROM (
          SELECT 'u' || user_id AS canonical_id, event_type AS source, strftime(ts, {ISO_MICROS}) AS fetched_at,
                 row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""",
)
def latest_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in scrambled batches; the newest by time stands."""
    root = work_folder(spark, "latest")
    rows = fx.assertion_in(spark, sf_dir).select("attrs", "canonical_id", "source", "fetched_at")
    state = latest.open_state(spark, f"{root}/state")
    latest.latest_stream(_stream_of(spark, rows, f"{root}/input"), state, f"{root}/checkpoint").awaitTermination()
    return latest.current_state(state).select("canonical_id", "source", "fetched_at")
