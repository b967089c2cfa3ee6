"""Streams in several batches: state that the watermark drops, counted late rows, restarts from a checkpoint."""
import uuid

from pyspark.sql import functions as F

from sessionloom.catalog import zzstreaming as Z
from sessionloom.session import prepare, shared_folder
from sessionloom.sources.market import Market
from sessionloom.streaming import bars as N


def test_both_sides_of_a_join_leave_the_state(spark):
    m, progress = Market(prepare(spark), "/root/testdata/sf0.01"), []
    bars, levels = Z.day_bars(m), m.levels().select("instrument_id", "level_id", "level_ticks", "valid_from", "valid_until", "target_date")
    streams = [Z.slices_stream(m, Z.in_thirds(*side), name) for side, name in (((bars, "trading_date"), "bars"), ((levels, "target_date"), "levels"))]
    got = N.drain(N.stream_level_join(*streams, "2 hours"), Z.place(m), progress)
    batch = bars.join(levels, "instrument_id").where("bar_end > valid_from and bar_end <= valid_until and high >= level_ticks and low <= level_ticks")
    columns = ["instrument_id", "level_id", "bar_end"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect())) and len(progress) >= 3
    kept = [op["numRowsTotal"] for p in progress for op in p["stateOperators"]]
    assert 0 < kept[-1] < max(kept) < bars.count() + levels.count()


def test_changelog_restarts_and_repeats(spark):
    prepare(spark)
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    schema = "entity_id string, new_state string, available_at timestamp"
    first = [("a", "OPEN", 1), ("b", "OPEN", 5), ("a", "SHUT", 9), ("c", "OPEN", 2)]
    second = [("a", "OPEN", 4), ("b", "SHUT", 6), ("c", "SHUT", 2), ("d", "OPEN", 1)]
    for rows in (first, second, []):
        log = spark.createDataFrame([(e, s, t) for e, s, t in rows], "entity_id string, new_state string, t long").select("entity_id", "new_state", F.timestamp_seconds("t").alias("available_at"))
        log.coalesce(1).write.mode("append").parquet(f"{folder}/log")
        N.merge_changelog(N.stream_latest_state(spark.readStream.schema(schema).parquet(f"{folder}/log")), folder)
    assert {r.entity_id: r.state for r in N.merged_state(spark, folder).collect()} == {"a": "SHUT", "b": "SHUT", "c": "SHUT", "d": "OPEN"}
    # an older row of an entity changes nothing, so the second batch has no row of it
    assert {r.entity_id for r in spark.read.parquet(f"{folder}/changes").where("batch = 1").collect()} == {"b", "c", "d"}
