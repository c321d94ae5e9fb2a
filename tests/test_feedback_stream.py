"""The feedback stream with state: late, repeated, refused and many events of one key, and a restart."""

import random

from pyspark.sql import functions as F

from shelfwise.operators.feedback import ACTIONS, FLAGS, apply_feedback
from shelfwise.schema import LibraryState
from shelfwise.streaming.feedback import latest_rows, stream_feedback

EVENTS = "title string, author string, format string, action string, s long"


def test_stream_equals_the_batch_operator(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice(["Sea", " SEA ", "Lake", "", None]), rnd.choice(["Jane Roe", "jane roe", "Bo", None]), rnd.choice(["ebook", "audiobook"]), rnd.choice([*ACTIONS, "nonsense"]), k) for k in range(300)]
    rnd.shuffle(rows)  # late events in every delivery
    made = lambda part: spark.createDataFrame(part, EVENTS).withColumn("at", F.timestamp_seconds("s")).drop("s")
    for part in (rows[:100], rows[100:250], rows[50:150], rows[250:]):
        made(part).repartition(3).write.mode("append").parquet(str(tmp_path / "events"))
        stream_feedback(spark, str(tmp_path / "events"), str(tmp_path / "rows"), str(tmp_path / "cp")).awaitTermination()
    got = latest_rows(spark, str(tmp_path / "rows"))
    _, state = apply_feedback(LibraryState.of(spark), made(rows), F.current_timestamp())
    columns = ["title", "author", "format", *FLAGS, "feedback_date"]
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, state.recommendations.select(columns).collect()))


def test_events_without_time_and_an_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream_feedback(spark, str(tmp_path / "none"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.createDataFrame([("Sea", "Bo", "ebook", "thumbs_up", None), ("Sea", "Bo", "ebook", "thumbs_down", 5), ("Hill", "Bo", None, "duplicate", None)], EVENTS)
    rows.withColumn("at", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "ev"))
    stream_feedback(spark, str(tmp_path / "ev"), str(tmp_path / "rows"), str(tmp_path / "cp2")).awaitTermination()
    got = {r["title"]: r for r in latest_rows(spark, str(tmp_path / "rows")).collect()}
    assert (got["Sea"]["thumbs_up"], got["Sea"]["thumbs_down"]) == (False, True)
    assert (got["Hill"]["format"], got["Hill"]["duplicate"], got["Hill"]["feedback_date"]) == (None, True, None)
