import json
import zipfile

import pytest

from wakeline.sources import readers, writers
from wakeline.streaming import transitions


def test_csv_of_folder_and_zip(spark, tmp_path):
    body = "userId,movieId,rating,timestamp\n1,2,3.5,100\n"
    (tmp_path / "ratings.csv").write_text(body)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("deep/er/ratings.csv", "userId,movieId,rating,timestamp\n9,9,9,9\n")
        z.writestr("top/ratings.csv", body)
    for source in (str(tmp_path), str(tmp_path / "a.zip")):
        assert [tuple(r) for r in readers.ratings(spark, source).collect()] == [(1, 2, 3.5, 100)]
    (tmp_path / "movies.csv").write_text("movieId,title\n1,x\n")
    with pytest.raises(ValueError, match="genres"):
        readers.movies(spark, str(tmp_path))


def test_json_sources(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps({"1": {"title": "T", "genres": ["a"]}, "2": {}}))
    assert {r["item_id"]: r["title"] for r in readers.items(spark, str(tmp_path / "items.json")).collect()} == {"1": "T", "2": None}
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert readers.jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    assert sorted(r["a"] for r in readers.jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=True).collect()


@pytest.mark.parametrize("body", ['["a", "b", "a"]', '{"users": ["a", "b"]}', '{"a": 1, "b": 2}', "a\n\nb\n"])
def test_user_lists(spark, tmp_path, body):
    (tmp_path / "u").write_text(body)
    assert [r["user_id"] for r in readers.user_ids(spark, str(tmp_path / "u")).orderBy("ordinal").collect()] == ["a", "b"]


@pytest.mark.parametrize("body", ['{"u": {"candidates": ["a"], "target": "a"}}', '{"users": {"u": {"candidates": ["a"], "target": ["a"]}}}', '[{"user_id": "u", "candidates": ["a"], "target": ["a"]}]', '{"uid": "u", "candidates": ["a"], "target": ["a"]}\n', '[{"user_id": "u", "candidates": ["a"], "target": "a"}]', '{"uid": "u", "candidates": ["a"], "target": "a"}\n', '{"uid": "u", "candidates": ["a"], "target": "a"}\n{"user": "v", "candidates": ["b"], "target": "b"}\n'])
def test_candidate_files(spark, tmp_path, body):
    (tmp_path / "c").write_text(body)
    assert ("u", ["a"], ["a"]) in [tuple(r) for r in readers.candidates(spark, str(tmp_path / "c")).collect()]


def test_vectors_and_selection(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "m.npy", np.eye(2, dtype=np.float32))
    assert [tuple(r) for r in readers.vectors(spark, str(tmp_path / "m.npy"), 2, rows_per_task=1).orderBy("row").collect()] == [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    names = spark.createDataFrame([(0, "M1"), (1, "M2")], "row bigint, id string")
    assert {r["row"] for r in readers.vectors(spark, str(tmp_path / "m.npy"), ids=names).collect()} == {"M1", "M2"}
    with pytest.raises(ValueError, match="expected"):
        readers.vectors(spark, str(tmp_path / "m.npy"), 3)
    s = spark.createDataFrame([(u, o) for o, u in enumerate("dcba")], "user_id string, ordinal int")
    assert [r["user_id"] for r in readers.selected_users(s, start=1, limit=2).orderBy("ordinal").collect()] == ["c", "b"]
    listed = spark.createDataFrame([("a", 0), ("z", 1), ("d", 2)], "user_id string, ordinal int")
    assert [r["user_id"] for r in readers.selected_users(s, listed).orderBy("ordinal").collect()] == ["a", "d"]


def test_sinks_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, None, [3.0, 4.0])], "i bigint, t string, v array<float>")
    writers.json_lines(d, str(tmp_path / "l"))
    writers.json_lines(d, str(tmp_path / "l"), append=True)
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    writers.json_document(d.select("i", "t"), str(tmp_path / "d"))
    assert json.loads(next((tmp_path / "d").glob("*.txt")).read_text()) == [{"i": 1, "t": "a"}, {"i": 2, "t": None}]
    with pytest.raises(ValueError, match="JSON lines"):
        writers.json_document(d, str(tmp_path / "d"), most=1)
    writers.matrix(d, str(tmp_path / "m"), "i", "v")
    writers.tables({"a": d, "b": d}, str(tmp_path / "t"))
    writers.factors(d, d, str(tmp_path / "f"))
    writers.text_files(d.na.fill(""), str(tmp_path / "p"), "t")
    writers.run_stats(spark, str(tmp_path / "r"), {"x": 1})
    writers.tables({"a": d.limit(1)}, str(tmp_path / "t"))  # replaces the set as a whole
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    assert {k: v.count() for k, v in writers.read_tables(spark, str(tmp_path / "t")).items()} == {"a": 1}
    writers.snapshot(spark.createDataFrame([("u", "a", ["a", "b"])], "user_id string, target string, candidates array<string>"), str(tmp_path / "s"))
    assert writers.read_tables(spark, str(tmp_path / "s"))["candidates"].count() == 1
    assert json.loads(spark.read.parquet(str(tmp_path / "r")).first()["stats"]) == {"x": 1}


def test_streamed_transitions_and_log(spark, tmp_path):
    from datetime import datetime, timedelta

    schema = "memory_id string, user_id string, window_index int, state_id string, assignment_accepted boolean, assigned_at timestamp"
    t = lambda k: datetime(2024, 1, 1) + timedelta(hours=k)
    rows = [("m1", "u", 0, "A", True, t(0)), ("m2", "u", 1, "B", True, t(1)), ("m2", "u", 1, "B", True, t(1)), ("m3", "u", 2, "C", False, t(2)), ("m4", "u", 3, "D", True, t(3)), ("m5", "u", 4, "E", True, t(4))]
    # the second file brings a row that is two hours late, and one that moves the watermark on
    late = [("m7", "u", 6, "G", True, t(6)), ("m6", "u", 5, "F", True, t(5)), ("n", "v", 0, "A", True, t(40))]
    for i, part in enumerate(([*rows, late[0]], late[1:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    for i in (0, 1):
        (tmp_path / "flat").mkdir(exist_ok=True)
        next((tmp_path / f"in/{i}").glob("*.parquet")).rename(tmp_path / f"flat/{i}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    q = transitions.stream_transitions(stream, "3 hours").writeStream.format("memory").queryName("steps").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["state_id"], r["next_state"]) for r in spark.table("steps").collect()) == [("A", "B"), ("D", "E"), ("E", "F"), ("F", "G")]
    for _ in range(2):  # the second run finds nothing new
        transitions.append_log(spark.readStream.schema(schema).parquet(str(tmp_path / "flat")), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == len(rows) + len(late)


def test_settings_are_stored_and_checked(spark, tmp_path):
    from wakeline.operators import reports

    for stats in ({"seed": 1, "k": 5}, {"seed": 2, "k": 5}):
        writers.run_stats(spark, str(tmp_path / "r"), stats)
    stored = spark.read.parquet(str(tmp_path / "r"))
    assert reports.settings_differ(stored, {"seed": 2, "k": 6}, ("seed", "k")) == ["k: 5 and 6"]
    assert reports.settings_differ(stored.limit(0), {"seed": 9}, ("seed",)) == []


def test_written_tables_are_discarded(spark, tmp_path):
    from pathlib import Path

    from wakeline import storage

    storage.discard(spark)
    d = storage.keep(spark.range(3), "some")
    at = Path(storage._written[-1].removeprefix("file://").replace("file:", ""))
    assert d.count() == 3 and at.exists()
    assert storage.discard(spark) == 1 and not at.exists() and storage.discard(spark) == 0
