import glob

import pytest
from pyspark.sql import DataFrameWriter

from sparkbrief.sources import states
from sparkbrief.sources.states import read_thread_state, thread_states, write_thread_states

SCHEMA = "thread_id string, final_answer string"


def answers(frame):
    return {r.thread_id: r.final_answer for r in frame.collect()}


def frame(spark, **told):
    return spark.createDataFrame(list(told.items()), SCHEMA)


def test_readers_see_one_version(spark, tmp_path):
    path = str(tmp_path / "states")
    write_thread_states(frame(spark, a="1", b="1"), path, buckets=2)
    opened = thread_states(spark, path)
    write_thread_states(frame(spark, a="2", c="2"), path)
    assert answers(opened) == {"a": "1", "b": "1"}
    assert answers(thread_states(spark, path)) == {"a": "2", "b": "1", "c": "2"}


def test_a_lost_write_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "states")
    write_thread_states(frame(spark, a="1", b="1"), path, buckets=2)
    write = DataFrameWriter.parquet

    def lost(self, to, *args, **kwargs):
        if "/versions/" in to:
            (tmp_path / "states" / "versions" / "2").mkdir()  # begun, without its file
            raise RuntimeError("driver lost")
        return write(self, to, *args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", lost)
        with pytest.raises(RuntimeError):
            write_thread_states(frame(spark, a="2"), path)
    assert answers(thread_states(spark, path)) == {"a": "1", "b": "1"}
    left = set(glob.glob(f"{path}/states/*/*"))
    write_thread_states(frame(spark, b="3"), path)
    assert answers(thread_states(spark, path)) == {"a": "1", "b": "3"}
    assert len(left - set(glob.glob(f"{path}/states/*/*"))) == 1  # what the lost write left is gone


def test_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "states")
    for i in range(4):
        write_thread_states(frame(spark, a=str(i)), path, buckets=2, keep=2)
    assert len(glob.glob(f"{path}/versions/*/*.parquet")) == 2 and len(glob.glob(f"{path}/states/*/*")) == 2
    assert answers(thread_states(spark, path)) == {"a": "3"}


def test_columns_empty_tables_and_other_ids(spark, tmp_path):
    path = str(tmp_path / "states")
    with pytest.raises(FileNotFoundError):
        thread_states(spark, path)
    write_thread_states(spark.createDataFrame([], SCHEMA), path, buckets=3)
    assert thread_states(spark, path).columns == ["thread_id", "final_answer"] and thread_states(spark, path).isEmpty()
    assert read_thread_state(spark, path, "a").isEmpty()
    write_thread_states(frame(spark, a="1", b="1"), path)
    write_thread_states(spark.createDataFrame([("b", 7)], "thread_id string, step int"), path)
    write_thread_states(spark.createDataFrame([], SCHEMA), path)
    told = {r.thread_id: (r.final_answer, r.step) for r in thread_states(spark, path).collect()}
    assert told == {"a": ("1", None), "b": (None, 7)}
    assert read_thread_state(spark, path, "b").first().step == 7 and read_thread_state(spark, path, None).isEmpty()
    assert states._version(spark, path, 4)["buckets"] == 3
