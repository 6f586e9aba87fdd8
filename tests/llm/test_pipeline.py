import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import compare, duck

from sparkbrief.llm.repeats import PASSAGE

from .conftest import SF, texts_of
from .test_decontaminate import slow as slow_hits
from .test_near_copies import slow_sets
from .test_repeats import slow as slow_repeats

NAMES = [n for n in queries() if n.startswith("op") and n[2].isdigit()]


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in queries()


@pytest.mark.parametrize("name", [n for n in NAMES if n in oracle_sql()])
def test_query_equals_sql(spark, name):
    good, text = compare(spark, duck(SF), SF, name, oracle_sql()[name])
    assert good, text


def test_stages_against_brute_force(spark, given, tmp_path):
    docs = given
    for name, stage in corpus_pipeline.STAGES:
        before = texts_of(docs)
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            held = {i: t for i, t in before}
            assert {r["doc_id"] for r in docs.collect()} == set(held)
            break
        assert docs.columns == given.columns
        after = dict(texts_of(docs))
        if name == "language":
            expected = {i: t for i, t in before if t and any(c.isalpha() for c in t)}
        elif name == "near_duplicates":
            sets = slow_sets([t for _, t in before])
            least = {}
            for (i, _), s in zip(before, sets, strict=True):
                least[s] = min(least.get(s, i), i)
            expected = {i: t for i, t in before if i in set(least.values())}
        elif name == "repeats":
            expected = {r[0]: r[6].decode(errors="ignore") for r in slow_repeats(before, PASSAGE)}
        else:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            dirty = {r[0] for r in slow_hits(before, items) if r[5]}
            expected = {i: t for i, t in before if i not in dirty}
        assert after == expected


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 100 and "sequence_id" in rows.columns


def test_messy_rows_pass_all_stages(spark, messy, empty, tmp_path):
    for k, start in enumerate((messy, empty)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
        assert (docs.count() > 0) == (k == 0)
