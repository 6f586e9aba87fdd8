import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparkbrief.llm import repeats
from sparkbrief.llm.repeats import PASSAGE, PASSAGE_GRAM, Names, least_places, repeated_spans, without_repeats

from .conftest import joins_of, plain, record_staged, texts_of


def slow(rows, span):
    counts = Counter()
    for _, text in rows:
        data = (text or "").encode()
        counts.update(data[p : p + span] for p in range(len(data) - span + 1))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        covered = np.zeros(len(data) + 1, dtype=bool)
        for p in range(len(data) - span + 1):
            if counts[data[p : p + span]] > 1:
                covered[p : p + span] = True
        edges = np.flatnonzero(np.diff(np.r_[0, covered[: len(data)].astype(np.int8), 0]))
        kept = bytes(b for b, c in zip(data, covered, strict=False) if not c)
        spans = edges.reshape(-1, 2).tolist()
        out.append((i, len(data), int(covered.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept))
    return out


def same(docs, span, **options):
    rows = texts_of(docs)
    found = plain(repeated_spans(docs, span, **options, half_gram=min(32, span // 4)))
    halves = sorted((repr(r["doc_id"]), r["n_bytes"], r["n_half"]) for r in found)
    assert halves == sorted((repr(r[0]), r[1], r[2]) for r in slow(rows, span // 2))
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], [[s["begin"], s["end"]] for s in r["spans"]]) for r in found]
    assert sorted(map(repr, found)) == sorted(repr(r[:6]) for r in slow(rows, span))


def test_whole_texts_of_the_tables(given):
    same(given, 400)


def test_messy_rows(messy):
    same(messy, 400)
    same(messy, 40, gram=12, block=4)


@pytest.mark.parametrize("seed", range(3))
def test_random_copies_with_edits(spark, seed):
    draw = random.Random(seed)
    passages = ["".join(draw.choices("abcé ", k=draw.randint(20, 120))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = draw.choices(passages, k=draw.randint(0, 4)) + ["".join(draw.choices("abcdef", k=draw.randint(0, 50)))]
        draw.shuffle(parts)
        text = list("".join(parts))
        for _ in range(draw.randint(0, 2)):
            if text:
                text[draw.randrange(len(text))] = draw.choice("xyz")
        rows.append((i, "".join(text)))
    same(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 30, gram=8, block=4)


def test_periodic_text_and_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    rows = [(0, "ab" * 900), (1, "x" * 31), (2, "q" * 30), (3, "".join(map(str, range(900)))), (4, "z" + "".join(map(str, range(300, 900))))]
    same(spark.createDataFrame(rows, "doc_id long, text string"), 30, gram=8, block=4)


def test_texts_are_cut_and_columns_stay(messy):
    cut = without_repeats(messy)
    assert cut.columns == messy.columns and cut.count() == messy.count()
    expected = {r[0]: r[6].decode(errors="ignore") for r in slow(texts_of(messy), 400) if r[0] is not None}
    for r in cut.filter("doc_id is not null").collect():
        assert (r["text"] or "") == expected[r["doc_id"]]
    assert cut.filter("doc_id = 2").first()["text"] is None


def test_passages_of_over_fifty_words_are_cut(spark, given):
    """Planted passages of 51 words that stand in two documents go, whatever their words; other text stays."""
    draw = random.Random(7)
    words = sorted({w for r in given.filter("lang = 'en'").limit(50).collect() for w in r["text"].split()})
    passages = [" ".join(draw.choices(words, k=51)) for _ in range(60)]
    rows = []
    for i in range(120):
        own = [" ".join(draw.choices(words, k=60)) for _ in range(2)]
        rows.append((i, f"{own[0]} {i} {passages[i % 60]} {i} {own[1]}"))
    left = dict(texts_of(without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), PASSAGE, PASSAGE_GRAM)))
    gone = [passages[i % 60][5:-5] not in left[i] for i in range(120)]
    assert sum(gone) >= 0.95 * len(gone)
    assert all(left[i].startswith(t.split(f" {i} ")[0]) and left[i].endswith(t.split(f" {i} ")[-1]) for i, t in rows)


def test_empty(empty):
    assert repeated_spans(empty).count() == 0 and without_repeats(empty).count() == 0


def test_names_do_not_depend_on_the_place():
    data = np.frombuffer(b"hello world, hello world", dtype=np.uint8)
    names = Names(data)
    a, b = names.of(np.array([0, 13]), np.array([11, 24]), 1)
    assert a == b
    assert len(np.unique(names.every(3))) == len({data[i : i + 3].tobytes() for i in range(len(data) - 2)})


def test_least_places():
    draw = np.random.default_rng(0)
    values = draw.integers(0, 9, 200).astype(np.uint64) << np.uint64(40)
    for width in (1, 2, 7, 50, 200):
        expected = [i + int(np.argmin(values[i : i + width])) for i in range(200 - width + 1)]
        assert least_places(values, width).tolist() == expected


def test_runs_whose_gram_is_unique_are_dropped_before_the_shuffle(spark, monkeypatch):
    """The join with the broadcast bits comes first; a semi join after it would be moved below it."""
    seen = record_staged(monkeypatch, repeats)
    draw = random.Random(5)
    rows = [(i, "".join(draw.choices("abcdefgh", k=300))) for i in range(20)]
    rows += [(20, rows[0][1][50:] + "x"), (21, "y" + rows[1][1][:250])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(docs, 60, gram=16)
    plans = [joins_of(df) for name, df, _ in seen if name == "shared-runs"]
    assert plans and all(len(x) == 2 and "strategy=broadcast" in x[1] and "Semi" not in x[0] for x in plans)
