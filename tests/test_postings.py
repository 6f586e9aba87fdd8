import random
from collections import Counter

from sparkbrief.operators import postings as module
from sparkbrief.operators.postings import posting_blocks

CORPUS = "doc_id long, body string"


def counted(rows):
    """(term, doc_id, length, tf); rows with the same id and length are one posting."""
    found = Counter()
    for doc_id, body in rows:
        words = (body or "").split()
        for word in words:
            found[word, doc_id, len(words)] += 1
    return sorted(((*key, tf) for key, tf in found.items()), key=repr)


def read(made):
    blocks = made.collect()
    terms = [b for b in blocks if b.term is not None]
    postings = [(b.term, p.doc_id, p.length, p.tf) for b in terms for p in b["rows"]]
    totals = [b for b in blocks if b.term is None]
    return terms, sorted(postings, key=repr), (sum(b.documents for b in totals), sum(b.most_tf for b in totals))


def made_rows(count):
    rng = random.Random(12)
    return [(i, " ".join(f"w{int(rng.expovariate(0.2))}" for _ in range(rng.randint(0, 40)))) for i in range(count)]


def test_blocks_hold_every_posting_once(spark, monkeypatch):
    monkeypatch.setattr(module, "TASK_WORDS", 500)  # several lots of documents in a task
    rows = made_rows(300) + [(300, None), (301, ""), (302, "rare " * 50)]
    terms, postings, totals = read(posting_blocks(spark.createDataFrame(rows, CORPUS).repartition(3), 8))
    assert postings == counted(rows)
    assert totals == (len(rows), sum(len((b or "").split()) for _, b in rows))
    assert all(0 < len(b["rows"]) == b.documents <= 8 for b in terms)
    assert all(b.most_tf == max(p.tf for p in b["rows"]) for b in terms)
    assert all(b.least_length == min(p.length for p in b["rows"]) for b in terms)


def test_rows_that_repeat_id_and_length_are_counted_together(spark):
    rows = made_rows(40) + made_rows(10) + [(3, "w0 w1"), (3, "w1 w2"), (None, "a b"), (None, "b c"), (None, "b"), (None, None)]
    _, postings, totals = read(posting_blocks(spark.createDataFrame(rows, CORPUS).repartition(4), 8))
    assert postings == counted(rows)
    assert totals == (len(rows), sum(len((b or "").split()) for _, b in rows))


def test_single_postings_are_not_shuffled(spark):
    made = posting_blocks(spark.createDataFrame(made_rows(50), CORPUS), 8)
    assert "Exchange" not in made._jdf.queryExecution().toString()


def test_no_documents(spark):
    assert read(posting_blocks(spark.createDataFrame([], CORPUS), 8)) == ([], [], (0, 0))
