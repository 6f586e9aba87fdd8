import hashlib
import re

from sparkbrief.llm.decontaminate import clean_documents, contamination

from .conftest import texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items, window=10):
    out = []
    windows = []
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1)):
            if w:
                windows.append((item, w[s : s + window]))
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, v in windows:
            for s in range(len(w) - len(v) + 1):
                if w[s : s + len(v)] == v:
                    hit |= set(range(s, s + len(v)))
                    if item is not None:
                        found.add(str(item))
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), names, bool(hit)))
    return out


ITEMS = [
    (1, "Fox jumps over"),
    (2, "jumps"),
    (3, None),
    (4, " ... "),
    (5, "word1x1 word2x4 word3x9 word4x16 word5x25 word6x36 word7x49 word8x64 word9x81 word10x3 word11x24 word12x47"),
    (5, "a"),
    (10, "ÜNÏ3-3"),
    (None, "no id at all"),
    (11, "Ünï3 3 w4 Ünï4 4 w5 Ünï5 5 w6 Ünï6 6 w7 Ünï7 7"),
    (12, "w4 Ünï4 4 w5 Ünï5 5 w6 Ünï6 6 w9"),
    (20, "x" * 3000),
]


def test_against_brute_force(spark, messy):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumnsRenamed({})
    rows = contamination(messy, items)
    assert rows.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = slow(texts_of(messy), ITEMS)
    assert sum(e[5] for e in expected) > 5
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, expected))
    left = clean_documents(messy, items)
    assert left.columns == messy.columns
    assert left.count() == sum(not e[5] for e in expected)


def test_given_tables(spark, given, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    expected = slow(texts_of(given), [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted(map(tuple, contamination(given, items).collect())) == sorted(expected)


def test_no_python_in_the_plan(spark, given, folder):
    plan = clean_documents(given, spark.read.parquet(f"{folder}/benchmark.parquet"))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text


def test_empty_tables(spark, messy, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(empty, none).count() == 0
    assert contamination(messy, none).filter("contaminated").count() == 0
    assert clean_documents(messy, none).count() == messy.count()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(empty, items).count() == 0


def test_ids_of_any_type_and_clashing_columns(spark, messy):
    """What a stage drops does not hang on the id's type, nor on names of other columns."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    wanted = {r["doc_id"] for r in clean_documents(messy, items).collect()}
    assert len(wanted) < len({i for i, _ in texts_of(messy)})
    for kind in ("int", "string", "short"):
        docs = messy.withColumns(
            {"doc_id": messy["doc_id"].cast(kind)}
            | {c: messy["n_chars"] for c in ("_doc", "_text", "_doc_of", "_text_of", "_row", "_id", "hash", "found", "row")}
        )
        left = clean_documents(docs, items)
        assert left.schema == docs.schema
        assert {None if r["doc_id"] is None else int(r["doc_id"]) for r in left.collect()} == wanted
