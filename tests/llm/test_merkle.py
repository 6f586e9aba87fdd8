import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from sparkbrief.llm import merkle
from sparkbrief.llm.merkle import merkle_manifest, merkle_proofs
from tests.llm.conftest import plain

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values) -> str:
    texts = [None if v is None else str(v) for v in values]
    return sha("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def climb(levels, place, digest):
    """Root that a digest at a place leads to, and the siblings met."""
    siblings = []
    for nodes in levels[:-1]:
        run = nodes[place // 2 * 2 : place // 2 * 2 + 2]
        siblings += [d for i, d in enumerate(run) if i != place % 2]
        run[place % 2] = digest
        digest, place = sha("".join(run)), place // 2
    return digest, siblings


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) to sorted contract rows."""
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append(row)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[name] = levels_of([leaf(r) for r in trees[name]])
    top = levels_of([made[n][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        for i, row in enumerate(trees[name]):
            told, low = climb(made[name], i, leaf(row))
            _, high = climb(top, place, told)
            doc_id, source, lang, n, text = row
            bad = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            start = leaf((doc_id, source, lang, n + 1, text)) if bad else leaf(row)
            back, _ = climb(made[name], i, start)
            back, _ = climb(top, place, back)
            root = top[-1][0]
            out.append((doc_id, leaf(row), made[name][-1][0], root, sha("".join(low + high)), back, back == root))
    return sorted(out, key=repr)


def told(docs):
    return sorted((tuple(r[c] for c in COLUMNS) for r in merkle_manifest(docs).collect()), key=repr)


def rows_of(docs):
    return [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]


def test_messy_rows_equal_brute_force(messy):
    assert told(messy) == brute(rows_of(messy))


def test_given_rows_equal_brute_force(given):
    assert told(given) == brute(rows_of(given))


def test_every_size_of_tree(spark, monkeypatch):
    """Sizes about powers of two, in trees of several heights; two levels a pass."""
    monkeypatch.setattr(merkle, "STEP", 2)
    rows = [(lang, i) for lang, n in (("a", 1), ("b", 2), ("c", 3), ("d", 16), ("e", 17), (None, 33)) for i in range(n)]
    rows = [(n, "s", lang, i, f"t{i}") for n, (lang, i) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert told(docs) == brute(rows)


def test_one_row(spark):
    rows = [(7, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = told(docs)
    assert got == brute(rows) and got[0][1] == got[0][2] == got[0][3]


def test_values_do_not_run_into_each_other(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    rows = [(1, "a", "b", 1, "-"), (1, "a", "b", 1, None), (1, "a1:b", None, 1, ""), (1, None, "", 1, "ü")]
    docs = spark.createDataFrame(rows, schema)
    assert told(docs) == brute(rows) and len({r[1] for r in told(docs)}) == 4


def test_copies_have_a_leaf_each(spark):
    rows = [(3, "s", "en", 1, "same")] * 300 + [(i, "s", "en", 1, "x") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert told(docs) == brute(rows)


def test_greatest_count_can_be_altered(spark):
    rows = [(i, "s", "en", 2**63 - 1, "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert told(docs) == brute(rows)
    assert {r[-1] for r in told(docs)} == {True, False}


def test_empty(empty):
    assert merkle_manifest(empty).columns == COLUMNS and plain(merkle_manifest(empty)) == []


def test_proof_holds_what_the_rule_says(given):
    proofs = merkle_proofs(given, F.col("doc_id") == 5).collect()
    assert [r.doc_id for r in proofs if not r.verified] == [5]
    deep = max(len(r.path) for r in proofs)
    assert deep == max(len(r.path) for r in proofs if r.verified) and deep > 7
    assert all((s.side == merkle.LONE) == (s.digest is None) for r in proofs for s in r.path)
