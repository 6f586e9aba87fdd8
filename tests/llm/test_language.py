import zlib
from collections import Counter

from pyspark.sql import functions as F

from sparkbrief.llm.language_id import PROFILE, grams, known_language, language_id, letters, profiles

from .conftest import plain, texts_of


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def slow_top(text, size=PROFILE):
    plain_text = " " + "".join((c.lower()[0] if c.isalpha() else " ") for c in text) + " "
    while "  " in plain_text:
        plain_text = plain_text.replace("  ", " ")
    counts = Counter(c for c in plain_text if c != " ")
    for n in (2, 3):
        counts.update(plain_text[i : i + n] for i in range(len(plain_text) - n + 1))
    if plain_text.strip() == "":
        return []

    def code(gram):
        out = 0
        for c in gram:
            out = out << 21 | ord(c)
        return out

    return [code(g) for g in sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]], counts, code


def slow_predict(text, ranked):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    own = slow_top(text)[0]
    best = None
    for name in sorted(ranked):
        place = {g: i for i, g in enumerate(ranked[name])}
        total = sum(abs(place[g] - i) if g in place else PROFILE for i, g in enumerate(own))
        if best is None or total < best[1]:
            best = (name, total)
    return best[0], 1 - best[1] / (PROFILE * len(own))


def slow_profiles(rows):
    counts = {}
    for i, text, lang in rows:
        if lang is None or text is None or i is None or held(i):
            continue
        if any(c.isalpha() for c in text):
            _, c, code = slow_top(text)
            counts.setdefault(lang, Counter()).update({code(g): n for g, n in c.items()})
    return {lang: sorted(c, key=lambda g: (-c[g], g))[:PROFILE] for lang, c in counts.items()}


def test_predictions_equal_brute_force(messy, given):
    for docs in (messy, given):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
        ranked = slow_profiles(rows)
        expected = [(i, held(i), *slow_predict(t, ranked)) for i, t, _ in rows]
        found = [(r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in language_id(docs).collect()]
        assert sorted(map(repr, found)) == sorted(repr((*e[:3], round(e[3], 9))) for e in expected)


def test_held_out_accuracy(given):
    known = {r["doc_id"]: r["lang"] for r in given.collect()}
    rows = [r for r in language_id(given).collect() if r["held_out"]]
    right = sum(r["lang_pred"] == known[r["doc_id"]] for r in rows)
    assert len(rows) > 20 and right / len(rows) >= 0.97


def test_labels_of_other_rows_only(given):
    """Neither a held-out label nor the columns beside the text change a prediction."""
    changed = given.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit("zz")).otherwise(F.col("lang")))
    changed = changed.withColumn("source", F.lit("other"))
    assert sorted(map(tuple, language_id(changed).collect())) == sorted(map(tuple, language_id(given).collect()))


def test_training_sample_is_bounded(given):
    few = profiles(given, train_docs=5)
    assert set(few.names) <= {"en", "fr", "de", "es"}


def test_letters_and_grams():
    assert letters("Ab1!c").tolist() == [32, 97, 98, 32, 99, 32]
    assert len(grams("123 ...")[0]) == 0


def test_rejected_documents_go_and_columns_stay(messy, empty):
    left = known_language(messy)
    assert left.columns == messy.columns
    gone = {2, 3, 4}
    assert {i for i, _ in texts_of(left) if i is not None} == {i for i, _ in texts_of(messy) if i is not None} - gone
    assert left.filter("score <> 's'").count() == 0
    assert plain(language_id(empty)) == [] and known_language(empty).count() == 0


def test_nothing_to_learn_from(messy):
    rows = language_id(messy.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}
