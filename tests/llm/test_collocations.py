import random
import re
from collections import Counter, defaultdict

import pytest

from sparkbrief.llm import collocations as module
from sparkbrief.llm.collocations import CountTransducer, collocations, key_of, part_counts, pieces, words_of
from tests.llm.conftest import plain

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
WORDS = [b"a", b"ab", b"b", b"\0", b"\1", b"a\1", b"a\0b", b"\1\2", b"zz", "é".encode()]


def brute(rows, least=30, cover=80, best=2000):
    """Contract rows of (text, lang)."""
    f = defaultdict(Counter)
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    f["und" if lang is None else lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, counts in f.items():
        total = sum(c for g, c in counts.items() if len(g) == 1)
        candidates = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        inside = Counter()
        for g, c in candidates.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    inside[g[i : i + n]] = max(inside[g[i : i + n]], c)
        kept = []
        for g, a in candidates.items():
            if 100 * inside[g] >= cover * a:
                continue
            score, _, left, right = min(
                (2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g))
            )
            kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


def told(docs, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations(docs, **options).collect())


def rows_of(docs):
    return [(r.text, r.lang) for r in docs.select("text", "lang").collect()]


def counted(read):
    found = Counter()
    for lang, words, given in read:
        for i in range(len(words)):
            found[(lang,)] += i >= given
            for n in range(1, 5):
                if i + n <= len(words) and i + n - 1 >= given:
                    found[(lang, *words[i : i + n])] += 1
    return +found


def dump(transducer):
    return Counter(
        {
            tuple(transducer.path(k, i)): int(w)
            for k, (_, _, weights) in enumerate(transducer.levels)
            for i, w in enumerate(weights)
            if w
        }
    )


def reading(rng):
    return [
        (
            rng.choice([b"en", b"und", b""]),
            [rng.choice(WORDS[: rng.randint(2, 10)]) for _ in range(rng.randint(1, 12))],
            rng.choice([0, 0, 0, 1]),
        )
        for _ in range(rng.randint(1, 8))
    ]


@pytest.mark.parametrize("seed", range(40))
def test_transducers(seed):
    """Counting, packing, cutting at splitters and uniting the parts keep every count, once."""
    rng = random.Random(seed)
    reads = [reading(rng) for _ in range(3)]
    shards = [CountTransducer.count(r) for r in reads]
    whole = sum(map(counted, reads), Counter())
    assert [dump(t) for t in shards] == [counted(r) for r in reads]
    assert [dump(CountTransducer.unpack(t.pack())) for t in shards] == [dump(t) for t in shards]
    assert dump(CountTransducer.union(shards)) == whole
    splitters = sorted([list(k) for k in rng.sample(list(whole), min(4, len(whole)))] + [[b"en", b"aa", b"b"]])
    parts = defaultdict(list)
    for shard in shards:
        low = [0] * 5
        for number, high in enumerate([shard.before(s) for s in splitters] + [[len(w) for _, _, w in shard.levels]]):
            part = shard.part(low, high)
            if part is not None:
                parts[number].append(CountTransducer.unpack(part.pack()))
            low = high
    united = Counter()
    for number, some in parts.items():
        found = dump(CountTransducer.union(some))
        assert not united.keys() & found.keys()
        assert all(number == 0 or list(k) >= splitters[number - 1] for k in found)
        assert all(number == len(splitters) or list(k) < splitters[number] for k in found)
        united |= found
    assert united == whole


def test_keys_sort_like_words():
    rng = random.Random(1)
    lists = [[rng.choice(WORDS) for _ in range(rng.randint(1, 5))] for _ in range(500)]
    assert [key_of(w) for w in sorted(lists)] == sorted(map(key_of, lists))
    assert all(words_of(key_of(w)) == w for w in lists)


def test_long_pieces_are_read_whole(monkeypatch):
    words = [f"w{i % 17}".encode() for i in range(400)]
    text = b" ".join(words) + b". x y"
    whole = counted([(b"en", w, n) for w, n in pieces(text)])
    monkeypatch.setattr(module, "WINDOW", 40)
    cut = list(pieces(text))
    assert len(cut) > 20
    assert dump(CountTransducer.count([(b"en", w, n) for w, n in cut])) == whole


def test_given_rows_equal_brute_force(given):
    assert told(given) == brute(rows_of(given))
    assert len(told(given)) > 20


def test_many_ranges(given, monkeypatch):
    """Prefix ranges cut small: hot prefixes lie across them."""
    monkeypatch.setattr(module, "RANGE_GRAMS", 2_000)
    assert told(given, least=3, best=100_000) == brute(rows_of(given), 3, best=100_000)


def test_parts_over_small_ranges(spark):
    counts = counted([(b"en", [w for w in WORDS if b" " not in w] * 3, 0)])
    rows = [
        (g[0].decode(), b" ".join(g[1:]).decode(), len(g) - 1, c, key_of(list(g)), key_of([g[0], *reversed(g[1:])]))
        for g, c in counts.items()
    ]
    grams = spark.createDataFrame(rows, "lang string, phrase string, words int, f long, ahead binary, back binary")
    by_text = {r[1]: r for r in rows}
    for most in (3, 10**6):
        found = part_counts(grams, most).collect()
        assert len(found) == 2 * sum(len(g) > 2 for g in counts)
        for row in found:
            g = next(k for k in counts if b" ".join(k[1:]).decode() == row.phrase and len(k) - 1 == by_text[row.phrase][2])
            n = len(g) - 1
            wanted = [counts[(g[0], *g[n + 1 - k :])] if row.back else counts[g[: k + 1]] for k in range(1, n)]
            assert row.parts == wanted


def test_messy_rows_equal_brute_force(messy):
    assert told(messy, least=1, best=50) == brute(rows_of(messy), 1, best=50)
    assert told(messy) == brute(rows_of(messy))


def test_copies_ties_and_overlaps(spark):
    rows = [("aa aa aa aa", "x")] * 40 + [("Q R\tS. q r s!", "x")] * 30 + [("q r", None)] * 30 + [("q r", "und")] + [(None, "x")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert told(docs) == brute(rows)
    assert ("und", 1, "q r", 31, 31, 31, 62, 1_000_000) in told(docs)


def test_hot_word(spark):
    """One word begins and ends a third of all phrases."""
    rows = [(f"the w{i % 50} the v{i % 40}, x{i % 7} y{i % 3}", "en") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert told(docs) == brute(rows)


def test_empty(empty):
    assert collocations(empty).columns == COLUMNS and plain(collocations(empty)) == []
