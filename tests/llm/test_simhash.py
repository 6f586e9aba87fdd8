import numpy as np
import pytest
import xxhash

from sparkbrief.llm.components import components
from sparkbrief.llm.simhash_bk import Forest, fingerprint, near_duplicates_removed, near_links, simhash_groups

from .conftest import plain, texts_of


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_sets(codes, radius=3):
    """Place of the first code of each code's connected set."""
    codes = np.array(codes, dtype=np.uint64)
    labels = list(range(len(codes)))

    def root(i):
        while labels[i] != i:
            i = labels[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[:i] ^ codes[i]) <= radius):
            a, b = root(i), root(int(j))
            labels[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


def least_ids(rows, codes):
    sets = slow_sets(codes)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None:
            least[s] = min(least.get(s, i), i)
    return [least.get(s) for s in sets]


def test_groups_equal_brute_force(messy, given):
    for docs in (messy, given):
        rows = texts_of(docs)
        codes = [slow_fingerprint(t) for _, t in rows]
        expected = [(i, f"{c:016x}", least) for (i, _), c, least in zip(rows, codes, least_ids(rows, codes), strict=True)]
        found = simhash_groups(docs).select("doc_id", "fingerprint", "component_id").collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_fingerprint_of_few_words():
    assert fingerprint(b"") == fingerprint(b" \t\n") == 0
    assert fingerprint(b"One  TWO") == xxhash.xxh64_intdigest(b"one two", 42)


def test_removal_keeps_one_row_of_each_set(messy):
    left = near_duplicates_removed(messy)
    assert left.columns == messy.columns
    rows = texts_of(messy)
    sets = slow_sets([slow_fingerprint(t) for _, t in rows])
    kept = texts_of(left)
    assert len(kept) == len(set(sets))
    ids = [i for i, _ in kept]
    assert 0 in ids and 1 not in ids and ids.count(11) == 0 and ids.count(10) == 1


def test_removal_of_a_row_given_twice(spark, messy):
    twice = messy.filter("doc_id = 0")
    twice = twice.union(twice)
    assert near_duplicates_removed(twice).count() == 1


def test_empty(empty):
    assert simhash_groups(empty).count() == 0
    assert near_duplicates_removed(empty).count() == 0


def dense(count, seed=1):
    draw = np.random.default_rng(seed)
    centre = draw.integers(0, 1 << 63, 12, dtype=np.int64).view(np.uint64)
    codes = centre[draw.integers(0, 12, count)]
    for _ in range(5):
        codes = codes ^ (np.uint64(1) << draw.integers(0, 64, count).astype(np.uint64))
    return np.unique(codes)


def test_forest_finds_every_pair():
    codes = dense(700)
    shard = np.arange(len(codes)) % 3
    forest = Forest(shard, codes)
    found = {(int(forest.codes[q]), int(forest.codes[f])) for a, b in forest.links(3) for q, f in zip(a, b)}
    expected = set()
    for s in range(3):
        own = codes[shard == s]
        for c in own:
            expected |= {(int(c), int(d)) for d in own if c != d and int(c ^ d).bit_count() <= 3}
    assert found == expected


@pytest.mark.parametrize("hot", [5, 20_000])
def test_links_connect_the_same_sets_when_shards_are_cut(spark, hot):
    codes = dense(900, seed=2)
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    links = components(near_links(frame, hot_shard=hot))
    found = {r["node"]: r["component"] for r in links.collect()}
    signed = codes.view(np.int64).tolist()
    sets = slow_sets(codes)
    own = {}
    for code, s in zip(signed, sets, strict=True):
        own.setdefault(s, []).append(code)
    for members in own.values():
        assert {found.get(c, c) for c in members} == {min(members)}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 5)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in rows} == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert plain(components(spark.createDataFrame([], "a long, b long"))) == []


def test_ids_of_any_type_and_clashing_columns(messy):
    wanted = sorted(map(repr, near_duplicates_removed(messy).select("doc_id", "text").collect()))
    for kind in ("int", "long"):
        names = ("_gone", "_gone_key", "id", "key", "row", "stays", "n", "best", "component_id", "_component", "text_key", "fp")
        docs = messy.withColumns({"doc_id": messy["doc_id"].cast(kind)} | {c: messy["n_chars"] for c in names})
        left = near_duplicates_removed(docs)
        assert left.schema == docs.schema
        assert sorted(map(repr, left.select("doc_id", "text").collect())) == wanted
