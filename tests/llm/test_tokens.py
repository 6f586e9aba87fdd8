import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkbrief.llm.cutting_stock import END_ID, SEQUENCE, encoder, knapsack, pack, patterns, places, sequences
from sparkbrief.llm.token_counts import merger, token_counts

from .conftest import plain, texts_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
STRANGE = [chr(c) for c in range(0x300)] + list("  　​﻿᠎中文😀٠ำ́Ⅷ½") + [
    "<|endoftext|>", "'s", "'ll", "aaa", "  ", "\n\n", "zzzzzzzz",
] * 20


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_strings_tokenise_as_in_the_library(library):
    draw = random.Random(3)
    for _ in range(2_000):
        text = "".join(draw.choices(STRANGE, k=draw.randint(0, 12)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert merger(PATH).counts([text]) == [len(ids)], repr(text)
        assert list(encoder(PATH).ids(text)) == ids, repr(text)


def test_counts(messy, given, library):
    for docs in (messy, given):
        rows = token_counts(docs, PATH)
        assert rows.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        expected = []
        for i, text in texts_of(docs):
            n = len(library.encode(text or "", add_special_tokens=False).ids)
            expected.append((i, len((text or "").encode()), n, n > 1024))
        assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, expected))


def test_empty_table(empty):
    assert token_counts(empty, PATH).count() == 0
    assert pack(empty, PATH).count() == 0


def check_packing(rows, texts, library):
    ids = defaultdict(list)
    for i, text in texts:
        ids[i].append([*library.encode(text or "", add_special_tokens=False).ids, END_ID])
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    held = defaultdict(list)
    for r in rows:
        matches = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        part = np.array(matches[0][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert len(part) == r["length"] > 0
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in matches)
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= SEQUENCE
    return len(held)


def test_packing(messy, given, library):
    for docs in (messy, given):
        rows = plain(pack(docs, PATH))
        used = check_packing(rows, texts_of(docs), library)
        tokens = sum(r["length"] for r in rows)
        assert used <= tokens / SEQUENCE * 1.02 + 2


def test_sequences_hold_the_ids(given, library):
    docs = given.limit(40)
    packed = pack(docs, PATH)
    made = {r["sequence_id"]: r["ids"] for r in sequences(docs, packed, PATH).collect()}
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, END_ID] for i, t in texts_of(docs)}
    for r in packed.collect():
        own = made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert own == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]


def test_knapsack_is_best():
    draw = random.Random(1)
    for _ in range(30):
        sizes = np.array(sorted(draw.sample(range(1, 20), 4)))
        worth = np.array([draw.random() for _ in sizes])
        best = [0.0] * 31
        for room in range(1, 31):
            best[room] = max([best[room - 1]] + [best[room - s] + w for s, w in zip(sizes, worth) if s <= room])
        value, counts = knapsack(sizes, worth, 30)
        assert value == pytest.approx(best[30]) and (counts * sizes).sum() <= 30
        assert value == pytest.approx(float((counts * worth).sum()))


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_the_histogram_up(seed):
    draw = random.Random(seed)
    histogram = {s: draw.randint(1, 10 ** draw.randint(0, 5)) for s in draw.sample(range(1, 33), 20)}
    plan = patterns(histogram, 64)
    used = defaultdict(int)
    for times, pattern in plan:
        assert times > 0 and sum(s * n for s, n in pattern.items()) <= 64
        for s, n in pattern.items():
            used[s] += times * n
    assert dict(used) == histogram
    rooms = [0] * 65  # best fit of the largest first, by how much room is left
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            room = next((r for r in range(size, 64) if rooms[r]), 64)
            rooms[room] -= room < 64
            rooms[room - size] += 1
    assert sum(t for t, _ in plan) <= sum(rooms) * 1.01 + 20
    where = places(plan)
    assert len(where["rank"]) == sum(len(p) for _, p in plan)
    assert patterns({}, 64) == []
