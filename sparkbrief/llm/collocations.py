"""Collocations per language, counted with weighted acyclic automata.

A count transducer reads a language and then words; the weight of an arc is how often the words up to
it occur. Each task builds one from the sorted n-grams of a shard of texts: in sorted order an n-gram
adds states only behind the prefix it shares with the one before it, so the arcs of every level come
out in order. Transducers are cut at splitters of a sampled key order; a part of the cut carries the
path to its first n-gram with weight zero. The parts of all shards that fall into one prefix range
are united, their weights summed, and n-grams that are too rare leave.

The parts of a phrase are looked up by composing it with the transducer of its own range: in sorted
order the path to a phrase is open when the phrase comes, and holds the counts of its first words.
The same over reversed phrases gives the counts of its last words. A prefix that has phrases in
several ranges is copied to each, so no range waits on a frequent word.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbrief.llm.common import arrow_map
from sparkbrief.staging import staged

LONGEST = 4  # words of a phrase
LEAST = 30  # occurrences of a candidate
COVER = 80  # per cent of a phrase's occurrences that lie inside a longer one, from which on it goes
BEST = 2000  # phrases told of each language
UNKNOWN = "und"
SHARD_WORDS = 500_000  # words a task counts at once
WINDOW = 1 << 22  # bytes of a piece read at once; a longer piece is read in overlapping windows
RANGE_GRAMS = 1_000_000  # n-grams of all shards in a range, about; more are united in portions
PART_GRAMS = 65_536  # n-grams of a row that is shuffled, about
MOST_RANGES = 20_000
SAMPLE_DOCS = 2_000  # documents, about, that splitters are drawn from; they decide balance, not results
MARKS = 256  # keys drawn of a sampled shard
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TO_LINES = bytes.maketrans(_SEPARATORS, b"\n" * len(_SEPARATORS))


def key_of(words: list[bytes]) -> bytes:
    """Bytes that sort like the list of words; a list's prefixes are prefixes up to a zero byte."""
    return b"\0".join([w.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") for w in words])


def words_of(key: bytes) -> list[bytes]:
    return [w.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1") for w in key.split(b"\0")]


def pieces(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words of each piece of a text, and how many of them were given before (in a window of a long piece)."""
    for piece in text.lower().translate(_TO_LINES).split(b"\n"):
        if len(piece) <= WINDOW:
            words = piece.split()  # of the bytes that split() takes as space only blank and tab are left
            if words:
                yield words, 0
            continue
        carried: list[bytes] = []
        start = 0
        while start < len(piece):
            stop = min(start + WINDOW, len(piece))
            while stop < len(piece) and piece[stop] not in b" \t":
                stop += 1
            words = carried + piece[start:stop].split()
            if len(words) > len(carried):
                yield words, len(carried)
            carried, start = words[-(LONGEST - 1) :], stop


class CountTransducer:
    """Arcs by level: level 0 reads the language, level k the k-th word.

    ``levels[k]`` has ``source`` (the arc of the level before that leads here), ``label`` (a place in
    ``words``, which are sorted) and ``weight``, in the order of (source, label). An arc is its own
    target state. States are not merged by what follows them: equal counts behind them are rare.
    """

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    @classmethod
    def count(cls, read: list[tuple[bytes, list[bytes], int]]) -> CountTransducer:
        """All n-grams of (language, words of a piece, words given before)."""
        flat = list(chain.from_iterable(words for _, words, _ in read))
        words = sorted(set(flat).union(lang for lang, _, _ in read))
        place = dict(zip(words, range(len(words)), strict=True))
        base = len(words)
        ids = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        sizes = np.fromiter((len(w) for _, w, _ in read), np.int64, len(read))
        stops = np.cumsum(sizes)
        at = np.arange(len(ids))
        room = np.repeat(stops, sizes) - at
        given = np.fromiter((n for _, _, n in read), np.int64, len(read))
        fresh = (at - np.repeat(stops - sizes, sizes) >= np.repeat(given, sizes)).astype(np.int64)
        langs = np.repeat(np.fromiter((place[lang] for lang, _, _ in read), np.int64, len(read)), sizes)
        found, state = np.unique(langs, return_inverse=True)
        levels = [(np.zeros(len(found), np.int64), found, _sums(state, fresh, len(found)))]
        for size in range(1, LONGEST + 1):
            starts = np.flatnonzero(room >= size)
            last = starts + size - 1
            found, inverse = np.unique(state[starts] * base + ids[last], return_inverse=True)
            levels.append((found // base, found % base, _sums(inverse, fresh[last], len(found))))
            state = np.zeros(len(ids), np.int64)
            state[starts] = inverse
        return cls(words, levels)

    @classmethod
    def union(cls, every: list[CountTransducer]) -> CountTransducer:
        """One transducer that reads what any of them reads, with the sums of their weights."""
        if len(every) == 1:
            return every[0]
        words = sorted(set().union(*(t.words for t in every)))
        place = dict(zip(words, range(len(words)), strict=True))
        base = len(words)
        labels = [np.fromiter(map(place.__getitem__, t.words), np.int64, len(t.words)) for t in every]
        onto = [np.zeros(1, np.int64) for _ in every]
        levels = []
        for k in range(LONGEST + 1):
            arcs = [t.levels[k] for t in every]
            keys = [o[s] * base + m[lab] for o, m, (s, lab, _) in zip(onto, labels, arcs, strict=True)]
            found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            weight = _sums(inverse, np.concatenate([w for _, _, w in arcs]), len(found))
            levels.append((found // base, found % base, weight))
            onto = np.split(inverse, np.cumsum([len(x) for x in keys])[:-1])
        return cls(words, levels)

    def size(self) -> int:
        return sum(len(w) for _, _, w in self.levels)

    def path(self, level: int, arc: int) -> list[bytes]:
        found = []
        for k in range(level, -1, -1):
            source, label, _ = self.levels[k]
            found.append(self.words[label[arc]])
            arc = source[arc]
        return found[::-1]

    def before(self, words: list[bytes]) -> list[int]:
        """How many arcs of each level read less than the given words."""
        counts = []
        state = 0  # the state that has read all of the words so far, if any has
        for k, (source, label, _) in enumerate(self.levels):
            if state is None or k >= len(words):
                counts.append(int(np.searchsorted(source, counts[-1])))
                state = None
                continue
            low, high = np.searchsorted(source, [state, state + 1]) if k else (0, len(label))
            word = bisect_left(self.words, words[k])
            at = int(low + np.searchsorted(label[low:high], word))
            same = at < high and word < len(self.words) and self.words[word] == words[k] and label[at] == word
            state = at if same else None
            counts.append(at + (same and k + 1 < len(words)))
        return counts

    def part(self, low: list[int], high: list[int]) -> CountTransducer | None:
        """The arcs from ``low`` up to ``high`` of each level, and with weight zero the path to the first ones."""
        first = list(low)
        for k in range(LONGEST, 0, -1):
            if high[k] > first[k]:
                first[k - 1] = min(first[k - 1], int(self.levels[k][0][first[k]]))
        cut = []
        for k, (source, label, weight) in enumerate(self.levels):
            stop = max(high[k], first[k])
            if k < LONGEST and high[k + 1] > first[k + 1]:
                stop = max(stop, int(self.levels[k + 1][0][high[k + 1] - 1]) + 1)
            weight = weight[first[k] : stop].copy()
            weight[: low[k] - first[k]] = 0
            weight[max(high[k] - first[k], 0) :] = 0
            shift = first[k - 1] if k else 0
            cut.append((source[first[k] : stop] - shift, label[first[k] : stop], weight))
        if not any(w.any() for _, _, w in cut):
            return None
        used, inverse = np.unique(np.concatenate([lab for _, lab, _ in cut]), return_inverse=True)
        labels = np.split(inverse, np.cumsum([len(w) for _, _, w in cut])[:-1])
        return CountTransducer(
            [self.words[i] for i in used], [(s, lab, w) for (s, _, w), lab in zip(cut, labels, strict=True)]
        )

    def pack(self) -> bytes:
        """Bytes that ``unpack`` reads: the words, then all levels' arcs, sources as steps."""
        text = key_of(self.words)
        sizes = np.array([len(text)] + [len(w) for _, _, w in self.levels], np.int64)
        steps = [np.diff(s, prepend=0) for s, _, _ in self.levels]
        raw = b"".join(
            [sizes.tobytes(), text]
            + [np.concatenate(c).astype(t).tobytes() for c, t in zip(
                (steps, [lab for _, lab, _ in self.levels], [w for _, _, w in self.levels]), ("<i4", "<i4", "<i8"), strict=True
            )]
        )
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def unpack(cls, packed: bytes) -> CountTransducer:
        raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
        head = 8 * (LONGEST + 2)
        length, *sizes = np.frombuffer(raw, np.int64, LONGEST + 2).tolist()
        at, columns = head + length, []
        for kind in ("<i4", "<i4", "<i8"):
            column = np.frombuffer(raw, kind, sum(sizes), at).astype(np.int64)
            at += sum(sizes) * np.dtype(kind).itemsize
            columns.append(np.split(column, np.cumsum(sizes)[:-1]))
        levels = [(np.cumsum(s), lab, w) for s, lab, w in zip(*columns, strict=True)]
        return cls(words_of(raw[head : head + length]), levels)


def _sums(group: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    total = np.zeros(groups, np.int64)
    np.add.at(total, group, weight)
    return total


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[CountTransducer]:
    read: list[tuple[bytes, list[bytes], int]] = []
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            lang = lang.as_buffer().to_pybytes()
            for words, given in pieces(text.as_buffer().to_pybytes()):
                read.append((lang, words, given))
                held += len(words)
                if held >= SHARD_WORDS:
                    yield CountTransducer.count(read)
                    read, held = [], 0
    if read:
        yield CountTransducer.count(read)


def _splitters(rows: DataFrame) -> list[list[bytes]]:
    """Boundaries, as lists of words, of about equal ranges of all n-grams; drawn from sampled documents."""
    count = rows.count()
    share = min(1.0, SAMPLE_DOCS / max(count, 1))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            arcs = len(shard.levels[LONGEST][0]) or 1
            places = np.unique(np.linspace(0, arcs - 1, MARKS).astype(int)) if len(shard.levels[LONGEST][0]) else []
            keys = [key_of(shard.path(LONGEST, i)) for i in places]
            weight = [shard.size() / max(len(keys), 1)] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(weight, pa.float64())], ["key", "weight"])

    marks = sorted(rows.sample(share, 42).mapInArrow(draw, "key binary, weight double").collect())
    if not marks:
        return []
    summed = np.cumsum([m["weight"] for m in marks])
    ranges = min(MOST_RANGES, max(1, int(summed[-1] / share / RANGE_GRAMS) + 1))
    at = np.searchsorted(summed, np.arange(1, ranges) * summed[-1] / ranges)
    return [words_of(k) for k in sorted({bytes(marks[i]["key"]) for i in at})]


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, phrase, words, f, ahead, back`` of all n-grams that occur ``least`` times in their language.

    A row with ``words`` 0 and no phrase has all word occurrences of its language, however few. ``ahead`` and
    ``back`` are sort keys of language and words, first to last and last to first.
    """
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).cast("binary").alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    splitters = _splitters(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            ends = [shard.before(s) for s in splitters] + [[len(w) for _, _, w in shard.levels]]
            low, made = [0] * (LONGEST + 1), []
            for number, high in enumerate(ends):
                part = shard.part(low, high)
                if part is not None:
                    made.append((number, part.pack()))
                low = high
            for i in range(0, len(made), 16):
                some = made[i : i + 16]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in some], pa.int32()), pa.array([p for _, p in some], pa.binary())], ["range", "part"]
                )

    parts = rows.mapInArrow(cut, "range int, part binary").repartition("range").sortWithinPartitions("range")

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, grams = None, [], 0
        for batch in batches:
            for here, packed in zip(batch.column("range").to_pylist(), batch.column("part"), strict=True):
                if here != number:
                    if held:
                        yield _told(CountTransducer.union(held), least)
                    number, held, grams = here, [], 0
                held.append(CountTransducer.unpack(packed.as_buffer().to_pybytes()))
                grams += held[-1].size()
                if grams > 2 * RANGE_GRAMS and len(held) > 1:
                    held = [CountTransducer.union(held)]
                    grams = max(0, held[0].size() - RANGE_GRAMS)  # what it has grown to counts once
        if held:
            yield _told(CountTransducer.union(held), least)

    return parts.mapInArrow(unite, "lang string, phrase string, words int, f long, ahead binary, back binary")


def _told(whole: CountTransducer, least: int) -> pa.RecordBatch:
    rows: list[tuple] = []
    for level, (_, _, weight) in enumerate(whole.levels):
        for arc in np.flatnonzero(weight >= (least if level else 1)).tolist():
            lang, *words = whole.path(level, arc)
            phrase = b" ".join(words).decode() if level else None
            rows.append(
                (lang.decode(), phrase, level, int(weight[arc]), key_of([lang, *words]), key_of([lang, *reversed(words)]))
            )
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "f", "ahead", "back"])


def part_counts(grams: DataFrame, most_rows: int = RANGE_GRAMS) -> DataFrame:
    """``lang, phrase, back, parts`` for every phrase of two words or more in ``grams`` (as ``frequent`` gives them).

    ``parts`` has the counts of the phrase's first 1, 2, ... words, or of its last ones where ``back`` holds.
    All parts of a phrase must be in ``grams``, as those of a frequent phrase are.
    """
    count = grams.count()
    ranges = min(MOST_RANGES, count // most_rows + 1)
    cuts: dict[str, list[bytes]] = {}
    share = min(1.0, 50 * ranges / max(count, 1))  # at most 50 keys a range come to the driver, about
    drawn = grams.sample(share, 42).select("ahead", "back").collect() if ranges > 1 else []
    for way in ("ahead", "back"):
        keys = sorted(bytes(r[way]) for r in drawn)
        cuts[way] = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    def deal(part: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("back", "range", "key", "own", "phrase", "lang", "f")}
        columns = [part.column(c).to_pylist() for c in ("lang", "phrase", "words", "f", "ahead", "back")]
        for lang, phrase, words, f, *keys in zip(*columns, strict=True):
            for back, (way, key) in enumerate(zip(("ahead", "back"), keys, strict=True)):
                here = bisect_right(cuts[way], key)
                # What continues this phrase has keys below key + 1: it is copied to all their ranges.
                last = bisect_left(cuts[way], key + b"\1") if words < LONGEST else here
                for number in range(here, max(here, last) + 1):
                    own = number == here
                    row = (back == 1, number, key, own, phrase if own else None, lang if own else None, f)
                    for c, v in zip(out, row, strict=True):
                        out[c].append(v)
        return out

    dealt = arrow_map(
        grams, deal, "back boolean, range int, key binary, own boolean, phrase string, lang string, f long"
    )
    dealt = dealt.repartition("back", "range").sortWithinPartitions("back", "range", "key")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path: list[tuple[bytes, int]] = []  # the arcs that lead to where the reading is
        where = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True):
                back, number, key, own, phrase, lang, f = row
                if where != (back, number):
                    open_path, where = [], (back, number)
                while open_path and not key.startswith(open_path[-1][0] + b"\0"):
                    open_path.pop()
                if own and len(open_path) > 1:
                    out.append((lang, phrase, back, [n for _, n in open_path[1:]]))  # the first arc reads the language
                open_path.append((key, f))
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["lang", "phrase", "back", "parts"]
            )

    return dealt.mapInArrow(compose, "lang string, phrase string, back boolean, parts array<bigint>")


def _wide(n: Column) -> Column:
    return n.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, best: int = BEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the first ``best`` phrases of each language.

    Texts of ``docs(text, lang)`` are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and the bytes 0A to 0D, and
    these into words at blanks and tabs. A phrase of 2 to 4 words that occurs ``least`` times (``a``; overlaps
    count) is a candidate. Cut after its first words it scores ``2000000 * a / (l + r)``, rounded down, with the
    counts of both parts; its lowest cut counts, the first of equal ones. It goes if a longer candidate holds
    its words in a row and has ``cover`` per cent of its occurrences or more. Ranks go by score, ``a`` (both
    descending) and phrase. ``n`` is the count of all words of the language.

    A null language is ``und``, a null text has no words, rows that repeat count as often as they are there. A
    language without a candidate has no rows; an empty table gives an empty one. Other columns are not looked at.
    """
    grams = staged(frequent(docs, least), "frequent-grams")
    candidates = grams.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = part_counts(grams).groupBy("lang", "phrase").agg(
        F.any_value(F.when(~F.col("back"), F.col("parts")), True).alias("heads"),
        F.any_value(F.when(F.col("back"), F.col("parts")), True).alias("tails"),
    )

    def scored(k: Column) -> Column:
        left, right = F.get("heads", k - 1), F.get("tails", F.col("words") - k - 1)
        product = F.lit(2_000_000).cast("decimal(7,0)") * _wide(F.col("a"))
        score = F.call_function("div", product, _wide(left) + _wide(right))  # whole numbers of 38 digits: exact
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), scored)
    judged = candidates.join(parts, ["lang", "phrase"]).select("lang", "phrase", "a", F.array_min(cuts).alias("cut"))
    # What lies inside a longer candidate: the greatest count of such a one, reduced before it is shuffled.
    word = F.split("phrase", " ")
    inside = [(size, at) for size in range(2, LONGEST) for at in range(LONGEST - size + 1)]
    held = [
        F.when(F.col("words") >= size + at, F.array_join(F.slice(word, at + 1, size), " ")) for size, at in inside
    ]
    longer = candidates.filter("words > 2").select("lang", "a", F.explode(F.array_distinct(F.array(*held))).alias("phrase"), F.col("phrase").alias("_whole"))
    longer = longer.filter(F.col("phrase").isNotNull() & (F.col("phrase") != F.col("_whole")))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = judged.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longest").isNull() | (_wide(F.col("longest")) * 100 < _wide(F.col("a")) * cover)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    first = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    totals = grams.filter("words = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
