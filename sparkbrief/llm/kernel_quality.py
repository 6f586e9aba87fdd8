"""Quality of texts: ridge regression on random Fourier features of document statistics, calibrated.

Each text is read once for a row of statistics (shares of character kinds, word lengths, repetition).
Random cosine features stand for a Gaussian kernel over these. The sums of the normal equations are
added up inside each partition and then by blocks of rows, for every training fold apart, so that the
fit without any one fold is a subtraction and needs no further pass. The penalty is the one with the
least error on the folds left out; the scores of rows by the fit without their own fold are made
probabilities by isotonic regression over fixed bins.

All labelled rows outside the held-out fold are learned from. To the driver come sums over the features
(``FEATURES`` and ``FOLDS`` bound them) and the counts of at most ``BINS`` bins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbrief.llm.common import arrow_map, crc_of_id
from sparkbrief.staging import staged

FEATURES = 256  # cosine features, beside a constant one
FOLDS = 5  # by crc32 of the id; fold 0 is held out
BINS = 6_144  # of ridge scores between LOWEST and LOWEST + 3
LOWEST = -1.0
PENALTIES = (1e-5, 1e-4, 1e-3, 1e-2, 1e-1)  # a row
ACCEPTED = 0.3  # least score that is predicted 1
UNLEARNED = 0.5  # score of all where no label was given
BLOCK = 32  # rows of a matrix that travel together
SEED = 11
STATISTICS = 24
_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _SYMBOL, _WIDE, _LINE = range(8)
_SENTENCE = re.compile(rb"[.!?]+")


def _kinds() -> np.ndarray:
    kinds = np.full(256, _SYMBOL)
    kinds[[9, 11, 12, 13, 32]] = _SPACE
    kinds[10] = _LINE
    kinds[ord("a") : ord("z") + 1] = _LOWER
    kinds[ord("A") : ord("Z") + 1] = _UPPER
    kinds[ord("0") : ord("9") + 1] = _DIGIT
    kinds[list(b".,;:!?")] = _STOP
    kinds[128:] = _WIDE
    return kinds.astype(np.uint8)


_KIND = _kinds()


def statistics(text: bytes) -> list[float]:
    """``STATISTICS`` numbers about a whole text, all zero for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    many = len(words)
    counts = Counter(words)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8) / len(text)
    sizes = np.fromiter(map(len, words), np.int64, many)
    letters = kinds[_LOWER] + kinds[_UPPER] + kinds[_WIDE]
    pairs = len(set(zip(words, words[1:], strict=False)))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    last = _KIND[np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)]
    first = _KIND[np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)]
    sentences = sum(1 for s in _SENTENCE.split(text) if s.strip())
    shares = np.fromiter(counts.values(), np.float64, len(counts)) / many
    return [
        1.0,
        np.log1p(many),
        float(sizes.mean()),
        float(sizes.std()),
        len(counts) / many,
        pairs / max(many - 1, 1),
        same / max(many - 1, 1),
        float(shares.max()),
        float(-(shares * np.log(shares)).sum()),
        letters,
        kinds[_UPPER] / max(letters, 1e-9),
        kinds[_DIGIT],
        kinds[_STOP],
        kinds[_SYMBOL],
        kinds[_SPACE] + kinds[_LINE],
        kinds[_LINE] * len(text) / many,
        len(set(lines)) / len(lines),
        np.log1p(many / len(lines)),
        np.log1p(many / max(sentences, 1)),
        float((last == _SYMBOL).mean()),
        float((last == _STOP).mean()),
        float((first == _UPPER).mean()),
        float((sizes == 1).mean()),
        float((sizes > 20).mean()),
    ]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of float64 bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _rows(values: np.ndarray) -> list[bytes]:
    return [v.tobytes() for v in np.ascontiguousarray(values, np.float64)]


class Kernel:
    """Random Fourier features of statistics brought to mean 0 and deviation 1."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FEATURES, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        # The kernel's width: about the distance of two independent rows.
        self.turn = draw.normal(size=(len(mean), features)) / np.sqrt(2 * len(mean))
        self.shift = draw.uniform(0, 2 * np.pi, features)

    def features(self, values: np.ndarray) -> np.ndarray:
        level = np.clip((values - self.mean) / self.deviation, -8, 8)
        waves = np.cos(level @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([waves, np.ones((len(values), 1))])


def summed(rows: DataFrame, make: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums over all rows of the arrays that ``make`` gives for a batch, by their number.

    A partition adds up its own; the sums of partitions with the same number meet in one task, which
    holds one array a number, and are added in the order of the partitions.
    """

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for number, values in make(batch).items():
                    total[number] = total[number] + values if number in total else values
        yield _packed(total)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, raw in zip(batch.column("number").to_pylist(), batch.column("sums"), strict=True):
                values = np.frombuffer(raw.as_buffer(), np.float64)
                total[number] = total[number] + values if number in total else values
        yield _packed(total)

    partial = rows.mapInArrow(inside, "number int, sums binary").withColumn("_part", F.spark_partition_id())
    met = partial.repartition("number").sortWithinPartitions("number", "_part").drop("_part")
    found = met.mapInArrow(across, "number int, sums binary").collect()
    return {r["number"]: np.frombuffer(bytes(r["sums"]), np.float64) for r in found}


def _packed(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([np.ravel(v).tobytes() for v in total.values()], pa.binary())],
        ["number", "sums"],
    )


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and levels of the non-decreasing steps nearest to ``mean`` over ascending ``at``."""
    steps: list[list[float]] = []  # place sum, value sum, weight
    for x, y, w in zip(at, mean, weight, strict=True):
        steps.append([x * w, y * w, w])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            top = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], top, strict=True)]
    made = np.array(steps)
    return made[:, 0] / made[:, 2], made[:, 1] / made[:, 2]


class Model:
    """Scores from statistics; without ``weights`` all texts get ``level``."""

    def __init__(self, kernel=None, weights=None, places=None, levels=None, level: float = UNLEARNED):
        self.kernel, self.weights, self.places, self.levels, self.level = kernel, weights, places, levels, level

    def scores(self, values: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(values), self.level)
        return np.clip(np.interp(self.kernel.features(values) @ self.weights, self.places, self.levels), 0, 1)


def _solve(gram: np.ndarray, towards: np.ndarray, rows: float, penalty: float) -> np.ndarray:
    ridge = np.full(len(gram), penalty * max(rows, 1.0))
    ridge[-1] = 1e-9 * max(rows, 1.0)  # the constant is free
    return np.linalg.solve(gram + np.diag(ridge), towards)


def fit(learned: DataFrame, features: int = FEATURES) -> Model:
    """A model of rows ``values`` (float64 bytes), ``label`` (0 to 1) and ``fold`` (1 and up)."""
    width = STATISTICS

    def moments(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x = _matrix(batch.column("values"), width)
        y = batch.column("label").to_numpy(zero_copy_only=False)
        return {0: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)])}

    found = summed(learned, moments).get(0)
    if found is None:
        return Model()
    rows, positive = found[0], found[1]
    if positive in (0.0, rows):
        return Model(level=positive / rows)
    mean = found[2 : 2 + width] / rows
    kernel = Kernel(mean, np.sqrt(np.maximum(found[2 + width :] / rows - mean**2, 0)), features)
    wide = features + 1
    blocks = range(0, wide, BLOCK)

    def normal(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        z = kernel.features(_matrix(batch.column("values"), width))
        y = batch.column("label").to_numpy(zero_copy_only=False)
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        made: dict[int, np.ndarray] = {}
        for f in np.unique(fold):
            mine, goal = z[fold == f], y[fold == f]
            gram = np.hstack([mine.T @ mine, (mine.T @ goal)[:, None]])
            for i, start in enumerate(blocks):
                made[int(f) * len(blocks) + i] = gram[start : start + BLOCK].ravel()
            made[-int(f)] = np.array([len(goal), (goal * goal).sum()])
        return made

    sums = summed(learned, normal)
    folds = sorted(-n for n in sums if n < 0)
    grams, goals, sizes, squares = {}, {}, {}, {}
    for f in folds:
        whole = np.concatenate([sums[f * len(blocks) + i] for i in range(len(blocks))]).reshape(wide, wide + 1)
        grams[f], goals[f] = whole[:, :wide], whole[:, wide]
        sizes[f], squares[f] = sums[-f]
    gram, goal = sum(grams.values()), sum(goals.values())

    def without(f: int, penalty: float) -> np.ndarray:
        return _solve(gram - grams[f], goal - goals[f], rows - sizes[f], penalty)

    def error(penalty: float) -> float:
        lost = 0.0
        for f in folds:
            w = without(f, penalty)
            lost += squares[f] - 2 * w @ goals[f] + w @ grams[f] @ w
        return lost

    penalty = min(PENALTIES, key=error) if len(folds) > 1 else PENALTIES[2]
    weights = _solve(gram, goal, rows, penalty)
    apart = {f: without(f, penalty) if len(folds) > 1 else weights for f in folds}

    def binned(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        z = kernel.features(_matrix(part.column("values"), width))
        fold = part.column("fold").to_numpy(zero_copy_only=False)
        raw = np.zeros(len(z))
        for f in folds:
            raw[fold == f] = z[fold == f] @ apart[f]
        place = np.clip(((raw - LOWEST) * (BINS / 3)).astype(np.int64), 0, BINS - 1)
        return {"bin": place, "label": part.column("label")}

    bins = arrow_map(learned, binned, "bin long, label double").groupBy("bin")
    told = bins.agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("bin")
    centre = LOWEST + (told["bin"].to_numpy() + 0.5) * 3 / BINS
    many = told["n"].to_numpy(np.float64)
    places, levels = isotonic(centre, told["ones"].to_numpy(np.float64) / many, many)
    return Model(kernel, weights, places, levels)


def quality_scores(docs: DataFrame, labels: DataFrame, features: int = FEATURES, accepted: float = ACCEPTED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    Learned from ``labels(doc_id, quality)`` of documents whose crc32 of the id as text, modulo ``FOLDS``, is not
    0; scores use the text alone. Labels other than 0 and 1 and null ids are not learned from; of several labels
    of an id the mean counts, for each row of that id. A null text has the statistics of an empty one. A null id
    is neither held out nor learned from. Rows that repeat each have a row. Without labels the score is 0.5; with
    labels of one kind it is that kind. An empty table gives an empty one; other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def measure(part: pa.RecordBatch) -> dict[str, list]:
        made = [statistics(t) for t in part.column("text").to_pylist()]
        return {"doc_id": part.column("doc_id"), "values": _rows(np.array(made).reshape(-1, STATISTICS))}

    known = staged(arrow_map(rows, measure, "doc_id long, values binary"), "statistics")
    given = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    given = given.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").cast("double").alias("label"))
    fold = (crc_of_id() % FOLDS).cast("int")
    learned = known.join(given, "doc_id").withColumn("fold", fold).filter("fold > 0")
    learned = staged(learned.sortWithinPartitions("doc_id", "values").select("values", "label", "fold"), "learned")
    model = fit(learned, features)

    def score(part: pa.RecordBatch) -> dict[str, list]:
        found = model.scores(_matrix(part.column("values"), STATISTICS))
        return {
            "doc_id": part.column("doc_id"),
            "held_out": part.column("held_out"),
            "score": found,
            "predicted": (found >= accepted).astype(np.int32),
        }

    judged = known.withColumn("held_out", F.coalesce(crc_of_id() % FOLDS == 0, F.lit(False)))
    return arrow_map(judged, score, "doc_id long, held_out boolean, score double, predicted int")
