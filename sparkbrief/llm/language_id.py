"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams in order of frequency, counted by Spark over a
bounded sample of labelled documents. A document's own most frequent n-grams are compared with
each profile: every n-gram costs how far out of place its rank is, or the most if the profile
lacks it. The profile with the least sum wins.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkbrief.llm.common import arrow_map, crc_of_id
from sparkbrief.staging import staged

PROFILE = 300
LONGEST = 3  # characters of an n-gram; three code points fit into one integer
TRAIN_DOCS = 2_000  # labelled documents per language that profiles are counted on, about
FOLDS = 5
UNKNOWN = "und"
_CODE = 21  # bits of a code point
_CLASS: dict[int, int] = {}


def letters(text: str) -> np.ndarray:
    """Code points of a text in lower case, each run of anything but letters as one space."""
    raw = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    kinds, place = np.unique(raw, return_inverse=True)
    for c in kinds.tolist():
        if c not in _CLASS:
            _CLASS[c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 32
    out = np.array([_CLASS[c] for c in kinds.tolist()], dtype=np.int64)[place]
    out = np.concatenate([[32], out, [32]])
    return out[np.r_[True, (out[1:] != 32) | (out[:-1] != 32)]]


def grams(text: str, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as integers, ascending, and their counts; none without letters."""
    points = letters(text)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every, packed = [points[points != 32]], points
    for size in range(2, longest + 1):
        packed = packed[:-1] << _CODE | points[size - 1 :]
        every.append(packed)
    return np.unique(np.concatenate(every), return_counts=True)


def top(text: str, size: int = PROFILE) -> np.ndarray:
    """A text's most frequent n-grams by rank; ties in the order of their code points."""
    found, counts = grams(text)
    return found[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Rank tables of all languages over the union of their n-grams."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(ranked), size
        self.grams = np.unique(np.array([g for v in ranked.values() for g in v], dtype=np.int64))
        self.rank = np.full((len(self.grams) + 1, len(self.names)), -1, dtype=np.int64)
        for i, name in enumerate(self.names):
            self.rank[np.searchsorted(self.grams, ranked[name]), i] = np.arange(len(ranked[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = top(text, self.size) if text else np.zeros(0, np.int64)
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), max(len(self.grams) - 1, 0))
        ranks = np.where((self.grams[at] == own)[:, None], self.rank[at], -1)
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None]))
        total = apart.sum(axis=0)
        best = int(np.argmin(total))
        return self.names[best], float(1 - total[best] / (self.size * len(own)))


def profiles(docs: DataFrame, size: int = PROFILE, train_docs: int = TRAIN_DOCS, folds: int = FOLDS) -> Profiles:
    """Learn from rows of ``docs(doc_id, text, lang)`` outside the held-out fold.

    The sample: of each language about ``train_docs`` documents (all, if it has fewer), chosen by
    a hash of the id; their whole texts count. The labels, ``size`` n-grams each, come to the driver.
    """
    fold = crc_of_id() % folds
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold != 0))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return Profiles({}, size)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, train_docs / r["n"]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(draw < share[F.col("lang")]).select("lang", F.col("text").cast("string"))

    def make(part: pa.RecordBatch) -> dict[str, list]:
        counts: dict[str, Counter] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            found, many = grams(text)
            counts.setdefault(lang, Counter()).update(dict(zip(found.tolist(), many.tolist(), strict=True)))
        rows = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
        return {k: [r[i] for r in rows] for i, k in enumerate(("lang", "gram", "n"))}

    counted = arrow_map(sample, make, "lang string, gram long, n long")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    first = totals.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).collect()
    ranked: dict[str, list[int]] = {}
    for row in sorted(first, key=lambda r: r["rank"]):
        ranked.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(ranked, size)


def identify(docs: DataFrame, known: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1); reads only ``text``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Equal
    distances go to the first language by name. Columns of those names in ``docs`` are replaced.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*others)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["lang_pred string", "score double"])

    def make(part: pa.RecordBatch) -> dict[str, list]:
        found = [known.predict(t) for t in part.column("text").to_pylist()]
        kept = {n: part.column(n) for n in others}
        return kept | {"lang_pred": [p for p, _ in found], "score": [s for _, s in found]}

    return arrow_map(rows, make, schema)


def language_id(docs: DataFrame, folds: int = FOLDS, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs(doc_id, text, lang)``.

    Profiles are learned outside the fold that is held out (crc32 of the id as text, modulo
    ``folds``, is 0). A row without id is neither held out nor learned from; a null language is
    not learned from. Repeated rows each give a row. Without training rows all are ``und``.
    """
    known = profiles(docs, train_docs=train_docs, folds=folds)
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(crc_of_id() % folds == 0, F.lit(False)).alias("held_out"),
        F.col("text").cast("string"),
    )
    return identify(rows, known).select("doc_id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame, least: float = 0.0, folds: int = FOLDS, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``docs``, all columns, without the rows whose language is ``und`` or scored below ``least``."""
    known = profiles(docs, train_docs=train_docs, folds=folds)
    rows = docs.withColumns({f"_kept_{i}": F.col(c) for i, c in enumerate(("lang_pred", "score")) if c in docs.columns})
    found = identify(rows, known).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    back = {c: F.col(f"_kept_{i}") for i, c in enumerate(("lang_pred", "score")) if c in docs.columns}
    return found.withColumns(back).select(*docs.columns)
