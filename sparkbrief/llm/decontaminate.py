"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions only.

Every window of ``window`` item words (a shorter item is one window) must be contained, in
order, in a document. A window's shingles are ordered by how rare they are in the corpus. Full
containment needs every shingle, so the prefix that must be joined is the rarest one. A joined
shingle fixes where the window would begin; the length bound drops what would stick out of the
document, and the words between are then compared one by one.

Documents are read once. A row keeps the places of the shingles that may be an item's, by a
bitmap of fixed size over the hashes of all item shingles, each with the few words around it:
only these are exploded and joined. Rarity is counted on them, over all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkbrief.llm.common import UPPER, bitmap, doc_key
from sparkbrief.staging import staged

WINDOW = 10
SHINGLE = 5
MOST_WORDS = 1 << 17  # longs in the bitmap at most (1 MB); more item shingles only let more rows through
BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """Words of letters, digits and all beyond ASCII, with A-Z lower-cased; none for null."""
    plain = F.translate(text.cast("string"), UPPER + BREAKS, UPPER.lower() + " " * len(BREAKS))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def _shingle(hashes: str, at: Column, size: int) -> Column:
    """Hash of ``size`` word hashes from place ``at`` (from 0)."""
    return F.xxhash64(F.lit(size), *[F.get(F.col(hashes), at + k) for k in range(size)])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, len, words, n_shingle``: each window of each item; an item without words has none."""
    split = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text").cast("string")).alias("_w"))
    split = split.filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - window + 1))
    cut = split.select("item", F.explode(starts).alias("_s"), "_w")
    return cut.select(
        "item", F.slice("_w", F.col("_s"), F.lit(window)).alias("words"), F.least(F.size("_w"), F.lit(window)).alias("len")
    )


def item_marks(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``words, len, items, offset, size, hash``: every shingle of every distinct window."""
    windows = item_windows(items, window).groupBy("words", "len").agg(F.collect_set("item").alias("items"))
    windows = windows.select(
        "*", F.least("len", F.lit(shingle)).alias("size"), F.transform("words", lambda w: F.xxhash64(w)).alias("_h")
    )
    marks = windows.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("size"))).alias("offset"))
    sized = F.coalesce(*[F.when(F.col("size") == s, _shingle("_h", F.col("offset"), s)) for s in range(1, shingle + 1)])
    return staged(marks.withColumn("hash", sized).drop("_h"), "marks")


def scan(docs: DataFrame, marks: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, _doc, _text, n_words, found`` of ``docs(doc_id, _doc, _text, text)``; found: (pos, hash, near)."""
    sizes = sorted(r["size"] for r in marks.select("size").distinct().collect())  # within 1..shingle
    among = bitmap(marks, MOST_WORDS)
    split = docs.select("doc_id", "_doc", "_text", words_of(F.col("text")).alias("_w"))
    rows = split.select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    reach = window - 1  # the words around a match: enough for any window that holds the shingle

    def starts(size: int) -> Column:
        return F.when(F.size("_h") >= size, F.sequence(F.lit(0), F.size("_h") - size)).otherwise(F.array().cast("array<int>"))

    def shingles(size: int) -> Column:
        return F.transform(starts(size), lambda i: _shingle("_h", i, size))

    def hits(size: int) -> Column:
        return F.filter(starts(size), lambda i: among(F.get(F.col(f"_g{size}"), i)))

    def around(size: int) -> Column:
        def one(i: Column) -> Column:
            near = F.slice("_w", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
            return F.struct(i.alias("pos"), F.get(F.col(f"_g{size}"), i).alias("hash"), near.alias("near"))

        return F.transform(f"_p{size}", one)

    # Each step uses the columns of the one before more than once, so each is computed once.
    rows = rows.select("*", *[shingles(size).alias(f"_g{size}") for size in sizes])
    rows = rows.select("*", *[hits(size).alias(f"_p{size}") for size in sizes])
    found = [around(size) for size in sizes]
    none = F.array().cast("array<struct<pos:int,hash:bigint,near:array<string>>>")
    return rows.select(
        "doc_id", "_doc", "_text", F.size("_w").cast("long").alias("n_words"), (F.concat(*found) if found else none).alias("found")
    )


def occurrences(scanned: DataFrame, marks: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_doc, _text, begin, len, item``: verified places of windows in the (written) scan."""
    found = scanned.select("_doc", "_text", F.explode("found").alias("f")).select("_doc", "_text", "f.*")
    rarity = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    ranked = marks.join(rarity, "hash")
    # A window with a shingle that no document has is nowhere.
    rarest = ranked.groupBy("words", "len", "items", "size").agg(
        F.min(F.struct("n", "hash", "offset")).alias("rarest"), F.countDistinct("offset").alias("shingles")
    )
    rarest = rarest.filter(F.col("shingles") == F.col("len") - F.col("size") + 1)
    prefix = rarest.select("words", "len", "items", F.col("rarest.hash").alias("hash"), F.col("rarest.offset").alias("offset"))
    back = F.col("offset") - F.least("pos", F.lit(window - 1))  # the window's begin, from the context's first word
    joined = found.join(staged(prefix, "prefix"), "hash").filter((back <= 0) & (F.size("near") + back >= F.col("len")))
    same = joined.filter(F.slice("near", 1 - back, F.col("len")) == F.col("words"))
    return same.select("_doc", "_text", (F.col("pos") - F.col("offset")).alias("begin"), "len", F.explode_outer("items").alias("item"))


def _rows(docs: DataFrame) -> DataFrame:
    keys = dict(zip(("_doc", "_text"), doc_key(), strict=True))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.withColumns(keys)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs(doc_id, text)``.

    ``items(item_id, text)``. A text or item that is null, empty or without words has no words and
    no windows. Items without id count in ``n_hit`` but are not listed. Equal item ids count once.
    Repeated rows each give a row; a null id stays null. Other columns are not looked at.
    """
    marks = item_marks(items, window, shingle)
    scanned = staged(scan(_rows(docs), marks, window, shingle), "scan")
    places = staged(occurrences(scanned, marks, window), "places")
    listed = places.groupBy("_doc", "_text").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = places.groupBy("_doc", "_text", "begin").agg(F.max("len").alias("len"))
    # At most one span per word of the document.
    ordered = spans.groupBy("_doc", "_text").agg(F.sort_array(F.collect_list(F.struct("begin", "len"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["begin"] + s["len"] - F.greatest(a["end"], s["begin"]))).cast("long").alias("n"),
            F.greatest(a["end"], (s["begin"] + s["len"]).cast("long")).alias("end"),
        ),
        lambda a: a["n"],
    )
    hit = ordered.select("_doc", "_text", covered.alias("n_hit")).join(listed, ["_doc", "_text"])
    joined = scanned.drop("found").join(hit, ["_doc", "_text"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``docs``, all columns, without the documents that hold a window of an item.

    An id of any type counts as its whole number, as in ``contamination``; an id that is none counts as null.
    """
    marks = item_marks(items, window, shingle)
    # A row travels as one value, so that no column of it can clash with those that are added here.
    whole = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("_row"))
    scanned = staged(scan(_rows(whole), marks, window, shingle), "scan")
    # Written, so that the planner sees how few they are, and does not shuffle texts if it need not.
    dirty = staged(occurrences(scanned, marks, window).select("_doc", "_text").distinct(), "dirty")
    keyed = whole.select(*[c.alias(n) for n, c in zip(("_doc", "_text"), doc_key(), strict=True)], "_row")
    return keyed.join(dirty, ["_doc", "_text"], "left_anti").select(*[F.col("_row")[c].alias(c) for c in docs.columns])
