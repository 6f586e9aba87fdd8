"""Merkle manifest of a dataset, with a proof for every row found by pointer jumping.

Each row is hashed to a leaf. The leaves of a group (a language) stand in order and are paired,
level by level, up to the group's subroot; the subroots, in the order of their groups, are paired
up to the root. Every node but the root holds a *segment*: its sibling, that is, the path over a
distance of one. A round joins the nodes with their ancestors at the end of their segments and
appends the ancestor's segment, which doubles the distance. A node of a level that no later round
starts or ends at is dropped, so the rounds after the first hold little more than the leaves.
About log2(height) rounds bring every leaf to the root.

All of it is DataFrame functions. Order numbers come from a range partitioning whose parts are
counted, levels are made eight at a time from runs of 256 nodes; nothing is gathered beyond such a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbrief.llm.common import crc_of_id
from sparkbrief.staging import staged

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = 8  # levels made in one pass, from runs of 2 ** STEP nodes
ALTERED = 7  # ids whose checksum this divides stand for altered rows
LONE, LEFT, RIGHT = 0, 1, 2  # where a node's sibling is
_ITEM = "struct<side:tinyint,digest:binary>"


def digest_of(*parts: Column) -> Column:
    """SHA-256 of strings laid end to end, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each value is ``-`` if null, else its count of UTF-8 bytes, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return digest_of(
        *[
            F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
            for t in texts
        ]
    )


def _depth(leaves: Column) -> Column:
    """Levels above the leaves: 0 for one leaf, else the bits of ``leaves - 1``."""
    return F.when(leaves > 1, F.length(F.bin(leaves - 1))).otherwise(0)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (with ``tree``) with ``idx``, from 0 in each tree by ``order``, and ``leaves``, the tree's rows.

    A range partitioning sorts all trees at once, so one that holds most rows is spread like the
    others. ``order`` must tell all rows of a tree apart.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    laid = laid.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    laid = staged(laid, "merkle-order")
    runs = laid.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("tree")
    runs = runs.select(
        "tree",
        "_part",
        (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_add"),
        F.sum("_n").over(whole).alias("leaves"),
    )
    return laid.join(staged(runs, "merkle-runs"), ["tree", "_part"]).withColumn(
        "idx", F.col("_at") + F.col("_add")
    ).drop("_part", "_at", "_add")


def _pairs(level: Column) -> Column:
    """The level above one: digests of two neighbours' hex, the last alone if none is left beside it."""
    count = F.ceil(F.size(level) / 2).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: digest_of(
            hexed(F.get(level, i * 2)), F.coalesce(hexed(F.get(level, i * 2 + 1)), F.lit(""))
        ),
    )


def _items(levels: Column, chunk: Column, base: int, many: Column) -> Column:
    """Rows (level, idx, item) of the lowest ``many`` levels of a run: each node's sibling and its side."""

    def of_level(j: Column) -> Column:
        nodes = F.get(levels, j)

        def of_node(d: Column, i: Column) -> Column:
            other = F.get(nodes, i.bitwiseXOR(F.lit(1)))
            side = F.when(i % 2 == 1, LEFT).when(other.isNull(), LONE).otherwise(RIGHT)
            first = F.call_function("shiftleft", chunk, F.lit(STEP) - j)
            return F.struct(
                (j + base).alias("level"),
                (first + i).alias("idx"),
                F.struct(side.cast("tinyint").alias("side"), other.alias("digest")).alias("item"),
            )

        return F.transform(nodes, of_node)

    return F.flatten(F.transform(F.sequence(F.lit(0), many - 1), of_level))


def tree_items(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``tree, idx, leaves, digest``: ``tree, level, idx, item`` of all nodes below the tops, and ``tree, leaves, digest`` of the tops."""
    tall = leaves.agg(F.max(_depth(F.col("leaves")))).first()[0] or 0
    tops = leaves.filter("leaves = 1").select("tree", "leaves", "digest")
    items = []
    for base in range(0, tall, STEP):
        many = F.least(F.lit(STEP), _depth(F.col("leaves")) - base)
        runs = (
            leaves.filter(_depth(F.col("leaves")) > base)
            .groupBy("tree", "leaves", F.shiftright("idx", STEP).alias("chunk"))
            .agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("nodes"))
        )
        # At most 2 ** STEP nodes; what is made of them lies in one array of levels.
        made = F.aggregate(
            F.sequence(F.lit(1), many),
            F.array(F.transform("nodes", lambda n: n["digest"])),
            lambda done, _: F.concat(done, F.array(_pairs(F.element_at(done, -1)))),
        )
        levels = staged(runs.select("tree", "leaves", "chunk", made.alias("levels")), "merkle-levels")
        items.append(levels.select("tree", F.inline(_items(F.col("levels"), F.col("chunk"), base, many))))
        leaves = levels.select(
            "tree", "leaves", F.col("chunk").alias("idx"), F.get(F.element_at("levels", -1), F.lit(0)).alias("digest")
        )
        done = _depth(F.col("leaves")) <= base + STEP
        tops = tops.unionByName(leaves.filter(done).select("tree", "leaves", "digest"))
        leaves = leaves.filter(~done)
    if not items:
        spark = leaves.sparkSession
        tree = leaves.schema["tree"].dataType.simpleString()
        return spark.createDataFrame([], f"tree {tree}, level int, idx long, item {_ITEM}"), tops
    every = items[0]
    for more in items[1:]:
        every = every.unionByName(more)
    return every, tops


def jump(items: DataFrame, tall: int) -> DataFrame:
    """``tree, idx, path`` of the leaves: their siblings from the leaf's level to the root's.

    ``items`` has ``tree, level, idx, item``; a node's parent is half its ``idx``, one level up.
    """
    held = items.select("tree", "level", "idx", F.array("item").alias("path"))
    far = 1
    while far < tall:
        held = staged(held, "merkle-segments")
        # Each of later rounds starts and ends at multiples of twice the distance; those of this one end between.
        ends = held.filter(F.col("level") % (2 * far) == far)
        ends = ends.select(
            "tree", (F.col("level") - far).alias("level"), F.col("idx").alias("_up"), F.col("path").alias("_onward")
        )
        ends = staged(ends, "merkle-ends")  # its size is known then, and is small from some round on
        starts = held.filter(F.col("level") % (2 * far) == 0).withColumn("_up", F.shiftright("idx", far))
        held = starts.join(ends, ["tree", "level", "_up"], "left").select(
            "tree", "level", "idx", F.concat("path", F.coalesce("_onward", F.array().cast(f"array<{_ITEM}>"))).alias("path")
        )
        far *= 2
    return held.filter("level = 0").select("tree", "idx", "path")


def folded(start: Column, path: Column) -> Column:
    """Root (hex) that a leaf's digest (hex) and its path lead to."""
    return F.aggregate(
        path,
        start,
        lambda done, s: F.sha2(
            F.when(s["side"] == LEFT, F.concat(hexed(s["digest"]), done))
            .when(s["side"] == RIGHT, F.concat(done, hexed(s["digest"])))
            .otherwise(done),
            256,
        ),
    )


def merkle_proofs(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, folded_root, verified`` of every row of ``docs`` (the columns in ``FIELDS``).

    ``path`` is a row's proof: (side, digest) of the sibling at each level, side 0 and no digest where a
    node is alone. Where ``altered`` holds, the row is checked as if ``n_chars`` were greater by one;
    ``folded_root`` is what the row as checked leads to over its path, ``verified`` whether that is the root.

    Leaves stand in the order of ``doc_id``, null first, then of their digests; rows that repeat have a leaf
    each. A null language is a group of its own, before all others; a null in any field is hashed as such,
    and a null ``n_chars`` cannot be altered. One row alone is leaf, subroot and root. Other columns are not
    looked at; an empty table gives an empty one.
    """
    fields = [F.col(c) for c in FIELDS]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(21,0)")
    changed = [more if c == "n_chars" else F.col(c) for c in FIELDS]
    check = F.lit(False) if altered is None else F.coalesce(altered, F.lit(False))
    # Groups sort by UTF-8 bytes, null first: a mark before each name keeps it apart from null.
    rows = docs.select(
        F.col("doc_id").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),
        leaf_digest(fields).alias("digest"),
        F.when(check & F.col("n_chars").isNotNull(), leaf_digest(changed)).alias("altered"),
        F.monotonically_increasing_id().alias("_row"),
    )
    leaves = staged(rows, "merkle-leaves")
    placed = ranked(leaves, [F.asc_nulls_first("doc_id"), F.col("digest"), F.col("_row")])
    items, tops = tree_items(placed.select("tree", "idx", "leaves", "digest"))
    tops = staged(tops.select(F.col("tree").alias("name"), F.lit(0).alias("tree"), "leaves", "digest"), "merkle-subroots")
    groups = staged(ranked(tops.withColumnRenamed("leaves", "size"), [F.col("name")]), "merkle-groups")
    above, roots = tree_items(groups.select("tree", "idx", "leaves", "digest"))
    root = roots.select(hexed(F.col("digest")).alias("root")).first()
    if root is None:  # no rows
        root = [None]
    top, tall = groups.agg(
        F.coalesce(F.max(_depth(F.col("leaves"))), F.lit(0)),
        F.coalesce(F.max(_depth(F.col("leaves")) + _depth(F.col("size"))), F.lit(0)),
    ).first()
    if top:
        # Each group's tree goes on with the nodes above its subroot, as a chain.
        chain = groups.select("name", "size", "idx", F.explode(F.sequence(F.lit(0), F.lit(top - 1))).alias("level"))
        chain = chain.withColumn("idx", F.call_function("shiftright", F.col("idx"), F.col("level")))
        chain = chain.join(above.select("level", "idx", "item"), ["level", "idx"])
        items = items.unionByName(
            chain.select(
                F.col("name").alias("tree"),
                (F.col("level") + _depth(F.col("size"))).alias("level"),
                F.lit(0).cast("long").alias("idx"),
                "item",
            )
        )
    paths = staged(jump(items, tall), "merkle-paths")
    named = groups.select(F.col("name").alias("tree"), hexed(F.col("digest")).alias("subroot"))
    path = F.coalesce("path", F.array().cast(f"array<{_ITEM}>"))
    told = placed.join(paths, ["tree", "idx"], "left").join(named, "tree").select(
        "doc_id",
        hexed(F.col("digest")).alias("leaf"),
        "subroot",
        F.lit(root[0]).cast("string").alias("root"),
        path.alias("path"),
        folded(hexed(F.coalesce("altered", "digest")), path).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """``merkle_proofs`` with each path as one digest (``proof_sha256``), altered where 7 divides crc32 of the id."""
    told = merkle_proofs(docs, crc_of_id() % ALTERED == 0)
    siblings = F.array_join(F.transform("path", lambda s: hexed(s["digest"])), "")
    return told.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified"
    )
