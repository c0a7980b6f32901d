"""A trie of conversation prefixes, built level by level from the root and rolled up level by level from the leaves."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .mixing import word_count


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, key, words): the turns of each conversation in order, pos from 1.

    ``key`` is the SHA-256 of role and text, nulls read as empty; ``words`` counts the text's. A null turn comes first;
    turns of one number are ordered by role and then by ``key``, so that no text travels; repeated rows are turns of
    their own. Rows without a conversation id belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    src = df.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("__turn"), role.alias("__role"), key.alias("key"), F.coalesce(word_count(text_col), F.lit(0)).alias("words"))
    order = Window.partitionBy("conv").orderBy(F.col("__turn").asc_nulls_first(), "__role", "key")
    return src.withColumn("pos", F.row_number().over(order)).select("conv", "pos", "key", "words")


def spliced(own: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """(conv, pos, key, words): each conversation with its first h turns taken from the first of its block.

    ``own``: (conv, pos, key, words). h is the CRC32 of the id in decimal, modulo ``heads``; the block of c begins at
    c - c % ``block``. A conversation without enough turns there takes all; its own follow after its first h.
    """
    conv = own.select("conv").distinct()
    conv = conv.select("conv", (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int").alias("h"), (F.col("conv") - F.col("conv") % block).alias("base"))
    # at most `block` conversations take at most `heads` - 1 turns of one
    first = own.filter(F.col("pos") < heads).select(F.col("conv").alias("base"), "pos", "key", "words")
    taken = conv.join(first, "base").filter(F.col("pos") <= F.col("h")).select("conv", "pos", "key", "words")
    found = taken.groupBy("conv").agg(F.count(F.lit(1)).cast("int").alias("n"))
    shift = conv.join(found, "conv", "left").select("conv", "h", F.coalesce("n", F.lit(0)).alias("n"))
    rest = own.join(shift, "conv").filter(F.col("pos") > F.col("h")).select("conv", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "key", "words")
    return taken.unionByName(rest)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, ends): SHA-256 of the ids of each class joined by commas, of rows (rep, conv) sorted by both, as they stream by."""
    rep, state = None, None
    for rb in batches:
        out = []
        for r, c in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            if r != rep:
                if state is not None:
                    out.append((rep, state.hexdigest()))
                rep, state = r, hashlib.sha256()
                state.update(b"%d" % c)
            else:
                state.update(b",%d" % c)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["rep", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["rep", "ends"])


def classes(convs: DataFrame, spliced_turns: DataFrame) -> DataFrame:
    """(conv, rep, m, len): each conversation with the least id of those of the same turns, their number and their length.

    Conversations are compared by their length and by sums of four 64-bit parts of the SHA-256 of each turn and its
    place, which any task can add up: copies are one class before levels are built, however many there are.
    """
    at = F.sha2(F.concat(F.col("key"), F.col("pos").cast("string").cast("binary")), 256)
    sums = [F.sum(F.conv(F.substring(at, 16 * i + 1, 16), 16, -10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    told = spliced_turns.groupBy("conv").agg(F.max("pos").alias("len"), *sums)
    named = convs.join(told, "conv", "left").select("conv", F.coalesce("len", F.lit(0)).alias("len"), F.struct(*[F.coalesce(f"s{i}", F.lit(0).cast("decimal(30,0)")).alias(f"s{i}") for i in range(4)]).alias("s"))
    one = named.groupBy("len", "s").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("m"))
    return named.join(one, ["len", "s"]).select("conv", "rep", "m", "len")


def trie(spliced_turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``spliced_turns``: (conv, pos, key, words) with pos from 1 without gaps; ``convs``: (conv), all conversations,
    those without a turn too. Down: at each depth the classes of equal conversations that still share their node with
    others are grouped by (node, next turn), and the least id of a group names the child. A class that has its node
    alone leaves: what is left of it is a chain of nodes, told by its own turns. So there are as many levels as the
    longest prefix that different conversations share. Up: each level adds leaves and savings of its children to their
    parents. Every level is a table in the shared folder. No conversation at all gives no node.
    """
    common.ship(spliced_turns)
    spark = spliced_turns.sparkSession
    folder = f"{common.ensure_checkpoint_dir(spark)}/trie-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    every = kept(spliced_turns, "turns")
    members = kept(classes(convs, every), "members")
    reps = members.filter("conv = rep").select("rep", "m", "len")
    # a class of one is hashed in place, larger ones as they stream by in order
    many = members.filter("m > 1").select("rep", "conv").repartition("rep").sortWithinPartitions("rep", "conv").mapInArrow(_digests, "rep long, ends string")
    ends = kept(reps.filter("m = 1").select("rep", F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("ends")).unionByName(many), "ends")
    # files in the order of places: a level reads the pages that hold its own
    path = kept(every.join(reps.select(F.col("rep").alias("conv")), "conv").sortWithinPartitions("pos"), "path")

    top = reps.agg(F.min("rep").alias("conv_id"), F.sum("m").alias("n_convs"), F.min(F.when(F.col("len") == 0, F.col("rep"))).alias("ender")).filter("conv_id IS NOT NULL")
    root = top.first()
    if root is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    live, depth = reps.filter("len > 0").select("rep", F.lit(root["conv_id"]).cast("long").alias("node"), "m", "len"), 0
    while True:
        depth += 1
        step = live.join(path.filter(F.col("pos") == depth).select(F.col("conv").alias("rep"), "key", "words"), "rep")
        group = step.groupBy("node", "key").agg(F.min("rep").alias("child"), F.sum("m").alias("n_convs"), F.count(F.lit(1)).alias("k"), F.min(F.when(F.col("len") == depth, F.col("rep"))).alias("ender"))
        seen = Observation()
        level = step.join(group, ["node", "key"]).select("rep", "m", "len", "words", "node", "child", "n_convs", "k", "ender")
        level = kept(level.observe(seen, F.count(F.when(F.col("k") > 1, 1)).alias("live")), f"down/e={depth}")
        if not seen.get["live"]:
            break
        live = level.filter("k > 1").select("rep", F.col("child").alias("node"), "m", "len")
    down = spark.read.schema(T.StructType([*level.schema.fields, T.StructField("e", T.IntegerType())])).parquet(f"{folder}/down")

    # chains: a class alone in its node at depth e has a node at each later place
    none = hashlib.sha256(b"").hexdigest()
    left = down.filter("k = 1").select("rep", "e", "m", "len")
    later = path.select(F.col("conv").alias("rep"), "pos", "words").join(left, "rep").filter(F.col("pos") > F.col("e"))
    after = Window.partitionBy("rep").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alone = later.filter("m = 1").withColumn("saved", F.lit(0).cast("long")).unionByName(later.filter("m > 1").withColumn("saved", (F.col("m") - 1) * F.sum("words").over(after)))
    chains = alone.join(ends, "rep").select(
        F.col("rep").alias("conv_id"),
        F.col("pos").cast("long").alias("depth"),
        F.col("rep").alias("parent_conv_id"),
        F.col("m").alias("n_convs"),
        (F.col("pos") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.when(F.col("pos") == F.col("len"), F.col("ends")).otherwise(F.lit(none)).alias("ends_sha256"),
    )
    below = kept(later.filter("m > 1").groupBy("rep").agg(F.sum(F.expr("(m - 1) * words")).alias("below")), "below")

    up = None
    for e in range(depth, 0, -1):
        nodes = down.filter((F.col("e") == e) & (F.col("rep") == F.col("child"))).join(below, "rep", "left")
        own = (F.col("n_convs") - 1) * F.col("words") + F.when(F.col("k") == 1, F.coalesce("below", F.lit(0))).otherwise(0)
        chain = F.when(F.col("k") == 1, (F.col("len") > e).cast("long"))
        nodes = nodes.select("child", F.col("node").alias("parent"), "n_convs", "ender", own.alias("own"), chain.alias("chain"))
        if up is None:
            nodes = nodes.withColumns({n: F.lit(None).cast("long") for n in ("n", "leaves", "saved")})
        else:
            nodes = nodes.join(_rolled(up).withColumnRenamed("parent", "child"), "child", "left")
        up = kept(
            nodes.select(
                "child",
                "parent",
                "n_convs",
                "ender",
                F.coalesce("n", "chain", F.lit(0)).cast("long").alias("n_children"),
                F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
                (F.col("own") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"),
            ),
            f"up/depth={e}",
        )
    first = top.join(_rolled(up), F.col("conv_id") == F.col("parent"), "left").select(
        F.col("conv_id").alias("child"),
        F.lit(None).cast("long").alias("parent"),
        "n_convs",
        "ender",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.lit(0).cast("long").alias("depth"),
    )
    nodes = first.unionByName(spark.read.schema(T.StructType([*up.schema.fields, T.StructField("depth", T.LongType())])).parquet(f"{folder}/up"))
    named = nodes.join(ends.withColumnRenamed("rep", "ender"), "ender", "left")
    named = named.select(F.col("child").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(none)).alias("ends_sha256"))
    return named.unionByName(chains)


def _rolled(level: DataFrame) -> DataFrame:
    """(parent, n, leaves, saved) of a level's nodes."""
    return level.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def prefix_trie(df: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """The trie of the rebuilt conversations of ``df`` (conv_id, turn, role, text); other columns may have any name."""
    own, forget = common.table_of(turns(df))
    out = trie(spliced(own, block, heads), own.select("conv").distinct())
    forget()
    return out
