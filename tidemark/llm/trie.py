"""The prefix trie of conversations by whole-sequence collapse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._order import running
from tidemark.llm._work import hot_join, hot_keys, saved

#: A conversation begins with turns of the first of its GROUP neighbours, fewer than HEADS.
GROUP, HEADS = 5, 9
#: Bytes of a chunk of an end list.
CHUNK = 1 << 16

#: A node is its depth and two hashes of its turns (128 bits in all).
NODE = ["depth", "p1", "p2"]
_ROOT = ["0L depth", "0L p1", "0L p2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, t1, t2, bytes, one: a row per turn with a conv_id, its text as two hashes and its UTF-8 bytes.

    No text leaves the scan. Null roles and texts are empty.
    """
    return conversations.where("conv_id is not null").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "coalesce(role, '') role", "coalesce(text, '') text").selectExpr(
        "conv_id", "turn", "xxhash64(role, text) t1", "xxhash64(1L, text, role) t2", "cast(octet_length(text) as long) bytes", "1L one"
    )


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """The turns of all rebuilt conversations, and a row per conversation: conv_id, length.

    Conversation c has the first h turns of conversation c - c % group, then its own after its first h,
    where h is the crc32 of its decimal id modulo `heads`. The turns are conv_id, depth (from 1), length,
    bytes, upto (the bytes to here) and p1, p2, the hashes of the turns to here, of which each is the xor
    of hashes of depth and turn. A conversation may spread over any number of tasks.
    """
    own = running(turns(conversations), "conv_id", [F.asc_nulls_first("turn"), F.asc("t1"), F.asc("t2")], {"idx": "one"})
    sizes = saved(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    info = saved(
        sizes.withColumn("base", F.expr(f"conv_id - conv_id % {group}L"))
        .join(bases, "base", "left")
        .withColumn("h", F.expr(f"pmod(crc32(cast(cast(conv_id as string) as binary)), {heads}L)"))
        .withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
        .withColumn("length", F.expr("head + greatest(n - h, 0L)"))
        .select("conv_id", "base", "h", "head", "length", "n")
    )
    hot = hot_keys(sizes, "conv_id")
    tails = hot_join(own, info, "conv_id", ["idx"], hot).where("idx > h").selectExpr("conv_id", "idx - h + head depth", "length", "bytes", "t1", "t2")
    firsts = own.where(F.col("idx") < heads).select(F.col("conv_id").alias("base"), "idx", "bytes", "t1", "t2")
    begun = firsts.join(info, "base").where("idx <= head").selectExpr("conv_id", "idx depth", "length", "bytes", "t1", "t2")
    rows = tails.unionByName(begun).selectExpr("conv_id", "depth", "length", "bytes", "xxhash64(depth, t1, t2) e1", "xxhash64(t2, depth, t1) e2")
    return running(rows, "conv_id", [F.asc("depth")], {"upto": "bytes"}, {"p1": "e1", "p2": "e2"}), info.select("conv_id", "length")


def sequences(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id and the whole sequence of each conversation, as its last node, with its bytes; the root where it has no turns."""
    return paths.where("depth = length").select("conv_id", *NODE, F.col("upto").alias("total")).unionByName(lengths.where("length = 0").selectExpr("conv_id", *_ROOT, "0L total"))


def end_lists(ends: DataFrame) -> DataFrame:
    """The conversations that end at each node, as chunks: depth, p1, p2, part, no, ids (ascending, comma-joined).

    Ids are dealt by ranges of node and id, so that a node's list may spread over tasks; a chunk has some
    CHUNK bytes, and the order of a node's chunks is that of part and no.
    """
    schema = "depth long, p1 long, p2 long, part int, no int, ids string"
    names = [*NODE, "part", "no", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, node, held, size, no = TaskContext.get().partitionId(), None, [], 0, 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([part], pa.int32()), pa.array([no], pa.int32()), pa.array([",".join(held)])], names)

        for batch in batches:
            for *at, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if at != node or size > CHUNK:
                    if held:
                        yield chunk()
                    no = no + 1 if at == node else 0
                    node, held, size = at, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield chunk()

    order = [*NODE, "conv_id"]
    return ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def list_digests(chunks: DataFrame) -> DataFrame:
    """depth, p1, p2, ends_sha256: the digest of each node's whole list, read chunk by chunk."""
    schema = "depth long, p1 long, p2 long, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        row = lambda: pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([digest.hexdigest()])], [*NODE, "ends_sha256"])
        for batch in batches:
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"])):
                if at != node:
                    if node is not None:
                        yield row()
                    node, digest = at, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if node is not None:
            yield row()

    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "part", "no").mapInArrow(run, schema)


def nodes(paths: DataFrame, lengths: DataFrame, ends: DataFrame) -> DataFrame:
    """depth, p1, p2, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens: the nodes of the trie.

    Identical conversations are one weighted sequence, named by its smallest id. Sequences that are proper
    prefixes of others go by an anti-join; the others are the leaves. A node's figures are sums over the
    weighted sequences that begin with it: no walk over the tree, whatever its depth. What a subtree saves
    is the bytes that its conversations spend from the node on, less the bytes of its distinct nodes;
    these are counted at the smallest sequence through each, which has them at its end, without a gap.
    """
    zero = F.lit(0).cast("long")
    whole = saved(ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("w"), F.min("conv_id").alias("rep"), F.max("total").alias("total")))
    inner = paths.where("depth < length").select(*NODE).unionByName(lengths.where("length > 0").selectExpr(*_ROOT)).distinct()
    inner = saved(inner)
    leaves = whole.join(inner, NODE, "left_anti").withColumn("leaf", F.lit(1).cast("long"))
    weighted = saved(leaves.unionByName(whole.join(inner, NODE, "left_semi").withColumn("leaf", zero)))
    hot = hot_keys(lengths.select(F.col("conv_id").alias("rep"), F.col("length").alias("n")), "rep")
    steps = paths.select(F.col("conv_id").alias("rep"), *NODE, "e1", "e2", "bytes", F.expr("upto - bytes").alias("before"))

    def along(table: DataFrame) -> DataFrame:
        """Every prefix of the sequences named in `table`, the root included, with the columns of `table`."""
        root = table.selectExpr("*", *_ROOT, "0L e1", "0L e2", "0L bytes", "0L before")
        return hot_join(steps, table, "rep", ["depth"], hot).unionByName(root)

    found = saved(
        along(weighted.select("rep", "w", "leaf", "total"))
        .groupBy(*NODE)
        .agg(
            F.min("rep").alias("conv_id"),
            F.sum("w").alias("n_convs"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.col("w") * (F.col("total") - F.col("before"))).alias("spent"),
            *(F.max(c).alias(c) for c in ("before", "e1", "e2")),
        )
    )
    owned = found.groupBy(F.col("conv_id").alias("rep")).agg(F.min("before").alias("since"), F.min("depth").alias("least")).join(weighted.select("rep", "total"), "rep")
    distinct = along(owned).groupBy(*NODE).agg(F.sum(F.col("total") - F.when(F.col("depth") < F.col("least"), F.col("since")).otherwise(F.col("before"))).alias("once"))
    up = F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("e2")).alias("p2"))
    below = found.where("depth > 0").withColumn("up", up)
    children = saved(below.groupBy("up").agg(F.count(F.lit(1)).alias("n")))
    parents = found.select(F.struct(*NODE).alias("up"), F.col("conv_id").alias("parent_conv_id"))
    linked = hot_join(below, parents, "up", NODE, hot_keys(children, "up")).select(*NODE, "parent_conv_id")
    counts = children.select("up.*", F.col("n").alias("n_children"))
    return (
        found.join(distinct, NODE)
        .join(counts, NODE, "left")
        .join(linked, NODE, "left")
        .select(*NODE, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", (F.col("spent") - F.col("once")).alias("saved_tokens"))
    )


def trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of rebuilt conversations, and their end lists in chunks (`nodes`, `end_lists`).

    Turns are in the order of `turn`, null first; turns of one number by the hashes of role and text, so
    that equal rows may stand in any order. Rows without a conv_id belong to no conversation; repeated
    rows are turns as any other; other columns are ignored. Without a conversation there is no root: both
    tables are empty.
    """
    paths, lengths = rebuilt(conversations, group, heads)
    ends = saved(sequences(paths, lengths))
    return nodes(paths, lengths, ends), end_lists(ends)


def trie_digest(conversations: DataFrame) -> DataFrame:
    """`trie` with a digest for each node's end list: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found, chunks = trie(conversations)
    empty = F.lit(hashlib.sha256().hexdigest())
    return found.join(list_digests(chunks), NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
