"""Trie of conversation prefixes, by fixed-length block digests refined where siblings diverge."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from watchkeep.llm.common import prepare, store
from watchkeep.llm.running import running

BLOCK = 4
ID_TEXT_BYTES = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(c, at, h1, h2, bytes): turns without their texts, numbered from 0 inside every conversation.

    h1 and h2 together identify role and text.  Equal turn numbers are ordered
    by these hashes.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = store(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn"), F.xxhash64(F.lit(1), role, text).alias("h1"),
        F.xxhash64(F.lit(2), role, text).alias("h2"), F.octet_length(text).cast("long").alias("bytes"),
        F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("row")), "turns")
    return running(turns, "c", ["turn", "h1", "h2", "row"], ["one"], name="numbered").select(
        "c", F.col("one_before").alias("at"), "h1", "h2", "bytes")


def with_shared_openings(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(c, total) of every conversation and (c, total, at, h1, h2, bytes) of its turns, each opened like its family's first.

    Conversation c takes the first h turns of c - c % family, h being
    crc32(c) % most, and goes on with its own turns after the first h.
    """
    own = turns.groupBy("c").agg(F.count("*").alias("own")).select(
        "c", "own", (F.crc32(F.col("c").cast("string")) % most).alias("h"), (F.col("c") - F.col("c") % family).alias("base"))
    own = store(own, "conversations")
    base = own.select(F.col("c").alias("base"), F.col("own").alias("of_base"))
    convs = store(own.join(base, "base", "left").select(
        "c", "base", "h", F.least("h", F.coalesce("of_base", F.lit(0))).alias("opening"),
    ).join(own.select("c", "own"), "c").withColumn("total", F.col("opening") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "openings")
    # Both sides of the joins are stored tables, so that adaptive execution can split a long conversation.
    rest = turns.join(convs.drop("base"), "c").where("at >= h").select(
        "c", "total", (F.col("opening") + F.col("at") - F.col("h")).alias("at"), "h1", "h2", "bytes")
    heads = turns.where(F.col("at") < most - 1).withColumnRenamed("c", "base").join(
        convs.select("c", "base", "h", "total"), "base").where("at < h").select("c", "total", "at", "h1", "h2", "bytes")
    return convs.select("c", "total"), rest.unionByName(heads)


def blocks_of(turns: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` consecutive turns with their digests, and the digest and bytes of all before.

    A block's part in the chained digest is a hash of its content and number;
    parts are joined by exclusive or, so that a conversation of any length is
    chained by a running sum.
    """
    turn = F.struct("at", "h1", "h2", "bytes")
    blocks = turns.groupBy("c", "total", F.floor(F.col("at") / size).cast("long").alias("k")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))  # at most ``size`` turns
    told = store(blocks.select(
        "c", "total", "k", "turns", F.xxhash64(F.lit(3), "turns").alias("d1"), F.xxhash64(F.lit(4), "turns").alias("d2"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["bytes"]).alias("bytes")), "blocks")
    return running(told, "c", ["k"], ["bytes"], ["d1", "d2"], "chained")


def node_key(turns: Column, size: int) -> list[Column]:
    """Both halves of the key of the node that a block's first turns lead to; the chained digest at the block's end."""
    whole = F.size(turns) == size
    return [F.when(whole, F.col(f"{d}_before").bitwiseXOR(F.col(d))).otherwise(
        F.xxhash64(F.lit(seed), F.col(f"{d}_before"), turns)).alias(name)
        for d, seed, name in (("d1", 5, "key1"), ("d2", 6, "key2"))]


GROUP = ["k", "d1_before", "d2_before", "d1", "d2"]


def block_groups(blocks: DataFrame, measures: list[str]) -> DataFrame:
    """Conversations grouped by chained digest: one row per distinct block, with its first conversation's turns.

    ``siblings`` counts the distinct blocks that follow the same conversations' common prefix.
    """
    groups = store(blocks.groupBy(*GROUP).agg(
        F.min("c").alias("c"), F.count("*").alias("n"), *[F.sum(m).alias(m) for m in measures]), "groups")
    siblings = store(groups.groupBy(*GROUP[:3]).agg(F.count("*").alias("siblings")), "siblings")
    first = blocks.select("c", "k", "turns", F.col("bytes_before").alias("before"))
    return store(groups.join(first, ["c", "k"]).join(siblings, GROUP[:3]), "members")


def nodes_of(groups: DataFrame, measures: list[str], size: int) -> DataFrame:
    """(depth, key1, key2, parent1, parent2, bytes, before, c, n, measures) of every node below the root.

    Where one block alone follows, its turns are nodes as they stand; only
    blocks with siblings are compared turn by turn.
    """
    place = F.col("place")
    cut = groups.select("*", F.explode(F.sequence(F.lit(1), F.size("turns"))).alias("place"))
    prefix, shorter = F.slice("turns", 1, place), F.slice("turns", 1, place - 1)
    keys, above = node_key(prefix, size), node_key(shorter, size)
    nodes = cut.select(
        (F.col("k") * size + place).alias("depth"), *keys,
        *[F.when(place == 1, F.col(f"d{i}_before")).otherwise(above[i - 1]).alias(f"parent{i}") for i in (1, 2)],
        F.element_at("turns", place)["bytes"].alias("bytes"),
        (F.col("before") + F.aggregate(shorter, F.lit(0).cast("long"), lambda n, t: n + t["bytes"])).alias("before"),
        "c", "n", *measures, "siblings")
    identity = ["depth", "key1", "key2", "parent1", "parent2", "bytes", "before"]
    apart = nodes.where("siblings > 1").groupBy(*identity).agg(
        F.min("c").alias("c"), F.sum("n").alias("n"), *[F.sum(m).alias(m) for m in measures])
    return nodes.where("siblings = 1").drop("siblings").unionByName(apart)


def _id_texts(batches):
    """Sorted (key1, key2, c) as texts of comma-joined ids, of bounded length."""
    held = {"key1": [], "key2": [], "c": [], "ids": []}
    at, begin, ids, size = None, None, [], 0

    def flush():
        if ids:
            for k, v in zip(held, (*at, begin, ",".join(ids))):
                held[k].append(v)

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("key1", "key2", "c"))):
            if row[:2] != at or size > ID_TEXT_BYTES:
                flush()
                at, begin, ids, size = row[:2], row[2], [], 0
            ids.append(str(row[2]))
            size += len(ids[-1]) + 1
        if len(held["c"]) > 10_000 or sum(map(len, held["ids"])) > ID_TEXT_BYTES:
            yield pa.RecordBatch.from_pydict(held, schema=_ID_TEXT)
            held = {k: [] for k in held}
    flush()
    yield pa.RecordBatch.from_pydict(held, schema=_ID_TEXT)


_ID_TEXT = pa.schema([("key1", pa.int64()), ("key2", pa.int64()), ("c", pa.int64()), ("ids", pa.string())])
_DIGEST = pa.schema([("key1", pa.int64()), ("key2", pa.int64()), ("ends_sha256", pa.string())])


def _id_digests(batches):
    """One digest per key of its sorted texts; a text is let go once it is hashed."""
    at, digest, out = None, None, []
    for batch in batches:
        for key1, key2, ids in zip(*(batch.column(n).to_pylist() for n in ("key1", "key2", "ids"))):
            if (key1, key2) == at:
                digest.update(b"," + ids.encode())
                continue
            if at:
                out.append((*at, digest.hexdigest()))
            at, digest = (key1, key2), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(_DIGEST.names, zip(*out))), schema=_DIGEST)
            out = []
    if at:
        yield pa.RecordBatch.from_pydict(dict(zip(_DIGEST.names, ([v] for v in (*at, digest.hexdigest())))), schema=_DIGEST)


def id_digests(ends: DataFrame) -> DataFrame:
    """(key1, key2, ends_sha256): digest of each node's ids in ascending order, comma-joined.

    Ids are sorted and joined to texts of about a megabyte in ranges, so one
    node's ids are spread; then only the texts meet, one after the other.
    """
    order = ["key1", "key2", "c"]
    texts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _id_texts, "key1 long, key2 long, c long, ids string")
    return store(texts.repartition("key1", "key2").sortWithinPartitions(*order).mapInArrow(
        _id_digests, "key1 long, key2 long, ends_sha256 string"), "ends")


def prefix_trie(conversations: DataFrame, family: int = 5, most: int = 9, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations; see ``with_shared_openings``.

    Figures over a subtree need no walk over the tree.  A node belongs to its
    smallest member; a conversation's own nodes are the end of its path, and
    ``shared`` are the bytes of the turns before them.  Summed over a node's
    members, less those before the node, these are the bytes saved below it;
    its leaves are the members that own one.

    Null roles and texts are empty; rows without a conv_id belong to no
    conversation and are left out; turns are ordered null first, equal turn
    numbers by a hash of role and text, and repeated rows are turns of their
    own; texts of any length only pass a hash; a table without conversations
    has no nodes, not even a root; other columns are not read.
    """
    prepare(conversations.sparkSession)
    turns = numbered_turns(conversations)
    convs, rebuilt = with_shared_openings(turns, family, most)
    blocks = blocks_of(rebuilt, block)
    nodes = store(nodes_of(block_groups(blocks, []), [], block), "nodes")
    children = store(nodes.groupBy(F.col("parent1").alias("key1"), F.col("parent2").alias("key2")).agg(
        F.count("*").alias("n_children")), "children")
    # What each conversation adds to the figures of all nodes on its path.
    owners = nodes.join(children, ["key1", "key2"], "left").groupBy("c").agg(
        F.min("before").alias("before_own"), F.max(F.col("n_children").isNull().cast("long")).alias("own_leaf"))
    paths = blocks.groupBy("c").agg(F.sum("bytes").alias("path_bytes"))
    weights = store(convs.join(paths, "c", "left").join(store(owners, "owners"), "c", "left").select(
        "c", "total", F.coalesce("before_own", "path_bytes", F.lit(0)).cast("long").alias("shared"),
        F.coalesce("own_leaf", F.lit(0)).cast("long").alias("leaves")), "weights")
    measures = ["shared", "leaves"]
    counted = blocks.join(weights.drop("total"), "c")
    below = nodes_of(block_groups(counted, measures), measures, block)
    root = weights.agg(F.min("c").alias("c"), F.count("*").alias("n"), *[F.sum(m).alias(m) for m in measures]).where("n > 0").select(
        F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in ("key1", "key2")],
        *[F.lit(None).cast("long").alias(k) for k in ("parent1", "parent2")], *[F.lit(0).cast("long").alias(k) for k in ("bytes", "before")],
        "c", "n", *measures)
    whole = store(below.unionByName(root), "trie")
    last = blocks.where(F.col("total") <= (F.col("k") + 1) * block).select("c", *node_key(F.col("turns"), block))
    turnless = weights.where("total = 0").select("c", *[F.lit(0).cast("long").alias(k) for k in ("key1", "key2")])
    digests = id_digests(store(last.unionByName(turnless), "last"))
    parents = store(whole.select(F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("c").alias("parent_conv_id")), "parents")
    own_shared = weights.select("c", F.col("shared").alias("own_shared"))
    return whole.join(children, ["key1", "key2"], "left").join(digests, ["key1", "key2"], "left").join(
        parents, ["parent1", "parent2"], "left").join(own_shared, "c").select(
        F.col("c").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children").isNull(), F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        (F.col("shared") - F.col("own_shared") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
