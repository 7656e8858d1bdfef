"""The trie of conversation prefixes by prefix doubling: names of power-of-two blocks of turns, composed to names of prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, looked_up, width
from .shard import begins, ranked

#: Ids of one piece of a node's list of ends.
PIECE = 1 << 14
_NONE = hashlib.sha256(b"").hexdigest()


def turns_in_order(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, key, chars) of each turn, and (conv_id, n) of each conversation.

    pos counts from 0 by turn, null first; equal turns stand in order of key, a SHA-256 of role and text, null as empty. Rows
    without a conv_id are no part of any conversation. Positions are places in one order of all turns, so a conversation of
    any length is spread over tasks like the rest.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    narrow = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn"), key.alias("key"), F.char_length(text).alias("chars"))
    rows, n = ranked(narrow, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")], scratch, "turns")
    first = scratch.written(rows.groupBy("conv_id").agg(F.min("__rank").alias("first"), F.count("*").alias("__n")), "conversations")
    placed = looked_up(rows, first, ["conv_id"], n).select("conv_id", (F.col("__rank") - F.col("first")).cast("int").alias("pos"), "key", "chars")
    return placed, first.select("conv_id", F.col("__n").alias("n"))


def with_shared_starts(turns: DataFrame, convs: DataFrame, scratch: Scratch, *, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """turns and convs anew: a conversation c gets the first h turns of conversation c - c % group in place of its own first
    h, with h = crc32(decimal c) % most."""
    facts = convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("host"))
    hosts = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("host"), F.col("n").alias("host_n"))
    facts = facts.join(hosts, "host", "left").withColumn("taken", F.least("h", F.coalesce("host_n", F.lit(0))).cast("int"))
    facts = scratch.written(facts.withColumns({"n": F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)), "__n": F.col("n")}), "rebuilt")
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "host")
    start = heads.join(facts.select("conv_id", "host", "taken"), "host").where("pos < taken").select("conv_id", "pos", "key", "chars")
    turns = scratch.written(turns, "placed")
    own = looked_up(turns, facts.select("conv_id", "h", "taken", "__n"), ["conv_id"], turns.count()).where("pos >= h")
    return start.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "chars")), facts.select("conv_id", "n")


def named(rows: DataFrame, keys: list[str], total: int, scratch: Scratch, label: str) -> DataFrame:
    """rows with `name`, a dense number from 0 for each distinct value of keys, in place of keys. A number for each partition
    reaches the driver; common values meet their rows by broadcast."""
    names = rows.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__at", F.monotonically_increasing_id())
    names = scratch.written(names, f"names-{label}").withColumn("__part", F.shiftright("__at", 33).cast("int"))
    begin, _ = begins(names.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("n")), "__begin")
    names = names.join(F.broadcast(begin), "__part").select(*keys, "__n", (F.col("__begin") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("name"))
    return looked_up(rows, names, keys, total).drop(*keys)


def block_names(turns: DataFrame, longest: int, total: int, scratch: Scratch) -> DataFrame:
    """(conv_id, start, size, name): blocks of 2**k turns that start at multiples of 2**k, named alike where their turns are.
    A block's name stands for the names of its two halves, so a round doubles the size; there are two blocks a turn at most."""
    level = scratch.written(named(turns.select("conv_id", F.col("pos").alias("start"), "key"), ["key"], total, scratch, "turns"), "blocks-1")
    out, size = [level.withColumn("size", F.lit(1))], 1
    while 2 * size <= longest:
        half = F.shiftright("start", size.bit_length() - 1).bitwiseAND(1)
        start = F.col("start") - half * size
        pairs = level.groupBy("conv_id", start.alias("start")).agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"))
        size *= 2
        pairs = scratch.written(pairs.where("right IS NOT NULL"), f"pairs-{size}")
        level = scratch.written(named(pairs, ["left", "right"], total // size, scratch, f"blocks-{size}"), f"blocks-{size}")
        out.append(level.withColumn("size", F.lit(size)))
    blocks = out[0]
    for x in out[1:]:
        blocks = blocks.unionByName(x)
    return blocks


def prefix_names(blocks: DataFrame, longest: int, total: int, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, name) for each prefix of one turn or more, named alike where prefixes of one depth are.

    The binary digits of a depth cut its prefix into aligned blocks, the largest first. A depth of one digit is a block; one of
    r digits is a prefix of r - 1 digits with the block behind it, so round r names all depths of r digits.
    """
    parts = [blocks.where("start = 0").select("conv_id", F.col("size").alias("depth"), "name")]
    while len(parts) < longest.bit_length():
        before = parts[-1]
        low = F.col("depth").bitwiseAND(-F.col("depth"))
        behind = blocks.select("conv_id", F.col("start").alias("depth"), "size", F.col("name").alias("right"))
        pairs = before.withColumnRenamed("name", "left").join(behind, ["conv_id", "depth"]).where(F.col("size") < low)
        label = f"prefixes-{len(parts) + 1}"
        pairs = scratch.written(pairs.select("conv_id", (F.col("depth") + F.col("size")).alias("depth"), "left", "right"), f"pairs-{label}")
        rows = named(pairs.withColumn("of", F.col("depth")), ["of", "left", "right"], total, scratch, label)
        parts.append(scratch.written(rows.select("conv_id", "depth", "name"), label))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _ends(paths: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """(depth, name, ends_sha256): SHA-256 of the decimal ids, in order and comma-joined, of the conversations that end at a node.

    Ids are sorted over all tasks and joined to pieces there; the pieces of a node then pass through its hash one by one, so
    no task holds a node's list.
    """
    last = paths.join(convs.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"])
    order = ["depth", "name", "conv_id"]
    wide = width(paths.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, now = [], None
            for depth, name, conv in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if now != (depth, name) or len(ids) == PIECE:
                    now, ids = (depth, name), []
                    out.append((depth, name, conv, ids))
                ids.append(str(conv))
            yield pa.RecordBatch.from_pylist([{"depth": d, "name": n, "first": f, "ids": ",".join(i)} for d, n, f, i in out], schema=schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for b in batches:
            done = []
            for depth, name, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if now == (depth, name):
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (depth, name), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "name", "ends_sha256"), x, strict=True)) for x in done], schema=hashed)
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"depth": now[0], "name": now[1], "ends_sha256": state.hexdigest()}], schema=hashed)

    schema = pa.schema([("depth", pa.int32()), ("name", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    hashed = pa.schema([("depth", pa.int32()), ("name", pa.int64()), ("ends_sha256", pa.string())])
    listed = last.select(*order).repartitionByRange(wide, *order).sortWithinPartitions(*order).mapInArrow(pieces, "depth int, name long, first long, ids string")
    listed = scratch.written(listed, "pieces")
    return listed.repartition(wide, "depth", "name").sortWithinPartitions("depth", "name", "first").mapInArrow(digests, "depth int, name long, ends_sha256 string")


def _owned_before(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes with `before`, the weight of those above it that have the same smallest member. Ranges of the order (conv_id,
    depth) sum by themselves; a range of one long conversation adds the sums of the ranges before."""
    rows, _ = ranked(nodes, [F.col("conv_id"), F.col("depth")], scratch, "nodes-in-order")
    here = Window.partitionBy("__part", "conv_id").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "__part").agg(F.sum("weight").alias("sum"))  # a row for each range that a conversation is in
    carried = F.sum("sum").over(Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv_id", "__part", F.coalesce(carried, F.lit(0)).alias("carried"))
    rows = rows.withColumn("here", F.coalesce(F.sum("weight").over(here), F.lit(0))).join(parts, ["__part", "conv_id"])
    return rows.withColumn("before", F.col("here") + F.col("carried")).drop("here", "carried", "__part", "__at", "__rank")


def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie of turns (conv_id, pos from 0, key: equal where turns are, chars) of convs (conv_id, n turns).

    Returns, for each distinct prefix that a conversation starts with, the empty one included: conv_id, its smallest member;
    depth; parent_conv_id (root: null); n_convs; n_children; n_leaves, of its subtree; saved_tokens, the sum over its subtree
    of (n_convs - 1) * chars of the last turn; n_ends and ends_sha256, of the members that have no further turn. No
    conversation, no node.

    Sums over subtrees need no walk down the tree. The nodes whose smallest member is c are the lower end of c's path, so the
    sum of a subtree is that of all its members' own nodes, less what the smallest one owns above.
    """
    turns, convs = scratch.written(turns, "in"), scratch.written(convs, "lengths")
    longest, total, n_convs = convs.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    root = convs.select("conv_id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("name"))
    paths = scratch.written(root.unionByName(prefix_names(block_names(turns, longest, total, scratch), longest, total, scratch).withColumn("depth", F.col("depth").cast("int"))), "paths")

    node = ["depth", "name"]
    grouped = paths.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "chars")
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = grouped.join(last, ["conv_id", "depth"], "left").join(above, ["conv_id", "depth"], "left")
    nodes = scratch.written(nodes.select(*node, "conv_id", "n_convs", "parent", ((F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))).alias("weight")), "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = scratch.written(nodes.join(kids, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "with-children")

    owners = nodes.groupBy("conv_id").agg(F.sum("weight").alias("own"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    owners = scratch.written(owners.join(convs, "conv_id").withColumn("__n", F.col("n") + 1).drop("n"), "owners")
    below = looked_up(paths, owners, ["conv_id"], total + n_convs).groupBy(*node).agg(F.sum("own").alias("below"), F.sum("leaf").alias("n_leaves"))

    tops = scratch.written(nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__n")), "tops")
    parents = looked_up(nodes.where("depth > 0").select("depth", "name", "parent"), tops, ["depth", "parent"], nodes.count()).select(*node, "parent_conv_id")
    counts = paths.join(convs.select("conv_id", F.col("n").alias("depth")), ["conv_id", "depth"]).groupBy(*node).agg(F.count("*").alias("n_ends"))
    out = _owned_before(nodes, scratch).join(below, node).join(parents, node, "left").join(counts, node, "left").join(_ends(paths, convs, scratch), node, "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n_convs").cast("long").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), (F.col("below") - F.col("before")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"), F.coalesce("n_ends", F.lit(0)).alias("n_ends"),
    )


def shared_prefixes(conversations: DataFrame, **how) -> DataFrame:
    """The nodes (`prefix_trie`) of conversations (conv_id, turn, role, text) rebuilt by `with_shared_starts`.

    Nulls in turn, role and text have their place (`turns_in_order`), rows without a conv_id have none; repeated rows are turns of
    their own; other columns are not read; an empty table has no nodes, not even a root.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, convs = turns_in_order(conversations, scratch)
    return prefix_trie(*with_shared_starts(turns, convs, scratch, **how), scratch)


#: DuckDB SQL of equal rows. crc32 is spelled out bit by bit; a prefix is a list of keys.
TRIE_SQL = """
with keyed as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(concat(strlen(coalesce(role, ''))::VARCHAR, ':', coalesce(role, ''), coalesce(text, '')))) - 1 as pos,
                      coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
own as (select conv_id, list(struct_pack(r := role, t := text) order by pos) as turns from keyed group by 1),
crc as (select *, (xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
          lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 6)::INTEGER as h from own),
built as (select c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) as turns from crc c left join own b on b.conv_id = c.conv_id - c.conv_id % 100),
paths as (select conv_id, d as depth, turns[1:d] as prefix, turns[1:d - 1] as above, d = len(turns) as ends, case when d > 0 then length(turns[d].t) else 0 end as chars
          from built, lateral (select unnest(range(0, len(turns) + 1)) as d)),
nodes as (select depth, prefix, any_value(above) as above, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(chars) as weight,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' order by conv_id) filter (where ends), '')) as ends_sha256, count(*) filter (where ends) as n_ends from paths group by 1, 2),
kids as (select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes k where k.depth = n.depth + 1 and k.above = n.prefix) as n_children
         from nodes n left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.prefix = n.above)
select n.conv_id, n.depth::BIGINT as depth, n.parent_conv_id, n.n_convs::BIGINT as n_convs, n.n_children::BIGINT as n_children,
       count(*) filter (where u.n_children = 0)::BIGINT as n_leaves, sum(u.weight)::BIGINT as saved_tokens, n.ends_sha256, n.n_ends::BIGINT as n_ends
from kids n join kids u on u.depth >= n.depth and u.prefix[1:n.depth] = n.prefix group by all
"""
