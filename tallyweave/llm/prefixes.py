"""A prefix trie of conversations by partition refinement.

Conversations are ordered by turn, null first; turns of one number by a digest of role and text. Null role
and text are empty; rows with a null conversation id take no part. Two conversations are in one class of
depth d if their first d turns are equal in role and text; each such class is a node of the trie.

1. Turns are numbered by one range sort and prefix sums over its parts, so that a conversation of any
   length is spread over tasks. Of texts only a digest of 128 bits and the number of words go on.
2. Rebuilding (`rebuilt`) replaces the first h turns of a conversation by those of its donor.
3. Refinement (`refined`) starts with one class of all conversations. Each round takes the next turns of the
   classes still active and splits these turn by turn. Rounds take 4, 8, 16 and so on up to BLOCK turns, so
   that long common beginnings take few rounds. A class of one conversation retires.
4. What a retired conversation still has is emitted as a chain of nodes of one member each, not compared.
5. Folding back adds up, per member, what the nodes that it stands for save from a depth on, within rounds
   and over them, and then over the members of each node, so that no level waits for the one below.
   Hashes over members' ids are taken in order over chunks of at most CHUNK ids, in bounded memory.

Repeated rows are turns of their own. An empty table gives no nodes. Only the four columns named are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FIRST, BLOCK = 4, 1_024
CHUNK = 4_096
#: Most nodes of a round that are broadcast, six numbers each.
BROADCAST_NODES = 100_000
DONORS, MOST = 20, 4
WORD = r"[^\x20\x09-\x0D]+"


def numbered(tables: common.Scratch, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, at, k1, k2, words) in order of at, and (conv_id, part, first, n, before): the runs of a conversation in a part."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(digest, F.lit(1)).alias("k1"), F.xxhash64(digest, F.lit(2)).alias("k2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    order = ["conv_id", "turn", "k1", "k2"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = tables.written(placed.select("conv_id", "k1", "k2", "words", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    runs = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return placed, tables.written(runs, "runs")


def rebuilt(tables: common.Scratch, turns: DataFrame, donors: int = DONORS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, k1, k2, words) of the rebuilt conversations, depth from 1, and (conv_id, length).

    The first h = crc32(decimal id) % most turns come from conversation id - id % donors, as many as it has.
    """
    placed, runs = numbered(tables, turns)
    sizes = runs.groupBy("conv_id").agg(F.sum("n").alias("size"))
    heads = sizes.select("conv_id", "size", (F.col("conv_id") - F.col("conv_id") % donors).alias("donor"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    of_donor = sizes.filter(F.col("conv_id") % donors == 0).select(F.col("conv_id").alias("donor"), F.col("size").alias("given"))
    heads = heads.join(of_donor, "donor", "left").select("conv_id", "size", "donor", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("taken"))
    heads = tables.written(heads, "heads")
    depth = F.col("at") - F.col("first") + F.col("before") + 1
    own = placed.join(runs.join(heads, "conv_id"), ["conv_id", "part"]).withColumn("depth", depth).filter("depth > h")
    own = own.select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "k1", "k2", "words")
    given = placed.filter(F.col("conv_id") % donors == 0).join(runs.filter(F.col("before") < most), ["conv_id", "part"]).withColumn("depth", depth).filter(F.col("depth") < most)
    given = given.select(F.col("conv_id").alias("donor"), "depth", "k1", "k2", "words").join(heads.select("donor", "conv_id", "taken"), "donor").filter("depth <= taken")
    rows = own.unionByName(given.select(own.columns))
    return tables.written(rows, "rebuilt"), tables.written(heads.select("conv_id", (F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")), "lengths")


def refined(tables: common.Scratch, rows: DataFrame, convs: DataFrame, root: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of several members, their members, and retired conversations.

    Nodes: (node, depth, parent, n, words); node is the least member. Members: (conv_id, depth, node, block, saves),
    saves being what the node saves itself, on the row of its least member. Retired: (conv_id, since, parent).
    """
    active = convs.select("conv_id", F.lit(root).cast("long").alias("cls"))
    nodes, members, retired = [], [], []
    low, width, rest = 1, FIRST, rows
    so_far = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while not rest.isEmpty():
        taken = rest.filter(F.col("depth") < low + width).join(active, "conv_id")
        lanes = {f"own{k}": F.xxhash64(F.lit(k), "depth", "k1", "k2") for k in (1, 2)}
        taken = taken.withColumns(lanes).withColumns({f"l{k}": F.bit_xor(f"own{k}").over(so_far) for k in (1, 2)})
        taken = taken.select("conv_id", "depth", "cls", "words", "l1", "l2", F.col("l1").bitwiseXOR(F.col("own1")).alias("p1"), F.col("l2").bitwiseXOR(F.col("own2")).alias("p2"))
        taken = tables.written(taken, "taken")
        split = taken.groupBy("depth", "cls", "l1", "l2").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("node"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
        split = tables.written(split, "split")
        # the class one turn before: of this round, or the one that the round began with
        above = split.filter("n > 1").select((F.col("depth") + 1).alias("depth"), "cls", F.col("l1").alias("p1"), F.col("l2").alias("p2"), F.col("node").alias("above"))
        placed = split.join(above, ["depth", "cls", "p1", "p2"], "left").withColumn("parent", F.when(F.col("depth") == low, F.col("cls")).otherwise(F.col("above")))
        placed = tables.written(placed.select("node", "depth", "parent", "n", "words"), "placed")
        nodes.append(placed.filter("n > 1"))
        # below a retired class a parent is missing here: those are its own turns
        retired.append(placed.filter("n = 1 AND parent IS NOT NULL").select(F.col("node").alias("conv_id"), F.col("depth").alias("since"), "parent"))
        saves = F.when(F.col("node") == F.col("conv_id"), (F.col("n") - 1) * F.col("words")).otherwise(F.lit(0)).alias("saves")
        several = split.filter("n > 1").select("depth", "cls", "l1", "l2", "n", "node")
        found = taken.join(_few(several), ["depth", "cls", "l1", "l2"]).select("conv_id", "depth", "node", F.lit(low).cast("long").alias("block"), saves)
        members.append(tables.written(found, "members"))
        low, width = low + width, min(2 * width, BLOCK)
        active = members[-1].filter(F.col("depth") == low - 1).select("conv_id", F.col("node").alias("cls"))
        rest = tables.written(rest.filter(F.col("depth") >= low).join(active.select("conv_id"), "conv_id", "left_semi"), "rest")

    def all_of(tables_: list[DataFrame], schema: str) -> DataFrame:
        out = tables.spark.createDataFrame([], schema)
        for t in tables_:
            out = out.unionByName(t)
        return out

    return (
        all_of(nodes, "node long, depth long, parent long, n long, words long"),
        all_of(members, "conv_id long, depth long, node long, block long, saves long"),
        all_of(retired, "conv_id long, since long, parent long"),
    )


def _few(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes


def id_hashes(ends: DataFrame) -> DataFrame:
    """(node, depth, ends) of (node, depth, conv_id): the hex SHA-256 of the ids, ascending, comma-joined."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        key, digest, done = None, None, []
        for batch in batches:
            for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
                if (node, depth) != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (node, depth), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pa.record_batch([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["node", "depth", "ends"])
            done = []
        if key is not None:
            yield pa.record_batch([pa.array([x]) for x in (*key, digest.hexdigest())], names=["node", "depth", "ends"])

    chunks = ends.groupBy("node", "depth", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("node", "depth", "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    return chunks.repartition("node", "depth").sortWithinPartitions("node", "depth", "chunk").mapInArrow(common.lean(run), "node long, depth long, ends string")


def trie(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """All nodes: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    common.ship(spark)
    with common.Scratch(spark) as tables:
        rows, lengths = rebuilt(tables, turns)
        root, total = lengths.agg(F.min("conv_id"), F.count(F.lit(1))).first()
        nodes, members, retired = refined(tables, rows, lengths, root)
        top = spark.range(1 if total else 0).select(F.lit(root).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(total).alias("n"), F.lit(0).cast("long").alias("words"))
        nodes = tables.written(nodes.unionByName(top), "nodes")
        whole = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("node"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("saves"))
        members = members.unionByName(whole)

        links = nodes.filter("parent IS NOT NULL").select("parent", (F.col("depth") - 1).alias("depth")).unionByName(retired.select("parent", (F.col("since") - 1).alias("depth")))
        children = links.groupBy(F.col("parent").alias("node"), "depth").agg(F.count(F.lit(1)).alias("n_children"))
        nodes = tables.written(nodes.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

        # each leaf counts for one member: a retired conversation, or the least of those that end together
        leaves = retired.select("conv_id").unionByName(nodes.filter("n_children = 0").select(F.col("node").alias("conv_id"))).withColumn("leaf", F.lit(1).cast("long"))
        blocks = members.groupBy("conv_id", "block").agg(F.sum("saves").alias("later")).filter("later > 0")
        after = Window.partitionBy("conv_id").orderBy("block").rangeBetween(1, Window.unboundedFollowing)
        # what a member saves in the blocks after each of its own; blocks that save nothing ask as well
        asked = members.select("conv_id", "block").distinct().join(blocks, ["conv_id", "block"], "left")
        carried = tables.written(asked.select("conv_id", "block", F.coalesce(F.sum("later").over(after), F.lit(0)).alias("carried")), "carried")
        within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        folded = members.withColumn("saved", F.sum("saves").over(within)).join(carried, ["conv_id", "block"]).join(leaves, "conv_id", "left")
        folded = folded.groupBy("node", "depth").agg(F.sum(F.col("saved") + F.col("carried")).alias("saved_tokens"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))

        stopped = members.join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"])
        ends = id_hashes(stopped.select("node", "depth", "conv_id"))
        several = nodes.join(folded, ["node", "depth"]).join(ends, ["node", "depth"], "left")
        several = several.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))

        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        last = F.col("depth") == F.col("length")
        chains = rows.select("conv_id", "depth").join(retired.join(lengths, "conv_id"), "conv_id").filter("depth >= since")
        chains = chains.select(
            "conv_id",
            "depth",
            F.when(F.col("depth") == F.col("since"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            one.alias("n_convs"),
            F.when(last, zero).otherwise(one).alias("n_children"),
            one.alias("n_leaves"),
            zero.alias("saved_tokens"),
            F.sha2(F.when(last, F.col("conv_id").cast("string")).otherwise(F.lit("")), 256).alias("ends_sha256"),
        )
        return common.written(spark, several.unionByName(chains), "trie")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(spark, common.table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH t AS MATERIALIZED (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL
), c AS MATERIALIZED (
  SELECT conv_id, count(*) AS size, conv_id - conv_id % 20 AS donor,
         xor(list_reduce([CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')],
             lambda h, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda e, k: CASE WHEN e % 2 = 1 THEN xor(e // 2, 3988292384) ELSE e // 2 END, xor(h, x)), 4294967295), 4294967295) % 4 AS h
  FROM t GROUP BY conv_id
), m AS MATERIALIZED (SELECT c.conv_id, c.size, c.donor, c.h, least(c.h, coalesce(o.size, 0)) AS taken FROM c LEFT JOIN c o ON o.conv_id = c.donor),
r AS MATERIALIZED (
  SELECT m.conv_id, t.d - m.h + m.taken AS depth, t.role, t.text FROM m JOIN t ON t.conv_id = m.conv_id WHERE t.d > m.h
  UNION ALL SELECT m.conv_id, t.d, t.role, t.text FROM m JOIN t ON t.conv_id = m.donor WHERE t.d <= m.taken
), q AS MATERIALIZED (
  SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         list(sha256(len(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path
  FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM m
), n AS MATERIALIZED (SELECT depth, path, min(conv_id) AS node, count(*) AS n, min(words) AS words FROM q GROUP BY depth, path),
p AS MATERIALIZED (SELECT q.conv_id, q.depth, n.node, n.n, q.words FROM q JOIN n ON q.depth = n.depth AND q.path = n.path),
e AS (SELECT x.depth, x.node, y.node AS parent, x.n, x.words FROM p x LEFT JOIN p y ON y.conv_id = x.conv_id AND y.depth = x.depth - 1 WHERE x.conv_id = x.node),
k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM e WHERE parent IS NOT NULL GROUP BY ALL),
f AS MATERIALIZED (SELECT e.*, coalesce(k.n_children, 0) AS n_children FROM e LEFT JOIN k ON e.node = k.node AND e.depth = k.depth),
s AS (
  SELECT p.node, p.depth, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum((f.n - 1) * f.words) AS saved
  FROM f JOIN p ON p.conv_id = f.node AND p.depth <= f.depth GROUP BY ALL
), z AS (
  SELECT p.node, p.depth, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids
  FROM p JOIN m ON p.conv_id = m.conv_id WHERE p.depth = m.taken + greatest(m.size - m.h, 0) GROUP BY ALL
)
SELECT CAST(f.node AS BIGINT) AS conv_id, CAST(f.depth AS BIGINT) AS depth, CAST(f.parent AS BIGINT) AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs,
       CAST(f.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(z.ids, '')) AS ends_sha256
FROM f JOIN s ON f.node = s.node AND f.depth = s.depth LEFT JOIN z ON f.node = z.node AND f.depth = z.depth
"""
