"""Prefix trie of conversations by van Emde Boas recursion.

A trie of sequences of up to D letters is cut at half depth: the first halves form the upper
trie, and the rests form a forest of lower tries, one for every distinct first half. A lower
trie is known by the name of the prefix it hangs on, so upper and lower tries are built side
by side, each cut again. Here all tries of one recursion depth are one Spark job:

1. Up: aligned pieces of 2^k blocks get a name from the names of their halves (``piece_names``).
2. Down: where a trie of span 2^(k+1) blocks is cut, the prefix there is named from the trie's
   own name and the piece between (``forest_names``). The work halves with every level up and
   doubles down again, so both take linear work in logarithmically many rounds, also for one
   conversation that holds a third of all turns.
3. A block is ``BLOCK`` turns: inside, names follow turn by turn within one row. Conversations
   of one block need no round at all.
4. Graft: subtree totals are summed within blocks; then, level by level, the totals of the
   lower tries are added to the nodes of the upper trie above the prefix they hang on.

Names are md5 digests. A turn's digest covers the length of the role, the role and the text,
so no two (role, text) share one by their seam.

Defined cases: rows without conv_id belong to no conversation and are left out (an id is part
of every result); a null turn comes first; a null role or text is empty; turns of one number
are ordered by role, text; equal rows are turns of their own. An empty table has no members
and gives an empty result. Texts may be of any length: only digests travel after the turns
are ordered. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remedy.llm.common import WORD, written
from remedy.operators.corpus import rank_in_group
from remedy.sources.tables import table

BLOCK = 16
#: Fixed values of the contract: conversations share the head of every 20th, up to 3 turns
SHARE, HEADS = 20, 4
#: bytes of ids hashed at a time
RUN = 1 << 12


def _name(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _root() -> Column:
    return _name(F.lit("").cast("binary"))


def turns(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """(c, p, x, w): the turns of every conversation in order (p from 0), as digest and words."""
    r, t = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    rows = conv.select(F.col(conv_id).cast("long").alias("c"), F.col(turn).cast("long").alias("turn"),
                       r.alias("role"), t.alias("text")).filter("c is not null")
    digest = _name(F.length("role").cast("string").cast("binary"), F.lit(":").cast("binary"),
                   F.col("role").cast("binary"), F.col("text").cast("binary"))
    rows = rows.select("c", "turn", "role", "text", digest.alias("x"),
                       F.regexp_count("text", F.lit(WORD)).cast("long").alias("w"), F.monotonically_increasing_id().alias("tie"))
    # equal rows are told apart, so that a range of them can be cut; what orders them is dropped
    ranked = rank_in_group(rows, "c", ["turn", "role", "text", "tie"], "p")
    return ranked.select("c", "p", "x", "w")


def rebuilt(t: DataFrame) -> DataFrame:
    """The contract's conversations: (c, n, d, x, w), d from 1 to n; (c, 0, null, ...) for one
    without turns. c begins with the first h turns of c - c % 20, then follow its own turns
    after its first h; h = crc32(c) % 4."""
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    size = t.groupBy("c").agg(F.count("*").alias("size"))
    heads = t.filter(F.col("p") < HEADS - 1).select(F.col("c").alias("base"), "p", "x", "w")
    base = size.select(F.col("c").alias("base"), F.col("size").alias("b_size"))
    conv = size.withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % SHARE).join(base, "base", "left")
    conv = conv.withColumn("got", F.least("h", F.coalesce("b_size", F.lit(0)))).withColumn(
        "n", F.col("got") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).select("c", "base", "h", "got", "n")
    conv = written(conv, "conversations")
    head = conv.join(heads, "base").filter("p < h").select("c", "n", (F.col("p") + 1).alias("d"), "x", "w")
    own = t.join(conv, "c").filter("p >= h").select("c", "n", (F.col("got") + F.col("p") - F.col("h") + 1).alias("d"), "x", "w")
    none = conv.filter("n = 0").select("c", "n", F.lit(None).cast("long"), F.lit(None).cast("binary"), F.lit(None).cast("long"))
    return head.unionAll(own).unionAll(none)


# ---- names -------------------------------------------------------------------------------

def piece_names(blocks: DataFrame, levels: int) -> list[DataFrame]:
    """(c, j, x) full blocks -> per level k the names (c, j, x) of whole aligned pieces of
    2^k blocks."""
    out = [blocks]
    for _ in range(levels - 1):
        half = out[-1].groupBy("c", F.shiftright("j", 1).alias("up")).agg(
            F.min(F.struct("j", "x")).alias("a"), F.max(F.struct("j", "x")).alias("b"), F.count("*").alias("n"))
        out.append(written(half.filter("n = 2").select("c", F.col("up").alias("j"), _name(F.col("a.x"), F.col("b.x")).alias("x")), "pieces"))
    return out


def forest_names(full: DataFrame, levels: int) -> DataFrame:
    """(c, j, f): the name of the prefix before block j, for every j > 0 behind full blocks.
    ``full``: (c, j, x), the names of full blocks."""
    pieces = piece_names(full, levels)
    f = full.filter("j = 0").select("c", "j", _root().alias("f"))
    for k in reversed(range(levels)):
        cut = pieces[k].filter(F.col("j") % 2 == 0).select("c", F.shiftleft(F.col("j"), k).alias("j"), "x")
        lower = f.join(cut, ["c", "j"]).select("c", (F.col("j") + (1 << k)).alias("j"), _name(F.col("f"), F.col("x")).alias("f"))
        f = written(f.unionAll(lower), "forests")
    return f.filter("j > 0")


def paths(rows: DataFrame) -> tuple[DataFrame, int]:
    """(c, n, d, x, w) -> (c, n, j, f, names, ws): the node names of every block of a
    sequence, f the node before it; and the number of recursion levels above blocks."""
    j = F.floor((F.col("d") - 1) / BLOCK)
    blocks = rows.filter("d is not null").groupBy("c", "n", j.alias("j")).agg(
        F.array_sort(F.collect_list(F.struct("d", "x", "w"))).alias("t"))  # at most BLOCK turns
    blocks = written(blocks, "turn-blocks")
    most = blocks.agg(F.max("j")).first()[0] or 0
    levels = int(most).bit_length()
    if levels:
        whole = F.aggregate("t", F.lit("").cast("binary"), lambda a, s: F.concat(a, s["x"]))
        full = written(blocks.filter(F.size("t") == BLOCK).select("c", "j", _name(whole).alias("x")), "full-blocks")
        forest = forest_names(full, levels)
        # the node at the end of a full block is the one that the next block hangs on
        ends = forest.select("c", (F.col("j") - 1).alias("j"), F.col("f").alias("end"))
        blocks = blocks.join(forest, ["c", "j"], "left").join(ends, ["c", "j"], "left")
    else:
        blocks = blocks.withColumns({x: F.lit(None).cast("binary") for x in ("f", "end")})
    blocks = blocks.withColumn("f", F.coalesce("f", _root()))
    step = lambda a, s: F.concat(a, F.array(_name(F.element_at(a, -1), s["x"])))
    names = F.aggregate("t", F.array("f"), step)
    names = F.slice(names, 2, BLOCK)
    names = F.when(F.col("end").isNull(), names).otherwise(F.concat(F.slice(names, 1, BLOCK - 1), F.array("end")))
    named = blocks.select("c", "n", "j", "f", names.alias("names"), F.transform("t", lambda s: s["w"]).alias("ws"))
    return written(named, "paths"), levels


# ---- nodes and totals ----------------------------------------------------------------------

def nodes_of(path: DataFrame) -> DataFrame:
    """(name, parent, depth, w, c, n_convs): every node but the root, c its smallest member."""
    at = path.select("c", "j", "f", "names", "ws", F.posexplode("names").alias("i", "name"))
    return at.groupBy(
        "name", F.when(F.col("i") == 0, F.col("f")).otherwise(F.get("names", F.col("i") - 1)).alias("parent"),
        (F.col("j") * BLOCK + F.col("i") + 1).alias("depth"), F.get("ws", F.col("i")).alias("w")).agg(
        F.min("c").alias("c"), F.count("*").alias("n_convs"))


def subtree_totals(nodes: DataFrame, path: DataFrame, levels: int) -> DataFrame:
    """nodes with ``leaf`` and ``own`` -> (name, leaves, saved) over their subtrees."""
    steps = path.select("c", "j", "names")
    # within blocks: a node with a weight adds it to itself and the nodes above it in its block
    heavy = nodes.filter("leaf > 0 or own > 0").select(
        "c", F.floor((F.col("depth") - 1) / BLOCK).alias("j"), ((F.col("depth") - 1) % BLOCK + 1).cast("int").alias("i"), "leaf", "own")
    up = heavy.join(steps, ["c", "j"]).select(F.explode(F.slice("names", F.lit(1), F.col("i"))).alias("name"), "leaf", "own")
    total = up.groupBy("name").agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
    if not levels:
        return total
    total = written(total, "totals")
    place = written(nodes.select("name", "parent", "depth", "c"), "places")
    for k in range(levels):
        span = BLOCK << k
        # tops of the lower tries: one below a cut at an odd multiple of the span
        tops = place.filter(((F.col("depth") - 1) % (2 * span) == span)).join(total, "name")
        hung = tops.groupBy(F.col("parent").alias("name")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        cut = hung.join(place.select("name", "depth", "c"), "name")
        last = (F.col("depth") / BLOCK).cast("long") - 1
        over = cut.select("c", F.explode(F.sequence(last - (1 << k) + 1, last)).alias("j"), "leaves", "saved")
        grafts = over.join(steps, ["c", "j"]).select(F.explode("names").alias("name"), "leaves", "saved")
        total = written(total.unionByName(grafts).groupBy("name").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "totals")
    return total


def end_digests(ends: DataFrame) -> DataFrame:
    """(name, c) -> (name, ends_sha256): the ids of a node, ascending and comma-joined, hashed.
    Ids are sorted over range partitions that also cut a node's ids, and joined to strings of
    about ``RUN`` bytes there; those stream through the hash in order."""
    n = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, ids, size = None, None, [], 0

        def row(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))],
                                              names=["name", "first", "ids"])

        for b in batches:
            out = []
            for x, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (x != name or size > RUN):
                    out.append((name, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    name, first = x, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield row(out)
        if ids:
            yield row([(name, first, ",".join(ids))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, h = None, None
        for b in batches:
            out = []
            for x, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if x != name:
                    if h:
                        out.append((name, h.hexdigest()))
                    name, h = x, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())],
                                             names=["name", "ends_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([h.hexdigest()])], names=["name", "ends_sha256"])

    runs = ends.select("name", "c").repartitionByRange(n, "name", "c").sortWithinPartitions("name", "c").mapInArrow(
        join, "name binary, first long, ids string")
    return runs.repartition(n, "name").sortWithinPartitions("name", "first").select("name", "ids").mapInArrow(
        digest, "name binary, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """(c, n, d, x, w): sequences c of n letters x with word counts w (one row with d null for
    an empty one) -> a row per node of their trie: name, conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = written(rows, "rebuilt")
    path, levels = paths(rows)
    base = written(nodes_of(path), "nodes")
    children = base.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = base.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("w"))
    nodes = written(nodes, "nodes")
    nodes = nodes.join(subtree_totals(nodes, path, levels), "name", "left").withColumns(
        {k: F.coalesce(k, F.lit(0)) for k in ("leaves", "saved")})

    ends = path.filter(F.col("j") == F.floor((F.col("n") - 1) / BLOCK)).select(F.element_at("names", -1).alias("name"), "c")
    empty = rows.filter("n = 0").select(_root().alias("name"), "c")
    digests = end_digests(ends.unionAll(empty))

    # the root: every sequence is a member; one row each for its sums
    top = base.filter("depth = 1")
    members = rows.filter("d is null or d = 1").agg(F.min("c").alias("c"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    sums = nodes.filter("depth = 1").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = members.crossJoin(sums).select(
        _root().alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "c", "n_convs", "n_children",
        F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))

    # below the first turns a parent is found by name; above them it is the root, one row
    up = base.select(F.col("name").alias("parent"), F.col("c").alias("parent_conv_id"))
    deep = nodes.filter("depth > 1").join(up, "parent")
    high = nodes.filter("depth = 1").crossJoin(F.broadcast(members.select(F.col("c").alias("parent_conv_id"))))
    cols = ["name", "c", "depth", "parent_conv_id", "n_convs", "n_children", "leaves", "saved"]
    out = deep.select(cols).unionByName(high.select(cols)).unionByName(
        root.withColumn("parent_conv_id", F.lit(None).cast("long")).select(cols))
    return out.join(digests, "name", "left").select(
        "name", F.col("c").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(written(turns(conv), "turns"))).drop("name")


QUERIES = {"op13_trie": op13_trie}

ORACLE = {"op13_trie": """
WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT i, v FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, 0 AS pos, 4294967295::BIGINT AS s FROM ids
  UNION ALL SELECT crc.c, pos + 1, xor(crc.s >> 8, tab.v) FROM crc JOIN tab
    ON tab.i = xor(crc.s & 255, ascii(substr(crc.c::VARCHAR, pos + 1, 1))) WHERE pos < length(crc.c::VARCHAR)),
conv AS (SELECT c, c - c % 20 AS base, xor(s, 4294967295) % 4 AS h FROM crc WHERE pos = length(c::VARCHAR)),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p,
        coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
reb AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, md5(length(r)::VARCHAR || ':' || r || x) AS x,
          len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w
        FROM (SELECT conv.c, 0 AS part, t.p, t.r, t.x FROM conv JOIN t ON t.c = conv.base AND t.p < conv.h
              UNION ALL SELECT t.c, 1, t.p, t.r, t.x FROM t JOIN conv ON t.c = conv.c AND t.p >= conv.h)),
path AS (SELECT c, d, string_agg(x, '') OVER (PARTITION BY c ORDER BY d) AS name, w FROM reb
         UNION ALL SELECT c, 0, '', 0 FROM ids),
size AS (SELECT c, max(d) AS n FROM path GROUP BY c),
up AS (SELECT a.c, a.d, a.name, a.w, b.name AS parent FROM path a LEFT JOIN path b ON a.c = b.c AND b.d = a.d - 1),
node AS (SELECT name, any_value(parent) AS parent, any_value(d) AS d, any_value(w) AS w, min(c) AS c, count(*) AS n FROM up GROUP BY name),
kids AS (SELECT parent AS name, count(*) AS k FROM node WHERE parent IS NOT NULL GROUP BY parent),
own AS (SELECT node.*, coalesce(k, 0) AS k, (node.n - 1) * w AS s FROM node LEFT JOIN kids USING (name)),
tot AS (SELECT p.name, sum((own.k = 0)::INT)::BIGINT AS leaves, sum(own.s)::BIGINT AS saved
        FROM own JOIN path p ON p.c = own.c AND p.d <= own.d GROUP BY p.name),
fin AS (SELECT p.name, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS e FROM path p JOIN size ON p.c = size.c AND p.d = size.n GROUP BY p.name)
SELECT own.c AS conv_id, own.d::BIGINT AS depth, pa.c AS parent_conv_id, own.n::BIGINT AS n_convs, own.k::BIGINT AS n_children,
       tot.leaves AS n_leaves, tot.saved AS saved_tokens, sha256(coalesce(fin.e, '')) AS ends_sha256
FROM own JOIN tot USING (name) LEFT JOIN node pa ON pa.name = own.parent LEFT JOIN fin ON fin.name = own.name
"""}
