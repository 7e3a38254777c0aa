"""Prefix trie of conversations, built by union-find over neighbours in sorted order.

Every conversation becomes the sequence of its turns' digests. In sorted order a node's members stand
side by side, so the longest common prefixes (LCPs) of neighbours say all about the trie. The order is
cut into ranges, and each range builds its forest alone: edges between neighbours are taken in
descending depth, and where an edge unites components, a branching node appears at its depth; the
nodes on the way up from each of them are those with one child. Only nodes that reach over a border
of a range, the prefixes common to the rows on both sides of it, stay open. They leave as partial
figures that add up, and are merged by their prefix digest; all other nodes are final.

No task holds a whole conversation or a hot one's rows:

* turns are numbered by ranges of (conversation, turn) and the counts of the ranges before;
* conversations are cut into slabs of ``SLAB`` turns. A slab's rows are sorted below the digest of all
  that came before, slabs are worked off from the deepest, and what lies below a slab's last turn (its
  children, leaves and savings) enters as figures of that node;
* equal conversations are ordered by id, so ranges split them too; ids of those that end in an open
  node leave as pieces of text, which are hashed as a stream in the order of the ranges.

Texts are needed for the order of turns alone; after that a turn is 16 bytes of digest and a length.

Cases: turns that tie are ordered by role, then text; null turns come first, null roles and texts
are empty; rows with a null conversation id belong to no conversation; repeated rows are turns of
their own; ids are taken modulo 100 as SQL does, with the sign of the id; an absent first
conversation gives no turns; an empty table has no conversations and so no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import parts, start, written
from tidegate.session import broadcast_if_small

SLAB = 4096  # turns that a row holds
HEADS = 6  # conversations share fewer turns than this with the first of their hundred
TURNS_PER_RANGE = 400_000
ROWS_PER_RANGE = 20_000
IDS_PER_PIECE = 400
DIGEST = 16  # bytes

# --- sequences -----------------------------------------------------------------------------------


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, digest, chars) of every turn, in the order of its conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranges = turns.repartitionByRange(parts(turns, TURNS_PER_RANGE), *order)
    # The length of the role keeps (a, bc) and (ab, c) apart.
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    own = F.row_number().over(Window.partitionBy("range", "conv_id").orderBy(*order))
    local = written(
        ranges.withColumn("range", F.spark_partition_id())
        .withColumn("own", own)
        .select("range", "conv_id", "own", digest.alias("digest"), F.char_length("text").cast("long").alias("chars")),
        "turns",
    )
    # A conversation has a row here for each range that it reaches into: two, unless it is a hot one.
    sizes = local.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    reaching = sizes.withColumn("before", F.sum("size").over(earlier)).where(F.col("before").isNotNull())
    reaching = written(reaching.select("conv_id", "range", "before"), "reaching")
    joined = local.join(broadcast_if_small(reaching)[0], ["conv_id", "range"], "left")
    return joined.select(
        "conv_id", (F.coalesce("before", F.lit(0)) + F.col("own") - 1).alias("pos"), "digest", "chars"
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation's id, and the turns of all: those of its hundred's first, then its own after them."""
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    convs = turns.where("pos = 0").select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("first"), head.alias("head")
    )
    firsts = turns.where(F.col("pos") < HEADS - 1).where("conv_id % 100 = 0")
    firsts = firsts.select(F.col("conv_id").alias("first"), "pos", "digest", "chars")
    shared = convs.join(firsts, "first").where("pos < head")  # under six turns for each of a hundred
    shared = shared.select("conv_id", "pos", "digest", "chars")
    known = firsts.groupBy("first").agg(F.count(F.lit(1)).alias("known"))
    at = convs.join(known, "first", "left").select(
        "conv_id", "head", F.least("head", F.coalesce("known", F.lit(0))).alias("given")
    )
    rest = turns.join(at, "conv_id").where("pos >= head")
    rest = rest.select("conv_id", (F.col("given") + F.col("pos") - F.col("head")).alias("pos"), "digest", "chars")
    return convs.select("conv_id"), shared.unionByName(rest)


def slabs(convs: DataFrame, turns: DataFrame, slab: int = SLAB) -> DataFrame:
    """(slab, above, seq, chars, upto, goes_on, conv_id): a row for every ``slab`` turns of a conversation.

    ``above`` is the digest of all turns before the row's, ``upto`` of all up to its last. ``seq`` is the
    turns' digests, with ``upto`` after them where the conversation goes on.
    """
    turn = F.struct("pos", "digest", "chars")
    rows = turns.withColumn("slab", F.floor(F.col("pos") / slab)).groupBy("conv_id", "slab").agg(
        F.array_sort(F.collect_list(turn)).alias("t"),  # at most ``slab`` turns
        *[F.bit_xor(F.xxhash64("digest", "pos", F.lit(salt))).alias(f"x{salt}") for salt in (1, 2)],
    )
    along = Window.partitionBy("conv_id").orderBy("slab")
    upto = F.concat(*[F.lpad(F.hex(F.bit_xor(f"x{salt}").over(along)), 16, "0") for salt in (1, 2)])
    rows = rows.withColumn("upto", upto)
    rows = rows.select(
        "conv_id",
        "slab",
        F.unhex(F.coalesce(F.lag("upto").over(along), F.lit(""))).alias("above"),
        F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), "")).alias("seq"),
        F.transform("t", lambda x: x["chars"]).alias("chars"),
        F.unhex("upto").alias("upto"),
        F.lead("slab").over(along).isNotNull().alias("goes_on"),
    ).withColumn("seq", F.when(F.col("goes_on"), F.concat("seq", "upto")).otherwise(F.col("seq")))
    turnless = convs.join(rows.where("slab = 0").select("conv_id"), "conv_id", "left_anti").select(
        "conv_id",
        F.lit(0).cast("long").alias("slab"),
        F.lit(b"").alias("above"),
        F.lit(b"").alias("seq"),
        F.array().cast("array<bigint>").alias("chars"),
        F.lit(b"").alias("upto"),
        F.lit(False).alias("goes_on"),
    )
    return rows.unionByName(turnless)


# --- one range's forest --------------------------------------------------------------------------


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their start."""
    if a == b:
        return len(a) // DIGEST
    n = min(len(a), len(b)) // DIGEST
    low = 0
    while low < n:  # the longest equal prefix, by halving
        mid = (low + n + 1) // 2
        if a[: mid * DIGEST] == b[: mid * DIGEST]:
            low = mid
        else:
            n = mid - 1
    return low


class Component:
    """Neighbouring rows united so far: the subtree of the node that they share at depth ``at``."""

    __slots__ = ("at", "children", "convs", "ends", "first", "hidden", "last", "leaves", "least", "saved")

    def __init__(self, row: int, conv: int, at: int, leaf: bool):
        self.first = self.last = row
        self.at, self.convs, self.least, self.leaves = at, 1, conv, int(leaf)
        self.children = self.saved = 0
        self.hidden = False  # stands for nodes of the slab below
        self.ends = [conv]  # ids of rows that end at ``at``, in order

    def grow(self, rows: list[Component], depth: int, owned: bool) -> None:
        """Become the node at ``depth`` above the components ``rows``, of which self is the first.

        A child counts in the range that it begins in; ``owned`` says whether the first child's is this.
        """
        below = [c for c in rows if c.at > depth]
        children = sum(c.children if c.hidden else c is not rows[0] or owned for c in below)
        self.children = children + sum(c.children for c in rows if c.at == depth)
        self.ends = [conv for c in rows if c.at == depth for conv in c.ends]
        self.convs, self.least = sum(c.convs for c in rows), min(c.least for c in rows)
        self.leaves = sum(c.leaves for c in below) if below else rows[-1].leaves
        self.saved = sum(c.saved for c in rows)
        self.at, self.last, self.hidden = depth, rows[-1].last, False


class Forest:
    """The trie nodes of one range of a slab, below the node that all rows share.

    ``rows`` are (seq, chars, lower, conv_id) in order; ``left`` and ``right`` are the numbers of turns
    that the first and last row share with their neighbours beyond the borders, -1 if there is none.
    A row that goes on in another slab has one turn more than ``chars``. It stands for all that lies
    below, of which ``lower`` is the number of children, of leaves and of saved tokens.

    ``nodes`` are (depth, first row, whether open, conv_id, n_convs, n_children, n_leaves, saved, ends).
    """

    def __init__(self, rows: list[tuple], left: int, right: int):
        self.rows, self.left, self.right = rows, left, right
        self.nodes: list[tuple] = []

    def owned(self, c: Component, depth: int) -> bool:
        """Whether the node at ``depth`` above ``c`` begins in this range."""
        return c.first > 0 or depth > self.left

    def build(self) -> Forest:
        rows, n = self.rows, len(self.rows)
        at = {}
        for i, (seq, _, _, conv) in enumerate(rows):
            # The last row is no leaf of this range where the next one equals it or goes on from it.
            at[i] = Component(i, conv, len(seq) // DIGEST, i < n - 1 or self.right < len(seq) // DIGEST)
        edges = [(common_turns(rows[i][0], rows[i + 1][0]), i) for i in range(n - 1)]
        edges.sort(key=lambda e: (-e[0], e[1]))
        root = list(range(n))  # union-find: components are runs of rows, known by their first

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for depth, same in groupby(edges, key=itemgetter(0)):
            runs: list[list[int]] = []
            for _, i in same:
                a, b = find(i), find(i + 1)
                if runs and runs[-1][-1] == a:
                    runs[-1].append(b)
                else:
                    runs.append([a, b])
            for run in runs:
                joined = [at.pop(i) for i in run]
                for c in joined:
                    self.climb(c, depth)
                joined[0].grow(joined, depth, self.owned(joined[0], depth + 1))
                for i in run[1:]:
                    root[i] = run[0]
                at[run[0]] = joined[0]
        (top,) = at.values()
        if top.at:
            self.climb(top, 0)
            top.grow([top], 0, self.owned(top, 1))
        self.note(top)
        return self

    def climb(self, c: Component, depth: int) -> None:
        """Note the component's node, and those above it with that child alone, as long as they lie below ``depth``."""
        while c.at > depth:
            self.note(c)
            if c.at == depth + 1:
                return
            c.grow([c], c.at - 1, self.owned(c, c.at))

    def note(self, c: Component) -> None:
        _, chars, lower, _ = self.rows[c.first]
        owned = self.owned(c, c.at)
        if c.at > len(chars):
            c.hidden, c.ends = True, []
            c.children, c.leaves, c.saved = lower if owned else (0, 0, 0)
            return
        if c.at:
            c.saved += (c.convs - owned) * chars[c.at - 1]
        open_ = not owned or (c.last == len(self.rows) - 1 and c.at <= self.right)
        self.nodes.append((c.at, c.first, open_, c.least, c.convs, c.children, c.leaves, c.saved, c.ends))


# --- ranges put together -------------------------------------------------------------------------

_FOUND = (
    "kind string, range int, piece int, depth long, name binary, parent binary, conv_id long, parent_conv_id long,"
    " n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
)
_FIGURES = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def _forests(table: pa.Table, base: int) -> Iterator[dict]:
    """What one range finds: final nodes, open nodes with pieces of their ends, totals below ``base``."""
    cells = table.sort_by([("side", "ascending"), ("above", "ascending"), ("seq", "ascending"), ("conv_id", "ascending")])
    rows = cells.to_pylist()
    edge = {row["side"]: row for row in rows if row["side"]}
    rows = [row for row in rows if not row["side"]]
    for above, same in groupby(rows, key=itemgetter("above")):
        group = list(same)

        def shared(side: int, row: dict) -> int:
            other = edge.get(side)
            if row is not rows[0 if side < 0 else -1] or other is None or other["above"] != row["above"]:
                return -1
            return common_turns(row["seq"], other["seq"])

        held = [
            (r["seq"], r["chars"], (r["children"], r["leaves"], r["saved"]) if r["goes_on"] else None, r["conv_id"])
            for r in group
        ]
        forest = Forest(held, shared(-1, group[0]), shared(1, group[-1])).build()

        def name(depth: int, first: int) -> bytes:
            return hashlib.blake2b(above + held[first][0][: depth * DIGEST], digest_size=16).digest()  # noqa: B023

        path: dict[int, tuple] = {}  # nodes from the top to the one at hand
        for node in sorted(forest.nodes, key=lambda n: (n[1], n[0])):
            depth, first, open_, least, convs, children, leaves, saved, ends = node
            path[depth] = node
            up = path.get(depth - 1)
            out = dict.fromkeys(("range", "piece", "name", "parent", "parent_conv_id", "ends"))
            out |= {"kind": "node", "range": group[0]["range"], "depth": base + depth, "conv_id": least}
            out |= dict(zip(_FIGURES, (convs, children, leaves, saved), strict=True))
            if base and depth == 0:  # the last node of the slab above, which sees to it
                yield out | {"kind": "total", "name": above}
                continue
            if base and depth == 1:
                out["parent"] = above
            elif up is not None:
                out |= {"parent": name(depth - 1, first)} if up[2] else {"parent_conv_id": up[3]}
            if open_:
                out["name"] = name(depth, first)
                yield out | {"kind": "open"}
                for i in range(0, len(ends), IDS_PER_PIECE):
                    text = ",".join(map(str, ends[i : i + IDS_PER_PIECE]))
                    yield out | {"kind": "piece", "piece": i // IDS_PER_PIECE, "ends": text}
            else:
                yield out | {"ends": hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()}


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order; only the hasher is kept between batches."""
    names = ["depth", "name", "ends"]
    at, hasher = None, None
    for batch in batches:
        done = []
        for depth, name, text in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if (depth, name) != at:
                if at is not None:
                    done.append((*at, hasher.hexdigest()))
                at, hasher = (depth, name), hashlib.sha256()
            else:
                hasher.update(b",")
            hasher.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], names=names)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, hasher.hexdigest())], names=names)


def _ranges(rows: DataFrame) -> DataFrame:
    """The rows in sorted ranges (``side`` 0), each with its neighbours' nearest rows (-1 and 1)."""
    order = [F.col("above"), F.col("seq"), F.col("conv_id")]
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("chars")), F.lit(0)).alias("turns")).first()
    n = max(1, -(-sizes["n"] // ROWS_PER_RANGE), -(-sizes["turns"] // TURNS_PER_RANGE))
    cut = rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()).withColumn("side", F.lit(0))
    # Written with their numbers, so that a lost task cannot move a row to another range.
    cut = written(cut, "trie-ranges")
    row = F.struct("above", "seq", "conv_id")
    ends = cut.groupBy("range").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    along = Window.orderBy("range")  # a row a range
    near = ends.select("range", F.lag("high").over(along).alias("before"), F.lead("low").over(along).alias("after"))
    sides = [F.struct(F.lit(side).alias("side"), F.col(name).alias("row")) for side, name in ((-1, "before"), (1, "after"))]
    edges = near.select("range", F.explode(F.array(*sides)).alias("e")).where("e.row is not null")
    edges = edges.select("range", "e.side", "e.row.above", "e.row.seq", "e.row.conv_id")
    return cut.unionByName(edges, allowMissingColumns=True)


def _slab_nodes(rows: DataFrame, base: int, hung: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one slab, and the figures of the nodes ``hung`` (name, conv_id) that it hangs from."""

    def forests(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(_forests(table, base)), schema=schema)

    schema = pa.schema(
        [(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in map(str.split, _FOUND.split(", "))]
    )
    found = written(_ranges(rows).groupBy("range").applyInArrow(forests, _FOUND), "trie-found")
    partial = found.where("kind = 'open'").groupBy("depth", "name").agg(
        F.first("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(n).alias(n) for n in _FIGURES],
    )
    open_ = written(partial, "trie-open")
    pieces = found.where("kind = 'piece'").select("depth", "name", "range", "piece", "ends")
    pieces = pieces.repartition("depth", "name").sortWithinPartitions("depth", "name", "range", "piece")
    hashes = pieces.mapInArrow(_hash_pieces, "depth long, name binary, ends string")
    up = open_.select("depth", "name", "conv_id").unionByName(hung.withColumn("depth", F.lit(base).cast("long")))
    up = up.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("up"))
    empty = hashlib.sha256().hexdigest()
    merged = open_.join(hashes, ["depth", "name"], "left")
    merged = merged.join(up, ["depth", "parent"], "left").select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), *_FIGURES, F.coalesce("ends", F.lit(empty)).alias("ends_sha256")
    )
    final = found.where("kind = 'node'").join(broadcast_if_small(up)[0], ["depth", "parent"], "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), *_FIGURES, F.col("ends").alias("ends_sha256")
    )
    totals = found.where("kind = 'total'").groupBy(F.col("name").alias("upto")).agg(
        F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    return final.unionByName(merged), totals


def trie(conversations: DataFrame, slab: int = SLAB) -> DataFrame:
    """Every node of the trie of rebuilt conversations, in the columns of the operator's contract."""
    start(conversations.sparkSession)
    convs, turns = rebuilt(written(numbered(conversations), "numbered"))
    rows = written(slabs(convs, turns, slab), "slabs")
    deepest = rows.agg(F.max("slab")).first()[0]
    lower, out = None, None
    for s in range(-1 if deepest is None else deepest, -1, -1):
        # A slab of a few thousand turns a pass: one, unless a conversation is longer.
        here = rows.where(F.col("slab") == s)
        if lower is None:
            here = here.select("*", *[F.lit(0).cast("long").alias(n) for n in ("children", "leaves", "saved")])
        else:
            here = here.join(lower, "upto", "left")
        full = rows.where((F.col("slab") == s - 1) & (F.size("chars") == slab))
        hung = full.groupBy(F.col("upto").alias("name")).agg(F.min("conv_id").alias("conv_id"))
        nodes, lower = _slab_nodes(here.drop("upto", "slab"), s * slab, hung)
        out = nodes if out is None else nodes.unionByName(out)
    if out is None:
        kinds = [("conv_id", "long"), ("depth", "long"), ("parent_conv_id", "long"), *((n, "long") for n in _FIGURES)]
        out = conversations.sparkSession.createDataFrame([], ", ".join(f"{n} {k}" for n, k in [*kinds, ("ends_sha256", "string")]))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE = """
    WITH turns AS (
        SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS turn,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
        FROM conversations WHERE conv_id IS NOT NULL
    ), own AS (
        SELECT conv_id, list(turn ORDER BY i) AS turns FROM turns GROUP BY conv_id
    ), bytes AS (
        SELECT conv_id, turns, unnest(string_split(CAST(conv_id AS VARCHAR), '')) AS c,
               generate_subscripts(string_split(CAST(conv_id AS VARCHAR), ''), 1) AS i
        FROM own
    ), digits AS (
        SELECT conv_id, list(ascii(c) ORDER BY i) AS codes FROM bytes GROUP BY conv_id
    ), heads AS (
        -- CRC-32, bit by bit
        SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, codes::BIGINT[]), lambda crc, b:
            list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k:
                CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 6 AS h
        FROM digits
    ), seqs AS (
        SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], o.turns[h.h + 1:]) AS s
        FROM own o JOIN heads h USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
    ), prefixes AS (
        SELECT conv_id, s, d, s[1:d] AS p, len(s) = d AS ends FROM seqs, LATERAL (SELECT unnest(range(0, len(s) + 1)) AS d)
    ), nodes AS (
        SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, any_value(s) AS s,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS e,
               CASE WHEN d > 0 THEN (count(*) - 1) * length(p[d].t) ELSE 0 END AS saved
        FROM prefixes GROUP BY d, p
    ), kids AS (
        SELECT x.d, x.p, x.conv_id, x.n, x.e, x.saved, u.conv_id AS up,
               (SELECT count(*) FROM nodes c WHERE c.d = x.d + 1 AND c.p[1:x.d] = x.p) AS children
        FROM nodes x LEFT JOIN nodes u ON u.d = x.d - 1 AND u.p = x.p[1:x.d - 1]
    ), below AS (
        SELECT k.p[1:a] AS p, a AS d, sum(k.saved) AS saved, count(*) FILTER (k.children = 0) AS leaves
        FROM kids k, LATERAL (SELECT unnest(range(0, k.d + 1)) AS a) GROUP BY 1, 2
    )
    SELECT k.conv_id, k.d AS depth, k.up AS parent_conv_id, k.n AS n_convs, k.children AS n_children,
           b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, k.e AS ends_sha256
    FROM kids k JOIN below b USING (d, p)"""
