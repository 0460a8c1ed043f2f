"""Prefix trie of conversations, from padded matrices of turn ids.

A turn is 128 bits of hash over its place, role and text. Conversations are cut into segments of WIDTH turns; a
segment is a row of turn ids, headed by the hash of all turns before it, so that rows meet only where all that
precedes is equal. Rows are put into ranges of their order (heads, turn ids, then conversation ids, which split
large groups of copies) and each range is a shard: a padded matrix that is sorted with ``numpy.lexsort``. Where a
row differs from the one above it is marked by column, and the marks are OR-accumulated from left to right: what
is marked in column d starts a node of depth d, and ``reduceat`` over the starts gives the figures of all nodes of
a depth.

Only nodes on the paths of a shard's first and last row may go on in other shards. They leave a shard as pieces
and are added up by their hashes. Shards count nodes as if no other shard held them; one summary a shard, its
first and last row, tells which nodes of the first row had begun before and whether a sequence goes on behind the
last row, and these corrections are added to the pieces. A node between two segments is put together in the same
way. A segment hands what lies below it (leaves and bytes) to the row of its smallest conversation in the segment
before, where subtrees are summed.

Texts are read once; what is shuffled has a few bytes a turn. A conversation of any length is split over tasks,
as is a group of copies. Only the ids that ``ends_sha256`` covers are read by one task a node, in order and a
shard's at a time, as a digest has no parts.

Defined results: rows without a conversation id belong to none; turns of equal number (nulls are first) are in
order of the MD5 of role and text; repeated rows are turns of their own; a null role or text is empty; further
columns are left out; no rows give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparloom.llm.common import materialize

#: Turns of a segment.
WIDTH = 16
#: Turns, and segments, of one shard, about.
TURNS, SEGMENTS = 500_000, 50_000
NODE = "kind int, shard int, top boolean, depth bigint, h1 bigint, h2 bigint, q1 bigint, q2 bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, path1 array<bigint>, path2 array<bigint>, bytes array<bigint>, more boolean"
#: Kinds of rows that a shard gives: whole nodes, pieces of nodes, its first row, its last row.
WHOLE, PIECE, FIRST, LAST = range(4)
NO_ENDS = hashlib.sha256(b"").hexdigest()
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _shards(df: DataFrame, rows: int, each: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, rows // each + 1)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the shard and each row's place in its conversation within the shard; rows come in order."""
    shard, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        sizes = np.diff(np.r_[starts, len(conv)])
        place = np.arange(len(conv)) - np.repeat(starts, sizes)
        if conv[0] == last:
            place[: sizes[0]] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), shard), pa.int32()), pa.array(place, pa.int64())], names=[*batch.schema.names, "shard", "place"])


def placed(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, p, id, bytes): every turn's place in its conversation from 0, the MD5 of its role and text, and
    the UTF-8 bytes of its text. Rows are numbered in ranges, so no conversation has to fit one task."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    told = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    own = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), told.alias("id"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")).filter("conv_id is not null")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id"), F.col("row")]
    ranged = own.repartitionByRange(_shards(own, conversations.count(), TURNS), *order).sortWithinPartitions(*order)
    local = materialize(ranged.select("conv_id", "id", "bytes").mapInArrow(_numbered, "conv_id bigint, id binary, bytes bigint, shard int, place bigint"), "trie-turns")
    ends = local.groupBy("shard").agg(F.min("conv_id").alias("low"), F.max(F.struct("conv_id", "place")).alias("top")).orderBy("shard").collect()  # one row a shard
    offsets, last, total = [], None, 0
    for r in ends:
        before = total if r.low == last else 0
        if before:
            offsets.append((r.shard, r.low, before))
        total = r.top.place + 1 + (before if r.low == r.top.conv_id else 0)
        last = r.top.conv_id
    before = local.sparkSession.createDataFrame(offsets, "shard int, conv_id bigint, before bigint")
    return local.join(F.broadcast(before), ["shard", "conv_id"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("p"), "id", "bytes")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversations that share beginnings, from the rows of ``placed``: conversation c begins with the first h
    turns of c - c % ``group`` (all if there are fewer, none if there is no such conversation), then come its own
    after its first h, for h = crc32(decimal c) % ``most``. A conversation without turns has one row with p null."""
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    convs = materialize(convs, "trie-convs")
    given = convs.filter(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("base_n"))
    known = materialize(convs.join(given, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "trie-known")
    heads = turns.filter((F.col("conv_id") == base) & (F.col("p") < most - 1)).withColumnRenamed("conv_id", "base")
    first = heads.join(known.select("base", "conv_id", "h"), "base").filter("p < h").select("conv_id", "p", "id", "bytes")
    rest = turns.join(known.select("conv_id", "h", "taken"), "conv_id").filter("p >= h").select("conv_id", (F.col("p") - F.col("h") + F.col("taken")).alias("p"), "id", "bytes")
    bare = known.filter("n <= h and taken = 0").select("conv_id", F.lit(None).cast("long").alias("p"), F.lit(None).cast("binary").alias("id"), F.lit(None).cast("long").alias("bytes"))
    return first.unionAll(rest).unionAll(bare)


def _segments(turns: DataFrame) -> DataFrame:
    """(conv_id, k, p1, p2, more, z, bytes): the k-th WIDTH turns of a conversation, the hash of all turns before
    them, whether others follow, their ids (two numbers each) and bytes."""
    digest = lambda seed: F.xxhash64(F.lit(seed), "p", "id")
    cell = F.when(F.col("p").isNotNull(), F.struct("p", digest(1).alias("z1"), digest(2).alias("z2"), "bytes"))
    cut = turns.groupBy("conv_id", F.coalesce(F.floor(F.col("p") / WIDTH), F.lit(0)).cast("long").alias("k")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    xor = lambda c: F.aggregate("cells", F.lit(0).cast("long"), lambda all_, x: all_.bitwiseXOR(x[c]))
    rows = cut.select("conv_id", "k", F.flatten(F.transform("cells", lambda x: F.array(x["z1"], x["z2"]))).alias("z"), F.transform("cells", lambda x: x["bytes"]).alias("bytes"), xor("z1").alias("x1"), xor("z2").alias("x2"))
    rows = materialize(rows, "trie-cut")
    one = (F.col("k") == 0) & (F.size("bytes") < WIDTH)
    by = Window.partitionBy("conv_id").orderBy("k")
    before = lambda c: F.coalesce(F.bit_xor(c).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(c.replace("x", "p"))
    several = rows.filter(~one).select("conv_id", "k", before("x1"), before("x2"), F.lead("k").over(by).isNotNull().alias("more"), "z", "bytes")
    zero = F.lit(0).cast("long")
    return rows.filter(one).select("conv_id", "k", zero.alias("p1"), zero.alias("p2"), F.lit(False).alias("more"), "z", "bytes").unionAll(several)


def _matrix(values: np.ndarray, valid: np.ndarray, empty: int) -> np.ndarray:
    cells = np.full(valid.shape, empty, np.int64)
    cells[valid] = values
    return cells


def shard_nodes(shard: int, rows: dict[str, np.ndarray], z: np.ndarray, given: np.ndarray) -> Iterator[dict[str, object]]:
    """Columns of NODE for the nodes of a shard's segments: all of one depth at a time, at last its first and last
    row. ``rows``: conv_id, k, p1, p2, more, size, below_leaves, below_saved; z and given: the cells' ids and bytes."""
    n, width = len(rows["conv_id"]), int(rows["size"].max())
    valid = np.arange(width) < rows["size"][:, None]
    z1, z2, size_of = _matrix(z[0::2], valid, np.iinfo(np.int64).min), _matrix(z[1::2], valid, np.iinfo(np.int64).min), _matrix(given, valid, 0)
    columns = [key for j in range(width - 1, -1, -1) for key in (z2[:, j], z1[:, j])]
    order = np.lexsort((rows["conv_id"], rows["more"], *columns, rows["p2"], rows["p1"], rows["k"]))
    conv, k, p1, p2, more, size, below_leaves, below_saved = (rows[c][order] for c in ("conv_id", "k", "p1", "p2", "more", "size", "below_leaves", "below_saved"))
    valid, z1, z2, size_of = valid[order], z1[order], z2[order], size_of[order]
    differ = np.ones((n, width + 1), bool)
    differ[1:, 0] = (k[1:] != k[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
    differ[1:, 1:] = (z1[1:] != z1[:-1]) | (z2[1:] != z2[:-1]) | (valid[1:] != valid[:-1])
    starts = np.logical_or.accumulate(differ, axis=1)
    reached = np.arange(width + 1) <= size[:, None]
    fresh = starts & reached
    paths = [np.bitwise_xor.accumulate(np.c_[p, np.where(valid, c, 0)], axis=1) for p, c in ((p1, z1), (p2, z2))]
    ended = ~more
    leaf = ended.copy()
    leaf[:-1] &= starts[np.arange(1, n), size[:-1]]
    leaves = leaf + below_leaves
    repeated = np.where(fresh[:, 1:], 0, size_of)
    saved = np.cumsum(repeated[:, ::-1], axis=1)[:, ::-1] if width else repeated
    saved = np.c_[saved[:, 0] if width else np.zeros(n, np.int64), saved] + below_saved[:, None]
    up = None
    for d in range(width + 1):
        at = np.flatnonzero(starts[:, d])
        of = np.arange(len(at))
        keep = reached[at, d]
        count = np.diff(np.r_[at, n])
        smallest = np.minimum.reduceat(conv, at)
        children = np.add.reduceat(fresh[:, d + 1].astype(np.int64), at) if d < width else np.zeros(len(at), np.int64)
        piece = (of == 0) | (of == len(at) - 1) | (d == 0)
        if d == WIDTH:
            piece |= np.logical_or.reduceat(more, at)
        top = (d == 0) & (k[at] > 0)
        closing = (size == d) & ended
        n_ends = np.add.reduceat(closing.astype(np.int64), at)
        if up is None:
            parent = open_parent = np.zeros(len(at), np.int64)
        else:
            parent = np.searchsorted(up[0], at, side="right") - 1
            open_parent = up[2][parent]
        told = np.flatnonzero(keep)
        ends: list[str | None] = []
        for i in told:
            ids = ",".join(map(str, conv[at[i] : at[i] + n_ends[i]].tolist())) if n_ends[i] else ""
            ends.append((ids or None) if piece[i] else hashlib.sha256(ids.encode()).hexdigest() if ids else NO_ENDS)
        here = at[told]
        none = np.zeros(len(told), bool)
        yield {
            "kind": np.where(piece[told], PIECE, WHOLE), "shard": np.full(len(told), shard), "top": top[told], "depth": k[here] * WIDTH + d,
            "h1": paths[0][here, d], "h2": paths[1][here, d], "q1": (paths[0][here, d - 1], none | (d == 0)), "q2": (paths[1][here, d - 1], none | (d == 0)),
            "conv_id": smallest[told], "parent_conv_id": (up[1][parent[told]] if up is not None else np.zeros(len(told), np.int64), none | (d == 0) | (open_parent[told] != 0)),
            "n_convs": count[told], "n_children": children[told], "n_leaves": np.add.reduceat(leaves, at)[told], "saved_tokens": np.add.reduceat(saved[:, d], at)[told], "ends": ends,
        }
        up = (at, smallest, piece)
    for kind, i in ((FIRST, 0), (LAST, n - 1)):
        s = int(size[i])
        yield {"kind": np.full(1, kind), "shard": np.full(1, shard), "depth": k[i : i + 1] * WIDTH, "path1": [paths[0][i, : s + 1].tolist()], "path2": [paths[1][i, : s + 1].tolist()], "bytes": [size_of[i, :s].tolist()], "more": [bool(more[i])]}


def _column(name: str, kind: pa.DataType, found: dict[str, object], n: int) -> pa.Array:
    value = found.get(name)
    if value is None:
        return pa.nulls(n, kind)
    if isinstance(value, tuple):
        return pa.array(value[0], kind, mask=value[1])
    return pa.array(value, kind)


def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in NODE.split(", "))])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, parts = _schema(), [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    whole = lambda c: table.column(c).chunk(0) if table.column(c).num_chunks else pa.array([], table.schema.field(c).type)
    rows = {c: whole(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "k", "p1", "p2", "more", "below_leaves", "below_saved")}
    z, given = whole("z"), whole("bytes")
    rows["size"] = np.diff(given.offsets.to_numpy())
    for found in shard_nodes(TaskContext.get().partitionId(), rows, z.flatten().to_numpy(zero_copy_only=False), given.flatten().to_numpy(zero_copy_only=False)):
        yield pa.RecordBatch.from_arrays([_column(f.name, f.type, found, len(found["kind"])) for f in schema], schema=schema)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the shards' pieces have to be changed by, from their first and last rows in order."""
    schema, last = _schema(), None
    for batch in batches:
        out: dict[str, list[object]] = {c: [] for c in ("kind", "top", "depth", "h1", "h2", "n_convs", "n_children", "n_leaves", "saved_tokens")}

        def add(row: dict[str, object], d: int, children: int, leaves: int, saved: int, out: dict[str, list[object]] = out) -> None:
            told = (PIECE, d == 0 and row["depth"] > 0, row["depth"] + d, row["path1"][d], row["path2"][d], 0, children, leaves, saved)
            for c, v in zip(out, told, strict=True):
                out[c].append(v)

        for row in batch.to_pylist():
            if row["kind"] == LAST:
                last = row
                continue
            if last is None or last["depth"] != row["depth"]:
                continue
            common = -1  # the depth to which the rows are equal
            for a, b in zip(zip(last["path1"], last["path2"], strict=True), zip(row["path1"], row["path2"], strict=True), strict=False):
                if a != b:
                    break
                common += 1
            for d in range(common + 1):
                add(row, d, -1 if d < common else 0, 0, sum(row["bytes"][max(d - 1, 0) : common]))
            if not last["more"] and common == len(last["path1"]) - 1:
                for d in range(common + 1):
                    add(last, d, 0, -1, 0)
        yield pa.RecordBatch.from_arrays([_column(f.name, f.type, out, len(out["kind"])) for f in schema], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, h1, h2, ends_sha256) from rows in order of node and shard; one node's digest is kept at a time."""
    node, digest = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in node], pa.array([digest.hexdigest()])], names=["depth", "h1", "h2", "ends_sha256"])

    for batch in batches:
        for *key, ends in zip(*[batch.column(c).to_pylist() for c in ("depth", "h1", "h2", "ends")], strict=True):
            if key != node:
                if node is not None:
                    yield told()
                node, digest = key, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
    if node is not None:
        yield told()


def _pieces(segments: DataFrame, rows: int, label: str) -> tuple[DataFrame, DataFrame]:
    """The rows of all shards, and the pieces of nodes with their corrections."""
    keys = ["k", "p1", "p2", "z", "more", "conv_id"]
    ranged = segments.repartitionByRange(_shards(segments, rows, SEGMENTS), *keys)
    found = materialize(ranged.mapInArrow(_shard, NODE), label)
    summaries = found.filter(F.col("kind").isin(FIRST, LAST)).coalesce(1).sortWithinPartitions("shard", "kind")  # two rows a shard
    return found, found.filter(F.col("kind") == PIECE).unionAll(summaries.mapInArrow(_corrections, NODE))


def _below(segments: DataFrame) -> DataFrame:
    """(conv_id, k, below_leaves, below_saved): what a row answers for in segments after its own, as the smallest
    conversation in them."""
    later = segments.filter("k > 0")
    _, pieces = _pieces(later.withColumns({"below_leaves": F.lit(0).cast("long"), "below_saved": F.lit(0).cast("long")}), later.count(), "trie-later")
    totals = pieces.filter("top").groupBy(F.col("depth"), "h1", "h2").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.min("conv_id").alias("conv_id"))
    answered = totals.select("conv_id", (F.col("depth") / WIDTH).cast("long").alias("k"), "leaves", "saved")
    after = Window.partitionBy("conv_id").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = segments.filter("k > 0 or more").select("conv_id", "k").join(answered, ["conv_id", "k"], "left")
    told = all_rows.select("conv_id", "k", F.coalesce(F.sum("leaves").over(after), F.lit(0)).alias("below_leaves"), F.coalesce(F.sum("saved").over(after), F.lit(0)).alias("below_saved"))
    return materialize(told.filter("below_leaves <> 0 or below_saved <> 0"), "trie-below")


def trie(turns: DataFrame) -> DataFrame:
    """RESULT for every node of the trie of the rows of ``placed``, or of (conv_id, null, null, null) for a
    conversation without turns. conv_id is a node's smallest member; subtrees include their top."""
    segments = materialize(_segments(turns), "trie-segments")
    zero = F.lit(0).cast("long")
    if segments.filter("k > 0").limit(1).count():
        rows = segments.join(_below(segments), ["conv_id", "k"], "left").withColumns({c: F.coalesce(c, zero) for c in ("below_leaves", "below_saved")})
    else:
        rows = segments.withColumns({"below_leaves": zero, "below_saved": zero})
    found, pieces = _pieces(rows, segments.count(), "trie-nodes")
    node = ["depth", "h1", "h2"]
    own = lambda c: F.when(~F.col("top"), F.col(c))
    total = lambda c: F.coalesce(F.sum(own(c)), zero).alias(c)
    put = pieces.groupBy(*node).agg(F.first("q1", True).alias("q1"), F.first("q2", True).alias("q2"), F.min(own("conv_id")).alias("conv_id"), F.min("parent_conv_id").alias("in_shard"), total("n_convs"), F.sum("n_children").alias("n_children"), total("n_leaves"), total("saved_tokens"))
    chunks = found.filter((F.col("kind") == PIECE) & F.col("ends").isNotNull()).select(*node, "shard", "ends")
    ends = chunks.repartition(*node).sortWithinPartitions(*node, "shard").select(*node, "ends").mapInArrow(_digests, "depth bigint, h1 bigint, h2 bigint, ends_sha256 string")
    open_nodes = materialize(put.join(ends, node, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "trie-open")
    names = open_nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    between = open_nodes.join(names, ["depth", "q1", "q2"], "left").withColumn("parent_conv_id", F.coalesce("in_shard", "parent_conv_id"))
    whole = found.filter(F.col("kind") == WHOLE).withColumnRenamed("ends", "ends_sha256")
    # a shard's open parents are few: joined by shard as well, no parent of very many children is one key
    by_shard = found.filter(F.col("kind") == PIECE).select("shard", *node).distinct().join(open_nodes.select(*node, F.col("conv_id").alias("named")), node).select("shard", (F.col("depth") + 1).alias("depth"), F.col("h1").alias("q1"), F.col("h2").alias("q2"), "named")
    named = whole.filter("parent_conv_id is null").join(by_shard, ["shard", "depth", "q1", "q2"], "left").withColumn("parent_conv_id", F.col("named"))
    return between.select(*RESULT).unionAll(whole.filter("parent_conv_id is not null").select(*RESULT)).unionAll(named.select(*RESULT))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of conversations as they are."""
    return trie(placed(conversations, conv_col, turn_col, role_col, text_col))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(placed(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def _sql() -> str:
    crc = "list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1))))"
    return f"""
WITH told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, md5(length(role) || ':' || role || text) AS id, strlen(text) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS p FROM told),
convs AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, conv_id::VARCHAR AS s FROM placed GROUP BY conv_id),
hashed AS (SELECT conv_id, n, base, xor({crc}, 4294967295) % 9 AS h FROM convs),
known AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken FROM hashed c LEFT JOIN hashed b ON b.conv_id = c.base),
rebuilt AS (
    SELECT k.conv_id, p.p, p.id, p.bytes FROM known k JOIN placed p ON p.conv_id = k.base AND p.p < k.h
    UNION ALL SELECT k.conv_id, p.p - k.h + k.taken, p.id, p.bytes FROM known k JOIN placed p ON p.conv_id = k.conv_id AND p.p >= k.h),
whole AS (SELECT k.conv_id, coalesce(list(r.id ORDER BY r.p) FILTER (r.p IS NOT NULL), []) AS ids, coalesce(list(r.bytes ORDER BY r.p) FILTER (r.p IS NOT NULL), []) AS sizes
    FROM known k LEFT JOIN rebuilt r ON r.conv_id = k.conv_id GROUP BY k.conv_id),
steps AS (SELECT conv_id, d, array_to_string(ids[1:d], ',') AS path, array_to_string(ids[1:d - 1], ',') AS up, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes, len(ids) = d AS ended
    FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM whole)),
nodes AS (SELECT d, path, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM steps GROUP BY d, path),
kids AS (SELECT d - 1 AS d, up AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY d, up),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.path = n.path),
sums AS (SELECT a.d, a.path, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
    FROM full_nodes f JOIN steps a ON a.conv_id = f.conv_id AND a.d <= f.d GROUP BY a.d, a.path)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.d = f.d AND s.path = f.path LEFT JOIN full_nodes u ON f.d > 0 AND u.d = f.d - 1 AND u.path = f.up"""


OP11_SQL = _sql()
