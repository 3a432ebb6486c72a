"""Operator 13: the trie of conversation prefixes, by a skeleton of splitter paths.

A conversation's path is the sequence of hashes of its turns; in the order of (path, conv_id) a trie's nodes are runs of rows. Quantiles of a sample of these
pairs split the order into shards. Only prefixes of a splitter's path can have rows in more than one shard: the trie of these, the skeleton, is broadcast. Each
shard is sorted and walked once with a stack: nodes outside the skeleton are finished there; for nodes of the skeleton a shard gives partial aggregates, which are
summed by node (a reduction), then from the bottom of the skeleton to its root. Equal conversations are split by conv_id, so a conversation that a third
of all have is as even as any other.

Bounds: texts are hashed before they move; a turn is a hash and a count from then on, and one conversation's turns (some 60 bytes each) meet in a task. The sample has
SAMPLE rows a shard at most on average, the skeleton as many nodes as the splitters have turns, whatever the table; both pass through the driver. A node's open children wait for it in memory, never more
than a shard. The list of a node's own members is hashed from pieces in order, a stream through one task, as a hash of one text is by its definition.

Defined results: a null role or text is empty; turns come null first, then ascending, equal ones by the hash of what they say; repeated rows are turns; rows without a conv_id are no
conversation and are left out; conversations may be left without a turn (members of the root alone); no rows give no rows, not even a root; further columns are
not read, whatever their names. ``c % 20`` has the sign of c.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, table

KEY = 32  # hex digits of a turn's hash
SAMPLE = 64
WORD = r"[^\x20\x09-\x0D]+"
PIECE_IDS = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NAMES = [c.split()[0] for c in NODE.split(", ")]

#: A shard's output: finished nodes (above: the skeleton node over them, if that is their parent), sums for a skeleton node (at), or a piece of its own members.
_LOCAL = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), *[(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "words")], ("ends", pa.string()), ("above", pa.int64()), ("at", pa.int64()), ("shard", pa.int64()), ("piece", pa.int64())])
LOCAL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string, above long, at long, shard long, piece long"


def turns_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns: each conversation's turns in order, as (turn, key, words)."""
    role_, text_ = (F.coalesce(rows[c].cast("string"), F.lit("")) for c in (role, text))
    thin = rows.select(rows[conv_id].cast("long").alias("conv_id"), rows[turn].cast("long").alias("turn"), F.md5(F.concat(F.md5(role_), text_)).alias("key"), F.regexp_count(text_, F.lit(WORD)).alias("words"))
    return thin.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "words"))).alias("turns"))


def shared_heads(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The contract's rebuilt conversations: the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % most."""
    heads = convs.where(f"conv_id % {every} = 0").select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    both = convs.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("head_id"), "left")
    head = F.when(h > 0, F.slice(F.coalesce("head", F.array().cast(convs.schema["turns"].dataType)), F.lit(1), h)).otherwise(F.array().cast(convs.schema["turns"].dataType))
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


class Skeleton:
    """The trie of the splitters' paths: a number for each node, its parent and depth."""

    def __init__(self, splitters: list[tuple[str, int]]):
        self.splitters = splitters
        self.number: dict[str, int] = {"": 0}
        self.parent, self.depth = [-1], [0]
        for path, _ in splitters:
            for end in range(KEY, len(path) + 1, KEY):
                if path[:end] not in self.number:
                    self.number[path[:end]] = len(self.parent)
                    self.parent.append(self.number[path[: end - KEY]])
                    self.depth.append(end // KEY)

    def shard(self, path: str, conv_id: int) -> int:
        return bisect.bisect_right(self.splitters, (path, conv_id))


class _Node:
    __slots__ = ("at", "conv", "convs", "done", "ends", "leaves", "saved", "words", "children", "ids", "piece")

    def __init__(self, words: int, at: int | None):
        self.words, self.at = words, at
        self.conv, self.convs, self.children, self.leaves, self.saved, self.piece = None, 0, 0, 0, 0, 0
        self.ends, self.ids, self.done = hashlib.sha256() if at is None else None, [], []


class Walk:
    """One shard in order: the open nodes of the last path. ``out`` gets rows of LOCAL."""

    def __init__(self, shard: int, skeleton: Skeleton):
        self.shard, self.skeleton, self.out = shard, skeleton, []
        self.path, self.stack = "", [_Node(0, 0)]

    def _put(self, **values) -> None:
        self.out.append(values)

    def _flush(self, n: _Node) -> None:
        """A piece of a skeleton node's own members."""
        if n.ids:
            self._put(at=n.at, shard=self.shard, piece=n.piece, ends=",".join(map(str, n.ids)))
            n.ids, n.piece = [], n.piece + 1

    def _end(self, n: _Node, i: int) -> None:
        """A conversation ends in a node."""
        n.convs += 1
        n.conv = i if n.conv is None else min(n.conv, i)
        if n.at is None:
            n.ends.update((f",{i}" if n.piece else str(i)).encode())
            n.piece = 1
        else:
            n.ids.append(i)
            if len(n.ids) >= PIECE_IDS:
                self._flush(n)

    def _close(self) -> None:
        """Finish the deepest open node and add it to its parent."""
        n, depth = self.stack.pop(), len(self.stack)
        up = self.stack[-1] if self.stack else None
        if up:
            up.convs += n.convs
            up.conv = n.conv if up.conv is None else min(up.conv, n.conv)
        if n.at is not None:
            self._flush(n)
            self._put(at=n.at, shard=self.shard, conv_id=n.conv, n_convs=n.convs, n_children=n.children, n_leaves=n.leaves, saved_tokens=n.saved, words=n.words)
            return
        n.leaves += not n.children
        n.saved += (n.convs - 1) * n.words
        for child in n.done:
            self._put(**child, parent_conv_id=n.conv)
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + n.leaves, up.saved + n.saved
        up.done.append({"conv_id": n.conv, "depth": depth, "n_convs": n.convs, "n_children": n.children, "n_leaves": n.leaves, "saved_tokens": n.saved, "ends": n.ends.hexdigest()})
        if up.at is not None:  # its parent is known by number: nothing to wait for
            self._put(**up.done.pop(), above=up.at)

    def add(self, path: str, conv_id: int, words: list[int]) -> None:
        same = 0
        while same < len(self.stack) - 1 and self.path[same * KEY : (same + 1) * KEY] == path[same * KEY : (same + 1) * KEY]:
            same += 1
        while len(self.stack) > same + 1:
            self._close()
        for d in range(same, len(words)):
            self.stack.append(_Node(words[d], self.skeleton.number.get(path[: (d + 1) * KEY]) if self.stack[-1].at is not None else None))
        self.path = path
        self._end(self.stack[-1], conv_id)

    def finish(self) -> None:
        while self.stack:
            self._close()


def _walked(skeleton) -> object:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for shard, path, conv_id, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or shard != now.shard:
                    if now is not None:
                        now.finish()
                        yield pa.RecordBatch.from_pylist(now.out, _LOCAL)
                    now = Walk(shard, skeleton.value)
                now.add(path, conv_id, words)
                if len(now.out) > 5000:
                    yield pa.RecordBatch.from_pylist(now.out, _LOCAL)
                    now.out = []
        if now is not None:
            now.finish()
        yield pa.RecordBatch.from_pylist(now.out if now else [], _LOCAL)

    return walk


def splitters_of(paths: DataFrame, shards: int) -> list[tuple[str, int]]:
    """About shards - 1 quantiles of (path, conv_id), from a sample of some SAMPLE rows a shard by a hash of the id."""
    rows = paths.count()
    share = min(1.0, SAMPLE * shards / max(1, rows))
    seen = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 48)) < int(share * (1 << 48))).select("path", "conv_id").collect()
    seen = sorted((r["path"], r["conv_id"]) for r in seen)
    return sorted({seen[len(seen) * k // shards] for k in range(1, shards)}) if seen else []


def _skeleton_nodes(local: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Sums of the partial aggregates by node (the reduction), then up the skeleton: (at, NODE without the digest). Rows: nodes of the skeleton."""
    sums = local.where("at IS NOT NULL AND piece IS NULL").groupBy("at").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("words").alias("words"))
    found = {r["at"]: r.asDict() for r in sums.collect()}
    for at in sorted(found, key=lambda k: -skeleton.depth[k]):  # children before parents
        n = found[at]
        n["n_leaves"] += not n["n_children"]
        n["saved_tokens"] += (n["n_convs"] - 1) * n["words"]
        if (up := found.get(skeleton.parent[at])) is not None:
            for k, v in (("n_children", 1), ("n_leaves", n["n_leaves"]), ("saved_tokens", n["saved_tokens"])):
                up[k] += v
    rows = [(at, n["conv_id"], skeleton.depth[at], found[skeleton.parent[at]]["conv_id"] if at else None, *(n[k] for k in ("n_convs", "n_children", "n_leaves", "saved_tokens"))) for at, n in sorted(found.items())]
    return local.sparkSession.createDataFrame(rows, "at long, " + NODE.rpartition(", ")[0])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of their node to the node's digest."""
    schema = pa.schema([("at", pa.int64()), ("ends_sha256", pa.string())])
    now, digest = None, None
    for batch in batches:
        out = []
        for at, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if at != now:
                if now is not None:
                    out.append({"at": now, "ends_sha256": digest.hexdigest()})
                now, digest = at, hashlib.sha256(ends.encode())
            else:
                digest.update(("," + ends).encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist([{"at": now, "ends_sha256": digest.hexdigest()}] if now is not None else [], schema)


def trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """NODE for each node of the trie over convs(conv_id, turns: array of (turn, key, words)); conv_id is unique."""
    spark = convs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = stored(convs.select("conv_id", F.array_join(F.transform("turns", lambda t: t["key"]), "").alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")), "trie-paths")
    skeleton = Skeleton(splitters_of(paths, shards))
    shared = spark.sparkContext.broadcast(skeleton)

    @F.arrow_udf("long")
    def shard(path: pa.Array, conv_id: pa.Array) -> pa.Array:
        return pa.array([shared.value.shard(p, c) for p, c in zip(path.to_pylist(), conv_id.to_pylist(), strict=True)], pa.int64())

    small_batches(spark)
    dealt = paths.select(shard("path", "conv_id").alias("shard"), "path", "conv_id", "words").repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
    local = stored(dealt.mapInArrow(_walked(shared), LOCAL), "trie-shards")
    top = stored(_skeleton_nodes(local, skeleton), "trie-skeleton")
    pieces = local.where("piece IS NOT NULL").select("at", "ends", "shard", "piece").repartition("at").sortWithinPartitions("at", "shard", "piece").select("at", "ends")
    digests = pieces.mapInArrow(_digests, "at long, ends_sha256 string")
    upper = top.join(digests, "at", "left").select(*NAMES[:-1], F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    above = F.broadcast(top.select(F.col("at").alias("above"), F.col("conv_id").alias("above_conv")))  # as many rows as the skeleton has nodes
    lower = local.where("at IS NULL").join(above, "above", "left").select(*[F.coalesce("parent_conv_id", "above_conv").alias(c) if c == "parent_conv_id" else F.col("ends").alias(c) if c == "ends_sha256" else c for c in NAMES])
    return upper.union(lower)


def with_turns(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of a trie over conversations as they are, with the role and text of their last turn (null for the root), from rows(conv_id, turn, role, text)."""
    says = F.md5(F.concat(F.md5(F.coalesce("role", F.lit(""))), F.coalesce("text", F.lit(""))))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "_says")
    turns = rows.where("conv_id IS NOT NULL").withColumn("_says", says).select("conv_id", F.row_number().over(order).cast("long").alias("depth"), "role", "text")
    return nodes.join(turns, ["conv_id", "depth"], "left")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations of the whole table."""
    return trie(shared_heads(turns_of(table(spark, sf_dir, "conversations"))))


OP13_SQL = r"""
WITH tab AS (SELECT list(v ORDER BY i) t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) v FROM range(256) r(i))),
rows_ AS (SELECT conv_id, turn, md5(md5(coalesce(role, '')) || coalesce("text", '')) k, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+')) w FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'k': k, 'w': w} ORDER BY turn NULLS FIRST, k) t FROM rows_ GROUP BY conv_id),
h AS (SELECT o.conv_id, o.t, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab.t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 4 h FROM own o, tab),
built AS (SELECT h.conv_id, list_concat(coalesce(b.t[1:h.h], []), h.t[h.h + 1:]) t FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
steps AS (SELECT conv_id, t, unnest(range(len(t) + 1)) d FROM built),
pre AS (SELECT conv_id, d, len(t) n, list_reduce(list_prepend('', [x.k for x in t[1:d]]), lambda a, b: md5(a || b)) node, CASE WHEN d > 0 THEN list_reduce(list_prepend('', [x.k for x in t[1:d - 1]]), lambda a, b: md5(a || b)) END up, CASE WHEN d > 0 THEN t[d].w ELSE 0 END w FROM steps),
nodes AS (SELECT d, node, min(up) up, min(conv_id) conv_id, count(*) n_convs, (count(*) - 1) * max(w) saved, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') ends FROM pre GROUP BY d, node),
kids AS (SELECT d - 1 d, up node, count(*) n FROM nodes WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT n.*, coalesce(k.n, 0) n_children FROM nodes n LEFT JOIN kids k USING (d, node)),
above AS (SELECT DISTINCT a.d, a.node, b.d bd, b.node bnode FROM pre a JOIN pre b ON a.conv_id = b.conv_id AND a.d <= b.d),
sums AS (SELECT a.d, a.node, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) n_leaves, sum(b.saved) saved FROM above a JOIN full_ b ON b.d = a.bd AND b.node = a.bnode GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) n_children, CAST(s.n_leaves AS BIGINT) n_leaves, CAST(s.saved AS BIGINT) saved_tokens, sha256(f.ends) ends_sha256
FROM full_ f JOIN sums s USING (d, node) LEFT JOIN nodes p ON p.d = f.d - 1 AND p.node = f.up
"""
