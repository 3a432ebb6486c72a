"""Operator 4: n-gram Jaccard join by filters under several global orders of the shingles, then exact verification.

A document is the set of its five-word shingles' 64-bit hashes. Linked documents (Jaccard 0.8 or more) leave at most a
fifth of either set unshared, so under any global order of the shingles they share one of the larger set's first ``n // 5 + 1``
that is also among the smaller set's first ``n // 9 + 1``. Orders used:

1. ascending hash. Each document's first quarter is looked at: unless all but ``n // 5`` of these shingles occur in another
   document too, it has no link. What is left is looked at in full in the same way. Counts combine in each task before they
   shuffle (a shingle is sent once a task).
2. ascending document frequency among what is left. Shingles that occur once fill the prefix first; a document with more than
   a fifth of them has no link. The rest of the prefix is the postings that candidates must share.
3. one order for each leader. The leader of a posting is the set in it that shares most of itself with others; every set is compared
   with the leaders of its postings, exactly, and keeps how much they share. The leader's order puts shingles that the leader
   lacks before those it has, each by document frequency. Two sets with one leader can link only if the smaller of their shares
   of the leader is large enough alone, or if they have a prefix shingle under the leader's order that the leader lacks.

A pair is a candidate if it passes the filters of 2 and 3 (pairs by a leader's order are held against their prefixes of order 2 before any set
moves for them) and no links found so far put it in one component. As near copies of one text
mostly link with its leader, and others have too small a share of it, few pairs are left of even a very large group. Every
candidate is then verified, so the components are those of all links. Equal sets (by a 128-bit digest)
are one class, a node named by one of its rows.

Defined results: null or empty text, or text of white space, has no shingles and links with nothing; fewer than five words
are one shingle; a null doc_id gets a null component; rows that share an id count as one document that has the links of each;
any 64-bit id is allowed, negative ones too; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, distinct_groups, give_back, having_ids, home_column, homes_of, joined, packed, packed_table, runs, small_batches, stored, table, texts_of, windows, word_hashes
from .components import components

SHINGLE = 5
CHUNK_TOKENS = 1 << 19
GROUP = 512


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    data, offsets = buffers(texts)
    out = []
    for i, j in runs(offsets):
        h, _, _, firsts = word_hashes(data, offsets[i : j + 1], lower=True)
        hashes, begins = windows(h, firsts, SHINGLE, short=True)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            own = np.sort(hashes[a:b])
            out.append(own[distinct_groups(own)] if len(own) else own)
    return out


_SENT = ["bucket", "tokens", "docs", "keys", "counts", "rows"]


class _Sender:
    """Shingles of one task's documents, sent once each: those that several of its documents have without a document."""

    def __init__(self, buckets: int, whole: bool):
        self.buckets, self.whole = buckets, whole
        self.clear()

    def clear(self) -> None:
        self.tokens, self.owners, self.needs, self.count = [], [], [], 0

    def add(self, key: int, own: np.ndarray) -> None:
        """Take a document's sorted set: all of it, or its first quarter."""
        n = len(own)
        part = (own if self.whole else own[: n // 5 + max(1, -(-n // 20))]).copy()
        self.tokens.append(part)
        self.owners.append(np.full(len(part), key))
        self.needs.append((key, len(part) - n // 5))  # so many of them must occur elsewhere
        self.count += len(part)

    def flush(self) -> pa.Table:
        token, doc = np.concatenate(self.tokens), np.concatenate(self.owners)
        keys, lacking = np.array(self.needs, np.int64).T
        self.clear()
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        first = distinct_groups(token)
        size = np.diff(np.append(np.flatnonzero(first), len(token)))
        known, n = np.unique(doc[np.repeat(size > 1, size)], return_counts=True)
        keys, counts = np.concatenate([known, keys]), np.concatenate([n, -lacking]).astype(np.int32)
        rows_of = np.repeat([0, 1], [len(known), len(lacking)]).astype(np.int8)
        out = [[len(token) % self.buckets, b"", b"", keys.tobytes(), counts.tobytes(), rows_of.tobytes()]]
        token, doc, several = token[first], doc[first], size > 1
        bucket = ((token >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(2 * bucket + several, kind="stable")  # within a bucket: those of one document first
        token, doc, several, bucket = token[order], doc[order], several[order], bucket[order]
        five = token.view(np.uint8).reshape(-1, 8)[:, :5]  # within a bucket; a collision only lets a document pass
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in np.unique(bucket).tolist():
            x, y = cuts[b], cuts[b + 1]
            out.append([b, five[x:y].tobytes(), doc[x : y - int(several[x:y].sum())].tobytes(), b"", b"", b""])
        return packed_table(out, _SENT)


def _met(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, how many of their shingles others have (less how many must), and their rows, as one bucket shows it."""
    token, doc, alone = [], [], []
    for t, d in zip(group.column("tokens").to_pylist(), group.column("docs").to_pylist(), strict=True):
        wide = np.zeros((len(t) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(t, np.uint8).reshape(-1, 5)
        token.append(wide.view(np.uint64)[:, 0])
        own = np.zeros(len(wide), np.int64)
        own[: len(d) // 8] = np.frombuffer(d, np.int64)
        doc.append(own)
        alone.append(np.arange(len(wide)) < len(d) // 8)
    keys, counts, rows = (joined(group.column(c).to_pylist(), t) for c, t in (("keys", np.int64), ("counts", np.int32), ("rows", np.int8)))
    token, doc, alone = np.concatenate(token), np.concatenate(doc), np.concatenate(alone)
    order = np.argsort(token)
    token, doc, alone = token[order], doc[order], alone[order]
    same = np.zeros(len(token), bool)
    same[1:] = token[1:] == token[:-1]
    same[:-1] |= same[1:]
    own, n = np.unique(doc[same & alone], return_counts=True)
    return np.concatenate([keys, own]), np.concatenate([counts, n]).astype(np.int64), np.concatenate([rows, np.zeros(len(own))]).astype(np.int64)


def _suspects(docs: DataFrame, buckets: int, whole: bool) -> DataFrame:
    """Ids of the documents of which no more than a fifth of the shingles is their own, as far as the first quarter under
    ascending hashes shows it, or the whole set; and ids that several rows have."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets, whole)
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                if len(own):
                    sender.add(key, own)
            if sender.count >= CHUNK_TOKENS:
                yield from sender.flush().to_batches()
        if sender.count:
            yield from sender.flush().to_batches()
        give_back()

    def meet(group: pa.Table) -> pa.Table:
        keys, counts, rows = _met(group)
        return packed_table(packed(homes_of(keys, buckets), buckets, keys, counts, rows), ["home", "keys", "counts", "rows"])

    def settle(group: pa.Table) -> pa.Table:
        keys, counts, rows = (joined(group.column(c).to_pylist(), np.int64) for c in ("keys", "counts", "rows"))
        own, at = np.unique(keys, return_inverse=True)
        shared, times = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        np.add.at(shared, at, counts)
        np.add.at(times, at, rows)
        return pa.table({"doc_id": own[(shared >= 0) | (times > 1)]})

    sent = docs.mapInArrow(send, "bucket int, tokens binary, docs binary, keys binary, counts binary, rows binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "home int, keys binary, counts binary, rows binary")
    return met.groupBy("home").applyInArrow(settle, "doc_id long")


SET = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("class", T.BinaryType()), T.StructField("tokens", T.BinaryType())])


@F.arrow_udf(SET)
def shingle_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Column function: set size, a digest of the whole set, and the sorted set as 64-bit values."""
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch)]
        digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
        yield pa.StructArray.from_arrays([pa.array([len(s) // 8 for s in sets], pa.int32()), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["n", "class", "tokens"])
    give_back()


@F.arrow_udf(T.LongType())
def set_size(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([len(s) for s in shingle_sets(batch)], pa.int64())
    give_back()


@F.arrow_udf(T.ArrayType(T.LongType()))
def as_array(sets: pa.Array) -> pa.Array:
    data, offsets = buffers(sets)
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]) // 8, pa.int32()), pa.array(np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.int64)))


def _renamed(df: DataFrame) -> DataFrame:
    """The same columns as columns of their own, for a join with another table made from the same ones."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def compared(pairs: DataFrame, heads: DataFrame, others: DataFrame, buckets: int, room: bool) -> DataFrame:
    """a, b, n_a, n_b, both (their common shingles) for pairs(a, b) of heads(node, n, tokens) and others(node, n, shared).

    shared: a node's shingles that other nodes have too, by document frequency. room: also outside, the first ``n_b // 5 + 1`` shingles
    of b under the leader a's order as far as a lacks them (without those of b alone, which come first), and before, how many those are.
    A node in very many pairs is dealt to several groups of about ``GROUP`` pairs."""
    pairs = stored(pairs, "ngram-pairs")
    # only what the pairs name is shuffled
    heads = having_ids(heads, pairs.select(F.col("a").alias("node")), "node")
    others = having_ids(others, pairs.select(F.col("b").alias("node")), "node")
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    right = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("node")).join(_renamed(others), "node")
    left = many.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(_renamed(heads).withColumnRenamed("node", "a"), "a")
    bucket = F.pmod(F.xxhash64("a", "part"), F.lit(buckets)).alias("bucket")

    def compare(heads: pa.Table, rows: pa.Table) -> pa.Table:
        of = {(a, p): (n, np.frombuffer(t, np.uint64)) for a, p, n, t in zip(*(heads.column(c).to_pylist() for c in ("a", "part", "n", "tokens")), strict=True)}
        out = ([], [], [], [], [], [], [])
        for a, p, b, m, t in zip(*(rows.column(c).to_pylist() for c in ("a", "part", "node", "n", "shared")), strict=True):
            n, x = of[a, p]
            y = np.frombuffer(t, np.uint64)
            has = x[np.minimum(np.searchsorted(x, y), n - 1)] == y
            before = m - len(y)
            outside = y[~has][: max(0, m // 5 + 1 - before)].view(np.int64) if room else []
            for column, value in zip(out, (a, b, n, m, int(has.sum()), outside, before), strict=True):
                column.append(value)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32())
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("a", "b", "n_a", "n_b", "both", "outside", "before"), out, types, strict=True)})

    grouped = _renamed(left.select(bucket, "a", "part", "n", "tokens")).groupBy("bucket").cogroup(_renamed(right.select(bucket, "a", "part", "node", "n", "shared")).groupBy("bucket"))
    return grouped.applyInArrow(compare, "a long, b long, n_a int, n_b int, both int, outside array<long>, before int")


LINKED = "9 * both >= 4 * (n_a + n_b)"  # Jaccard 0.8 or more, in whole numbers


def _shared(sets: DataFrame) -> DataFrame:
    """node, n, shared (its shingles that other nodes have too, rarest first) of the nodes that can have links."""
    every = sets.select("node", "n", F.explode(as_array("tokens")).alias("token"))
    often = every.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = every.join(often, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))  # no longer than a document
    return shared.where(F.col("n") - F.size("shared") <= F.floor(F.col("n") / 5)).select("node", "n", F.col("shared.token").alias("shared"))


@F.arrow_udf(T.BinaryType())
def as_bytes(arrays: pa.Array) -> pa.Array:
    return pa.array([np.asarray(x.values, np.int64).tobytes() for x in arrays], pa.binary())


def _candidates(probe: DataFrame, index: DataFrame, key: list[str], apart) -> DataFrame:
    """a, b: nodes of two components with one key, a's size from b's to 5/4 of it; apart: what else must hold."""
    one = probe.select(*key, F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("reach").alias("ra"))
    two = index.select(*key, F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("reach").alias("rb"))
    sizes = ((F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))) & (5 * F.col("nb") >= 4 * F.col("na"))
    return one.join(two, key).where((F.col("ca") != F.col("cb")) & sizes & apart).select("a", "b")


def _mixed(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """The rows of those keys that several components have, with the least n among them."""
    stats = rows.groupBy(*key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least")).where("lo < hi").drop("lo", "hi")
    return stored(rows.join(stats, key), name)


def _of_both_orders(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """The pairs a, b of which the larger a's and the smaller b's prefixes by document frequency share a shingle as well. Only prefixes move, no whole sets."""
    n, own = F.col("n"), F.col("n") - F.size("shared")

    def first(name: str, node: str, part: int) -> DataFrame:
        return shared.select(F.col("node").alias(node), F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.floor(n / part).cast("int") + 1 - own)).alias(name))

    return pairs.join(first("long", "a", 5), "a").join(first("short", "b", 9), "b").where(F.arrays_overlap("long", "short")).select("a", "b")


def _links(sets: DataFrame, buckets: int) -> DataFrame:
    """Links a, b whose components are those of all links between the sets."""
    shared = stored(_shared(sets), "ngram-shared")
    n, own = F.col("n"), F.col("n") - F.size("shared")
    prefix = shared.select("node", "n", (F.size("shared") / n).alias("central"), own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), F.floor(n / 5).cast("int") + 1 - own)).alias("at", "token"))
    postings = stored(prefix.select("token", "node", "n", "central", (F.col("own") + F.col("at") <= F.floor(n / 9)).alias("index")), "ngram-postings")
    heads, others = sets.select("node", "n", "tokens"), shared.select("node", "n", as_bytes("shared").alias("shared"))

    # every node against the leaders of its postings
    lead = postings.groupBy("token").agg(F.max(F.struct("central", "n", "node")).alias("top"), F.count("*").alias("c")).where("c > 1").select("token", F.col("top.node").alias("leader"))
    led = stored(postings.join(lead, "token"), "ngram-led")
    pairs = led.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    shares = stored(compared(pairs, heads, others, buckets, True), "ngram-shares")
    links = shares.where(LINKED).select("a", "b")
    component = components(links)

    # reach: the size up to which a set can link with this one by what both have of the leader
    has = shares.select(F.col("a").alias("leader"), F.col("b").alias("node"), "both", "outside", "before")
    itself = led.where("leader = node").select("leader", "node", n.alias("both"), F.array().cast("array<long>").alias("outside"), F.lit(0).alias("before")).distinct()
    reach = F.floor((9 * F.col("both") - 4 * n) / 4).alias("reach")
    nodes = shared.select("node", "n").join(component, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"))
    has = stored(has.unionByName(itself).join(nodes, "node").select("*", reach), "ngram-has")

    # second order, where the leader's part alone allows a link
    spots = _mixed(led.select("token", "leader", "node", "index").join(has.drop("outside", "before", "both"), ["leader", "node"]), ["token"], "ngram-spots")
    able = spots.where("reach >= least")
    inner = _candidates(able, able.where("index AND reach >= n"), ["token"], (F.col("ra") >= F.col("nb")) & (F.col("rb") >= F.col("na")))

    # third order: shingles that the leader lacks, where its part alone does not
    lacked = has.select("leader", "node", "n", "component", "reach", "before", F.posexplode("outside").alias("at", "token")).withColumn("index", F.col("before") + F.col("at") <= F.floor(n / 9))
    lacked = _mixed(lacked, ["leader", "token"], "ngram-lacked")
    outer = _candidates(lacked, lacked.where("index"), ["leader", "token"], (F.col("ra") < F.col("nb")) | (F.col("rb") < F.col("na")))
    found = compared(inner.union(_of_both_orders(outer.distinct(), shared)).distinct(), heads, others, buckets, False)
    return links.union(found.where(LINKED).select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, component_id for the documents(doc_id, text) that the first order leaves; all others are alone."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    for whole in (False, True):
        suspects = stored(_suspects(docs, buckets, whole), "ngram-suspects")
        docs = having_ids(docs, suspects)
    rows = docs.select("doc_id", shingle_set("text").alias("s")).select("doc_id", "s.*").where("n > 0")
    every = stored(rows.withColumn("row", F.monotonically_increasing_id()), "ngram-every")
    classes = stored(every.groupBy("class").agg(F.min("row").alias("node")), "ngram-classes")
    # one set for each class; a few copies may come along, which then link to their like
    sets = having_ids(every.select(F.col("row").alias("node"), "n", "tokens"), classes.select("node"), "node")
    member = stored(every.select("doc_id", "class").join(classes, "class").select("doc_id", "node"), "ngram-members")
    # rows that share an id belong together
    repeated = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    same = member.select("doc_id", F.col("node").alias("b")).join(repeated.select("doc_id", "a"), "doc_id").where("a <> b").select("a", "b")
    component = components(_links(sets, buckets).union(same))
    member = stored(member.join(component, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component")), "ngram-grouped")
    least = member.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return member.join(least, "component").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and the component of its links."""
    docs = texts_of(table(spark, sf_dir, "documents"))
    found = near_duplicates(docs)
    sizes = docs.select("doc_id", set_size("text").alias("n_shingles"))
    return sizes.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_shingles, least(w.doc_id, coalesce(r.b, w.doc_id)) component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a doc_id, min(b) b FROM reach GROUP BY a) r USING (doc_id)
"""
