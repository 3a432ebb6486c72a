"""Operators 3 to 6, 8 and the pipeline against brute force."""

import collections
import hashlib
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ridgeline.llm import components, mixing, ngram_join, queries, recompression, suffix_dedup, topk

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked_groups(rows):
    """component_id of each row index; rows without an id are alone."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [(k, len(sets[i]), least[root(i)] if k is not None else None) for i, (k, _) in enumerate(rows)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_op3_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({queries.ORACLES['op3_topk']})").fetchall()
    assert rows_of(topk.op3_topk(spark, DATA)) == sorted(want, key=repr)


def test_op3_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.5, -0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, []), (8, [0.0, 0.0, 3.0]), (5, [1.0, 0.0])]
    v = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = rows_of(topk.top_k(v.where("vec_id % 50 = 0"), v, 3))
    assert [r for r in got if r[0] == 0] == [(0, 1, 5, 65536), (0, 2, 5, 65536), (0, 3, 6, 65536)]
    assert topk.top_k(v.where("false"), v, 3).count() == 0
    assert topk.top_k(v.where("vec_id = 0"), v.where("vec_id = 0"), 3).count() == 0


def test_op4_brute_force(spark, folder, texts):
    assert rows_of(ngram_join.op4_ngram_join(spark, folder)) == sorted(linked_groups(texts), key=repr)


def test_op4_chains_and_families(spark, tmp_path):
    """Copies of copies: chains that only neighbours link, next to families that share a passage."""
    rng = random.Random(6)
    rows, word = [], lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    for family in range(6):
        base = [word() for _ in range(100)] + passage
        for _ in range(25):
            rows.append((len(rows), " ".join(base)))
            for _ in range(rng.choice((1, 2, 3))):
                base = base.copy() if family % 2 else list(WORD.findall(rows[-1][1]))
                base[rng.randrange(100)] = word()
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(ngram_join.op4_ngram_join(spark, str(tmp_path))) == sorted(linked_groups(rows), key=repr)


NEGATIVE = [(-9 - i, " ".join(f"common{k}" for k in range(200)) + f" own{i}") for i in range(4)] + [(-2, "something else"), (7, None)]


@pytest.fixture(scope="module")
def negative(spark, tmp_path_factory):
    """Negative ids, each document in a file and so in a task of its own."""
    path = tmp_path_factory.mktemp("negative")
    for row in NEGATIVE:
        spark.createDataFrame([row], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize(("query", "want"), [(ngram_join.op4_ngram_join, linked_groups), (recompression.op5_recompression, lambda rows: kept_words(rows)), (suffix_dedup.op6_suffix_dedup, lambda rows: kept_bytes(rows))])
def test_negative_ids(spark, negative, query, want):
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        assert rows_of(query(spark, negative)) == sorted(want(NEGATIVE), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_op4_one_id_with_several_texts(spark, tmp_path):
    """A copy of another document and a long text of its own under one id, in tasks of their own."""
    shared, own = " ".join(f"s{k}" for k in range(60)), " ".join(f"own{k}" for k in range(500))
    rows = [(1, shared), (5, shared), (5, own), (8, own + " more"), (9, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.op4_ngram_join(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 5: 1, 8: 1, 9: 9}


def test_op4_near_copies_and_common_lines(spark, tmp_path):
    """A family of near copies of which many don't link with its centre, truncated ones, and documents made of a few common lines."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(160)]
    lines = [" ".join(f"l{i}x{k}" for k in range(25)) for i in range(12)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        texts.append(" ".join(w[: rng.choice([160, 160, 150, 130, 110, 90])]))
    texts += ["\n".join(rng.sample(lines, rng.randrange(3, 7))) for _ in range(150)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(ngram_join.op4_ngram_join(spark, str(tmp_path))) == sorted(linked_groups(rows), key=repr)


def test_words_that_mirror_each_other():
    """Regular words on which a hash that is linear in its bytes collides."""
    import pyarrow as pa

    from ridgeline.llm.common import buffers, windows, word_hashes

    turns = [bin(i).count("1") % 2 for i in range(4096)]
    words = ["".join("ab"[x ^ flip] for x in turns[:n]) for n in (8, 64, 512, 1024, 4096) for flip in (0, 1)]
    h, *_ = word_hashes(*buffers(pa.array([" ".join(words)])), lower=False)
    assert len(set(h.tolist())) == len(words)
    two = np.array([1, 2], np.uint64)
    for n, k in ((64, 50), (1024, 1000)):
        x = np.concatenate([two[turns[:n]], two[[1 - t for t in turns[:n]]]])
        got, _ = windows(x, np.array([0, n, 2 * n]), k, short=False)
        assert len(set(got.tolist())) == len({tuple(x[d * n + i : d * n + i + k].tolist()) for d in range(2) for i in range(n - k + 1)})


def test_op4_empty(spark, nothing):
    assert ngram_join.op4_ngram_join(spark, nothing).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def kept_words(rows):
    first = {}
    for k, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), k)
    out = []
    for k, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - 49) if k is not None else ():
            if first[tuple(w[i : i + 50])] < k:
                gone.update(range(i, i + 50))
        out.append((k, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def test_op5_brute_force(spark, folder, texts):
    assert rows_of(recompression.op5_recompression(spark, folder)) == sorted(kept_words(texts), key=repr)


def test_op5_periodic_and_spliced(spark, tmp_path):
    rng = random.Random(2)
    pool = [[rng.choice("abc") for _ in range(90)] for _ in range(4)] + [["a"] * 90, ["a", "b"] * 45]
    rows = [(i, " ".join(sum(([x for x in rng.choice(pool)[rng.randrange(30) :]] for _ in range(3)), []))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(recompression.op5_recompression(spark, str(tmp_path))) == sorted(kept_words(rows), key=repr)


def test_op5_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(9)
    core = rng.integers(0, 4, 50).astype(np.uint64)
    found = set()
    for _ in range(40):
        h = np.concatenate([rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64), core, rng.integers(0, 4, rng.integers(0, 30)).astype(np.uint64)])
        at = next(i for i in range(len(h) - 49) if (h[i : i + 50] == core).all())
        found.add(int(recompression.anchors(h, np.array([0, len(h)]))[at]))
    assert len(found) == 1


def test_op5_empty(spark, nothing):
    assert recompression.op5_recompression(spark, nothing).count() == 0


def kept_bytes(rows):
    times = collections.Counter()
    for k, t in rows:
        b = (t or "").encode()
        if k is not None:
            times.update(b[i : i + 400] for i in range(len(b) - 399))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399) if k is not None else ():
            if times[b[i : i + 400]] > 1:
                edge[i] += 1
                edge[i + 400] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def short(rows):
    return [(k, t if t is None or len(t) < 20_000 else t[:9000] + t[-9000:]) for k, t in rows]


def test_op6_brute_force(spark, texts, tmp_path):
    rows = short(texts)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(suffix_dedup.op6_suffix_dedup(spark, str(tmp_path))) == sorted(kept_bytes(rows), key=repr)


@pytest.mark.parametrize("common", [2000, 3])
def test_op6_spliced(spark, tmp_path, monkeypatch, common):
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcd") for _ in range(700)) for _ in range(5)] + ["xyz" * 300]
    rows = [(i, "".join(rng.choice(pool)[rng.randrange(300) : rng.randrange(400, 700)] + rng.choice(["", "#", "é"]) for _ in range(3))) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(suffix_dedup.op6_suffix_dedup(spark, str(tmp_path))) == sorted(kept_bytes(rows), key=repr)


def test_op6_transform(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LENGTH", 16)
    rng = random.Random(1)
    for _ in range(100):
        regions = [bytes(rng.choice(b"ab") for _ in range(rng.randint(16, 60))) for _ in range(rng.randint(1, 6))]
        times = collections.Counter(r[k : k + 16] for r in regions for k in range(len(r) - 15))
        want = [[k + 16 <= len(r) and times[r[k : k + 16]] > 1 for k in range(len(r))] for r in regions]
        assert [x.tolist() for x in suffix_dedup.repeated(regions)] == want


def test_op6_backward_steps():
    """Intervals of a transform, extended by one byte, are those of the longer strings."""
    rng = random.Random(7)
    for _ in range(30):
        regions = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 4))]
        sym = np.concatenate([np.append(np.frombuffer(r, np.uint8).astype(np.int64), 256 + k) for k, r in enumerate(regions)])
        order = suffix_dedup.suffix_order(sym, 10)
        suffixes = [sym[k:].tolist() for k in order]
        assert suffixes == sorted(suffixes)
        transform = suffix_dedup.Transform(suffix_dedup.dense(sym)[order - 1], len(regions))

        def interval(s, suffixes=suffixes):
            hits = [k for k, x in enumerate(suffixes) if x[: len(s)] == s]
            return (hits[0], hits[-1] + 1) if hits else None

        for size in range(4):
            strings = {tuple(x[:size]) for x in suffixes if all(c < 256 for c in x[:size])} or {()}
            for s in strings:
                lo, hi = interval(list(s))
                got = sorted(zip(*(x.tolist() for x in transform.backward(np.array([lo]), np.array([hi]))), strict=True))
                assert got == sorted(i for c in {97, 98, 0, 255} if (i := interval([c, *s])))


def test_anchors_of_windows_come_from_few_grams():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).tolist()) for _ in range(400)]
    rows = [b" ".join(words[k] for k in rng.integers(0, 400, n)) for n in (60, 300, 5, 900, 400)]
    rows[2:2] = [b"The " * 300, b"a" * 1000, b"", rows[1][:400], rows[1][:399], b" ".join(words[:80]) + b"ab" * 500]
    ends = np.cumsum([len(r) for r in rows])
    data, span = np.frombuffer(b"".join(rows), np.uint8), suffix_dedup.LENGTH - suffix_dedup.GRAM + 1
    piece = suffix_dedup.Piece(data, ends - [len(r) for r in rows], ends)
    starts = [a for e, r in zip(ends.tolist(), rows, strict=True) for a in range(e - len(r), e - suffix_dedup.LENGTH + 1)]
    for order in range(len(suffix_dedup.ORDERS)):
        ranked = piece.grams * suffix_dedup.ORDERS[order]
        places = [a + int(np.argmin(ranked[a : a + span] >> np.uint64(23))) for a in starts]
        first = [k for k, x in enumerate(places) if not k or x != places[k - 1]]
        anchor, at, size = piece.runs(order)
        assert at.tolist() == first and anchor.tolist() == [int(ranked[places[k]]) for k in first]
        assert size.tolist() == np.diff([*first, len(starts)]).tolist()
    text = np.frombuffer(b" ".join(words[k] for k in rng.integers(0, 400, 40_000)), np.uint8)
    piece = suffix_dedup.Piece(text, np.array([0]), np.array([len(text)]))
    tracemalloc.start()
    piece.runs(1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(text)  # the ranked grams take half of it; nothing else is held for every window


def test_op6_empty(spark, nothing):
    assert suffix_dedup.op6_suffix_dedup(spark, nothing).count() == 0


def test_op8_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = mixing.op8_mixing(spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.execute(queries.ORACLES["op8_mixing"]).df().sort_values("doc_id").reset_index(drop=True)[list(got.columns)]
    assert got.astype(str).equals(want.astype(str))


def test_op8_margins_meet_targets(spark, docs):
    given = {"source": [("src0", 0.25), ("src1", 0.5), ("", 0.25)], "lang": [("en", 0.5), ("de", 0.25), ("", 0.25)]}
    targets = {m: spark.createDataFrame(v, f"{m} string, target double") for m, v in given.items()}
    targets["topic"] = spark.createDataFrame([("all", 1.0)], "topic string, target double")
    got = mixing.mixed(docs, targets, topic_of=F.lit("all"))
    total = got.agg(F.sum(F.col("mix.n_tokens") * F.col("mix.weight"))).first()[0]
    for m, v in given.items():
        shares = {r[0]: r[1] / total for r in got.groupBy(f"mix.{m}").agg(F.sum(F.col("mix.n_tokens") * F.col("mix.weight"))).collect()}
        assert shares == pytest.approx(dict(v), abs=0.02)
    assert set(got.columns) == set(docs.columns) and got.count() == docs.count()


def test_op8_empty(spark, nothing):
    assert mixing.op8_mixing(spark, nothing).count() == 0


def test_pipeline(spark, folder, texts):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept, frames = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.stored(stage(spark, kept, folder), f"test-{name}")
        frames[name] = kept
        if name != names[-1]:
            assert kept.columns == docs.columns
    told = {r["doc_id"] for r in frames["language_id"].collect()}
    assert told == {i for i, t in texts if any(c.isalpha() for c in t or "")}
    groups = {}
    for i, _, c in linked_groups([(i, t) for i, t in texts if i in told]):
        groups.setdefault(i, c)
    assert {r["doc_id"] for r in frames["near_duplicates"].collect()} == {i for i, c in groups.items() if i is None or i == c}
    assert frames["personal_data"].where("text LIKE '%me@example.org%'").count() == 0
    assert frames["byte_bpe"].where("NOT round_trip").count() == 0
    assert frames["byte_bpe"].count() == frames["mixing_weights"].count() <= frames["personal_data"].count()


def test_pipeline_on_nothing(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_op4_pairs_of_both_orders(spark):
    """A pair stays if its prefixes by document frequency meet: a fifth of the larger set, a ninth of the smaller, shingles of its own included."""
    rows = [(1, 20, list(range(20))), (2, 18, [3, *range(100, 117)]), (3, 18, [*range(200, 203), 3, *range(300, 314)]), (4, 18, [3, *range(400, 415)])]
    shared = spark.createDataFrame(rows, "node long, n int, shared array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    # 3 has the common shingle outside its first three; 4 has two shingles of its own before it, which leaves it the last of three
    assert rows_of(ngram_join._of_both_orders(pairs, shared)) == [(1, 2), (1, 4)]
