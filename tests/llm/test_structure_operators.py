"""Operators 11 to 13 against plain Python."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from ridgeline.llm import prefix_trie, repair, sharding

LEGAL = {"su", "ua", "au"}
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
md5 = lambda s: hashlib.md5(s.encode()).hexdigest()


def cheapest(rows: str) -> tuple[int, str]:
    """Uniform-cost search over (rows used, place); the heap's order is (cost, audit)."""
    steps, heap, done = repair.STEPS, [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, p = heapq.heappop(heap)
        if i == len(rows) and p in (0, 3):
            return cost, audit
        if (i, p) in done:
            continue
        done.add((i, p))
        near = [(cost + 2, audit + "I", i, q) for (a, x), q in steps.items() if a == p and x != "s"]
        if i < len(rows):
            c = rows[i]
            near.append((cost + 3, audit + "D", i + 1, p))
            if c != "D":
                extra = int(c.isupper() or c == "=")
                near += [(cost + extra, audit + "K", i + 1, q) for (a, x), q in steps.items() if a == p and x == c.lower()]
                near += [(cost + 2 + extra, audit + "R", i + 1, q) for (a, x), q in steps.items() if a == p and x != "s"]
        for n in near:
            heapq.heappush(heap, n)


def test_cells_are_the_cheapest_edits():
    rng = random.Random(1)
    for n in [0, 1, 2, 3] + [rng.randrange(4, 60) for _ in range(120)]:
        rows = "".join(rng.choice("suaaauuSUA-=D") for _ in range(n))
        assert repair.best(repair.cell(rows)) == cheapest(rows), rows


def test_every_split_gives_the_same_cell():
    """The chart with all spans and all splits."""
    rng = random.Random(2)
    for _ in range(15):
        rows = "".join(rng.choice("suaUA-=D") for _ in range(7))
        chart = {(i, i + 1): repair.short_cell(rows[i]) for i in range(7)}
        for width in range(2, 8):
            for i in range(8 - width):
                cells = [repair.combined(chart[i, k], chart[k, i + width]) for k in range(i + 1, i + width)]
                assert all(c == cells[0] for c in cells)
                chart[i, i + width] = cells[0]
        assert chart[0, 7] == repair.cell(rows)


def brute_repair(rows: list[tuple], hurt: bool = True) -> dict:
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if hurt else 9
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        by[conv] += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, md5(md5(r[1]) + r[2])))
        classes, seen, n, kept = "", set(), Counter(), []
        for _, role, text in own:
            left = text.rstrip(" \t\n\x0b\x0c\r")
            kind = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "fine"
            seen.add((role, text))
            n[kind] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "-"
            classes += "D" if kind in ("blank", "duplicate") else (c.upper() if c != "-" else "=") if kind == "truncated" else c
        cost, audit = cheapest(classes)
        k, system = 0, False
        for e in audit:
            _, role, text = own[k] if e != "I" else (0, "", "")
            k += e != "I"
            system = system or e == "K" and role[:1] == "s"
            if e != "D":
                kept.append(f"{role if e == 'K' else ('user', 'assistant')[(len(kept) - system) % 2]}:{text}")
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha("\n".join(kept)))
    return out


def conversation_rows() -> list[tuple]:
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), 60, 60, -5, None]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"])
            text = rng.choice(["Hello there.", "Hello there.", "Well then", "Yes! ", None, "", " \t", "What?\n", f"Say {turn} {conv}.", "é ü 日本語。", "long " * 3000 + "end."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None, 0]), role, text))
    rows += [(777, t, ("user", "assistant")[t % 2], f"Turn {t % 1900}{'.' if t % 7 else ''}") for t in range(2500)]  # over several partitions
    rows += [(778, None, "user", "same.")] * 300 + [(779, 5, "user", "")] * 20
    return rows


COLUMNS = "conv_id long, turn long, role string, text string, found string, part string, at string, said string, copies string, path string"


@pytest.fixture(scope="module")
def conversations(spark, tmp_path_factory):
    rows = conversation_rows()
    random.Random(4).shuffle(rows)
    path = tmp_path_factory.mktemp("conv")
    spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], COLUMNS).repartition(3).write.parquet(f"{path}/conversations.parquet")
    return str(path), rows


@pytest.fixture(scope="module")
def no_conversations(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("noconv")
    spark.createDataFrame([], COLUMNS).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_repair_is_brute_force(spark, conversations):
    got = {r[0]: tuple(r[1:]) for r in repair.op11_repair(spark, conversations[0]).collect()}
    assert got == brute_repair(conversations[1])


def test_repair_of_dropped_and_no_rows(spark, no_conversations):
    assert repair.op11_repair(spark, no_conversations).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = repair.damaged(repair.rows_of(spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id int, turn int, role string, text string")))
    assert [tuple(r) for r in repair.repairs(rows).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "")]


def test_repaired_turns(spark, conversations):
    rows = repair.rows_of(spark.read.parquet(f"{conversations[0]}/conversations.parquet"))
    lines = defaultdict(list)
    for r in sorted(repair.repaired(rows).collect(), key=lambda r: (str(r.conv_id), r.place)):
        assert r.place == len(lines[r.conv_id]) and (r.edit != "I" or (r.turn is None and r.text == ""))
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, found in brute_repair(conversations[1], hurt=False).items():
        assert sha("\n".join(lines[conv])) == found[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines[conv]))


def fraction(name: str) -> float:
    return int(md5(name)[:12], 16) / float(1 << 48)


def brute_shards(rows: list[tuple], shards: int = 24) -> list[tuple]:
    by = defaultdict(list)
    for i, text, source in rows:
        name = "" if i is None else str(i)
        by[source or ""].append((fraction(f"shard-1:{name}"), name, md5(text or ""), i, text or ""))
    order = [((k + fraction(f"shard-1/{s}")) / len(own), s, *r) for s, own in by.items() for k, r in enumerate(sorted(own, key=lambda r: r[:3]))]
    order.sort(key=lambda r: r[:5])
    out = []
    for place, r in enumerate(order):
        shard = place * shards // len(order)
        out.append((r[5], len(r[6].encode()) + 8, zlib.crc32(r[6].encode()), "rows", shard, place - math.ceil(shard * len(order) / shards), None))
    return sorted(out, key=str)


def test_shards_are_brute_force(spark, folder, nothing, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = [tuple(r) for r in sharding.op12_sharding(spark, folder).collect()]
    assert sorted(got, key=str) == brute_shards(rows)
    assert sharding.op12_sharding(spark, nothing).collect() == []


def test_shards_keep_the_mixture_and_columns(spark, tmp_path):
    rows = [(i, "same" if i % 3 else f"t{i}", "hot" if i % 3 else f"s{i % 40}", 1, 2) for i in range(3000)] + [(None, None, None, 1, 2)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `PLACED` int, `a.b` int")
    placed = sharding.sharded(docs)
    assert placed.columns == ["doc_id", "text", "source", "a.b", "placed"]
    got = placed.select("doc_id", "source", "placed.*").collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, None) for r in got if r.doc_id is not None) == sorted(r for r in brute_shards([r[:3] for r in rows]) if r[0] is not None)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all({r.slot for r in got if r.shard == s} == set(range(n)) for s, n in sizes.items())
    hot = Counter(r.shard for r in got if r.source == "hot")
    assert max(hot.values()) - min(hot.values()) <= 12  # 83 of 125 a shard; 41 small sources beside it
    path = sharding.written(placed, str(tmp_path / "shards"))
    back = spark.read.parquet(path)
    assert back.count() == 3005 and back.select("shard").distinct().count() == 24


def brute_trie(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, md5(md5(role or "") + (text or "")), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(",".join(map(str, sorted(ends[n]))))) for n, m in members.items()), key=str)


def test_trie_is_brute_force(spark, conversations, no_conversations):
    got = [tuple(r) for r in prefix_trie.op13_prefix_trie(spark, conversations[0]).collect()]
    assert sorted(got, key=str) == brute_trie(conversations[1])
    assert prefix_trie.op13_prefix_trie(spark, no_conversations).collect() == []


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_trie_with_a_hot_conversation(spark, shards, monkeypatch):
    """A third of all conversations are equal and many share a first turn; pieces of members are small."""
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = []
    for c in range(1, 900):
        turns = ["Hi", "Same answer here", "Bye"] if c % 3 == 0 else ["Hi", f"Question {c % 17}", *[f"t{c % 5}"] * (c % 4)]
        rows += [(c, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = prefix_trie.trie(prefix_trie.shared_heads(prefix_trie.turns_of(table)), shards)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_trie(rows)


def test_nodes_with_their_turns(spark):
    table = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a")], "conv_id long, turn int, role string, text string")
    got = prefix_trie.with_turns(prefix_trie.trie(prefix_trie.turns_of(table), 2), table).orderBy("depth").select("depth", "n_convs", "role", "text").collect()
    assert [tuple(r) for r in got] == [(0, 2, None, None), (1, 2, "user", "a"), (2, 1, "assistant", "b")]


# --- names, ids and words that once broke earlier operators


ODD = ["a.b", "MIX", "TOLD", "Row", "`quoted`"]


def odd_docs(spark):
    rows = [(i, f"The quick brown fox number {i} jumps over the lazy dog again and again.", ["en", "de"][i % 2], f"s{i % 3}", 70, *["x"] * len(ODD)) for i in range(40)]
    rows += [(None, "Der Hund lief weit weg.", "de", "s1", 23, *["x"] * len(ODD))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in ODD))


def test_pipeline_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(r[-len(ODD) :] == ("x",) * len(ODD) for r in kept)
    assert all(r.round_trip for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect())


def test_mixing_replaces_a_column_of_its_own_name_only(spark):
    from ridgeline.llm import mixing

    assert mixing.mixed(odd_docs(spark)).columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "TOLD", "Row", "`quoted`", "mix"]


def test_suffix_dedup_of_rows_that_share_an_id(spark):
    from ridgeline.llm import suffix_dedup

    long = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(943))
    rows = [(1, long), (1, "short"), (2, long), (2, long), (None, long), (None, "x"), (3, None), (3, "é" * 3)]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in got), key=str) == sorted([(1, 943, 943), (1, 5, 0), (2, 943, 943), (2, 943, 943), (None, 943, 0), (None, 1, 0), (3, 0, 0), (3, 6, 0)], key=str)


def test_long_words_beside_other_scripts():
    import time

    import numpy as np

    from ridgeline.llm import tokenstore

    with open(tokenstore.TOKENIZER, encoding="utf-8") as f:
        enc = tokenstore.WordEncoder(f.read())
    texts = ["é " + "a1" * 500_000, "a1" * 20 + "é" + "b2" * 20 + " x9 " + "é1 don't a1é", "1é2 é", "日本a1 1a日"]
    raw = [t.encode() for t in texts]
    began = time.process_time()
    ids, counts = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert time.process_time() - began < 4
    ends = np.cumsum(counts).tolist()
    for k in (1, 2, 3):
        assert ids[ends[k - 1] : ends[k]].tolist() == enc.tokenizer.encode(texts[k], add_special_tokens=False).ids
    assert counts[0] > 900_000


def test_share_of_a_sample(spark):
    from ridgeline.llm import langid

    docs = spark.range(20_000).selectExpr("id doc_id", "concat('some words here ', id) text", "if(id % 2 = 0, 'en', 'de') lang")
    model = langid.train(docs, docs["text"], docs["lang"], docs["doc_id"], per_language=500)
    assert model.languages == ["de", "en"]
    assert (langid.score_rows(model, pa.array(["some words here 7"]))[1] > 0).all()
    assert langid.PICKS * 4000 // 10**12 > 0  # a language of 10^12 rows still has its sample
