"""Operators 1, 2, 7, 9 and 10 against brute force, on texts of every odd kind."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridgeline.llm import bpe, fingerprint, langid, pii, tokenstore

DATA = "/root/testdata/sf0.001"


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def encoding():
    with open(bpe.RANK_FILE, "rb") as f:
        return bpe.encoding(f.read(), public_tokenizers.PATTERN)


def test_op1_digests(spark, folder, texts, encoding):
    want = []
    for i, t in texts:
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha((t or "").encode())))
    assert rows_of(bpe.op1_byte_bpe(spark, folder)) == sorted(want, key=repr)


def test_op1_empty(spark, nothing):
    assert bpe.op1_byte_bpe(spark, nothing).count() == 0


def test_op1_safe_pieces(encoding):
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice("ab'sé1 \n.,\t日") for _ in range(200))
        assert [x for p in bpe.safe_pieces(t, 20) for x in encoding.encode_ordinary(p)] == encoding.encode_ordinary(t)


def test_op1_long_runs(spark, encoding):
    """Runs that the regular-expression engine can't take: as many ids as single blanks, and the same bytes again."""
    texts = [" " * 1_000_000 + "a", "b" + " " * 1_200_000, "x " + "\n\t" * 40_000 + " y", "é" * 60_000 + "\u3000" * 70_000 + "end"]
    got = bpe.decode(bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]).decode() for r in got] == texts
    assert [len(r["token_ids"]) for r in got[:2]] == [1_000_000, 1_200_001]
    for r, t in zip(got[2:], texts[2:], strict=True):
        assert r["token_ids"] == encoding.encode_ordinary(t)


def test_op1_ids_within_a_character(spark, encoding):
    ids = encoding.encode_ordinary("日本語")[:1]
    df = spark.createDataFrame([(ids,), (None,), ([],)], "token_ids array<int>")
    assert [None if r[0] is None else bytes(r[0]) for r in bpe.decode(df).select("decoded").collect()] == [encoding.decode_bytes(ids), None, b""]


def test_op1_keeps_other_columns(docs):
    got = bpe.decode(bpe.encode(docs))
    assert set(got.columns) == set(docs.columns) and got.schema["token_ids"].dataType.typeName() == "array"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_op2_edits_and_likeness(spark, folder, texts):
    order = sorted(texts, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = {}
    for r in fingerprint.op2_fingerprint(spark, folder).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(texts)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        r = next(x for x in got[i] if x["edited_sha256"] == sha(edited))
        assert r["n_chars"] == len(t)
        a, b = shingles(t), shingles(nxt)
        if a == b:
            assert r["near_next"] == 1
        elif not a or not b:
            assert r["near_next"] == 0
        elif len(a) > 300 and len(b) > 300:
            assert r["near_next"] == pytest.approx(len(a & b) / min(len(a), len(b)), abs=0.15)


def test_op2_merge_is_union():
    import pyarrow as pa

    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n))
    for n, m in ((90, 120), (300, 20), (200, 200), (900, 700)):
        a, b = words(n), words(m)
        one, two, none = fingerprint.sketches(pa.array([a, b, None]))
        both = shingles(a) | shingles(b)
        merged = fingerprint.merge(one, two)
        assert not len(none.hashes) and fingerprint.to_text(none) == "" and fingerprint.from_text("").scale == 1
        assert merged.scale == (1 if len(both) <= fingerprint.WHOLE else fingerprint.SCALE) and (merged.scale > 1 or len(merged.hashes) == len(both))
        assert merged.hashes.tolist() == np.union1d(one.at(merged.scale), two.at(merged.scale)).tolist()
        again = fingerprint.from_text(fingerprint.to_text(merged))
        assert again.scale == merged.scale and (again.hashes == merged.hashes).all()


def test_op2_short_excerpts():
    """Excerpts of documents of up to WHOLE shingles are found for certain, others as far as the common threshold has hashes of them."""
    import pyarrow as pa

    rng = random.Random(3)
    text = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    sketch = lambda words: fingerprint.sketches(pa.array([" ".join(words)]))[0]
    for _ in range(50):
        at = rng.randrange(150)
        assert fingerprint.containment(sketch(text[at : at + 7]), sketch(text[:200])) == 1
        at = rng.randrange(1900)
        part = sketch(text[at : at + 60])
        assert fingerprint.containment(part, sketch(text)) == float(len(part.at(fingerprint.SCALE)) > 0)


def test_op2_empty(spark, nothing):
    assert fingerprint.op2_fingerprint(spark, nothing).count() == 0


def test_op7_read_back(spark, folder, texts):
    tok = Tokenizer.from_file(tokenstore.TOKENIZER)
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for i, t in order:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert rows_of(tokenstore.op7_token_store(spark, folder)) == sorted(want, key=repr)


def test_op7_latin_words_need_the_model_alone():
    with open(tokenstore.TOKENIZER, encoding="utf-8") as f:
        enc = tokenstore.WordEncoder(f.read())
    tok, rng = enc.tokenizer, random.Random(11)

    def same(texts):
        raw = [t.encode() for t in texts]
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        ids, counts = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]

    latin = "".join(map(chr, [*range(33, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x180)]))
    other = "İªµº\u00a0\u0085×÷¼²\u0301Σςé日"
    for alphabet in (latin + "  \t\n", latin + other * 4 + "    ", "aES'stTlLvV|1. "):
        same(["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)])
    same(["", " ", "\n", "a", " a ", "İ", "|", "a|b ||  | x"])
    enc.tokenizer = None
    same(["".join(rng.choice(latin + "   ") for _ in range(60)).replace("<|", "") for _ in range(100)])


def test_op7_empty(spark, nothing):
    assert tokenstore.op7_token_store(spark, nothing).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_op7_same_as_the_library(spark, name):
    """Special tokens in any case, words that only a poor hash takes for one another, and a tokenizer that does not split at blanks."""
    path = public_tokenizers.path(name)
    turns = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rng = random.Random(7)
    texts = ["<|ENDOFTEXT|> <|EndOfText|> <|endoftext|>x <|endoftext|>", turns + " " + turns.translate({97: 98, 98: 97}), "a|b | don't ' s's 12,5", "e\u0301 x \u0301y a\u0085b"]
    texts += ["".join(rng.choice("aB|'s.1é\u0301 \t\n\u0085İΣσς<>endoftext-|") for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {}
    for r in tokenstore.write_shards(df, path).collect():
        keys, lengths, matrix = tokenstore.unpack(bytes(r["payload"]))
        ends = np.cumsum(lengths)
        found |= {k: matrix.ids()[e - n : e].tolist() for k, n, e in zip(keys.tolist(), lengths.tolist(), ends.tolist(), strict=True)}
    tok = Tokenizer.from_file(path)
    assert found == {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_op7_column_functions(spark, docs):
    shards = tokenstore.write_shards(docs.select("doc_id", "text"), shard_tokens=1 << 16)
    asked = shards.select("payload", "tokens", tokenstore.counted("payload", F.lit(1)).alias("n"), tokenstore.token_at("payload", F.lit(3)).alias("third"), tokenstore.occurrence("payload", F.lit(1), F.lit(1)).alias("second"), tokenstore.token_at("payload", F.col("tokens")).alias("past"))
    for r in asked.collect():
        ids = tokenstore.unpack(bytes(r["payload"]))[2].ids()
        ones = np.flatnonzero(ids == 1)
        assert (r["n"], r["third"], r["second"], r["past"]) == (len(ones), ids[3] if len(ids) > 3 else None, ones[1] if len(ones) > 1 else -1, None)


def test_op7_small_shards(spark, docs):
    shards = tokenstore.write_shards(docs.select("doc_id", "text"), shard_tokens=100)
    assert shards.count() > 3
    payload = shards.orderBy(F.desc("tokens")).first()["payload"]
    ids, lengths, matrix = tokenstore.unpack(bytes(payload))
    assert lengths.sum() == matrix.n and len(ids) == len(lengths)


def test_op7_wavelet_queries():
    a = np.random.default_rng(1).integers(0, 40, 2500)
    w = tokenstore.unpack(tokenstore.pack(np.array([5]), np.array([2500]), tokenstore.WaveletMatrix.build(a)))[2]
    assert (w.ids() == a).all() and [w[i] for i in range(0, 2500, 7)] == a[::7].tolist()
    for s in (0, 1, 17, 39, 50):
        assert w.count(s, 13, 2001) == (a[13:2001] == s).sum()
        assert [w.occurrence(s, k) for k in range((a == s).sum() + 1)] == [*np.flatnonzero(a == s).tolist(), -1]
    assert tokenstore.WaveletMatrix.build(np.zeros(0, int)).ids().tolist() == []


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) * (1 + j % 2) - 9 * (int(c) * (1 + j % 2) > 9) for j, c in enumerate(reversed(d)))
            if (k == 0, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), k == 2 and 12 <= len(d) <= 19 and total % 10 == 0, k == 3 and 9 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_op9_base_spans(spark, folder, texts):
    got = {}
    for r in pii.op9_pii(spark, folder).collect():
        got.setdefault(r["doc_id"], r)
    for i, t in texts:
        base = base_spans(t or "")
        said = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert got[i]["base_sha256"] == sha(",".join(said)) and set(said) <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == n for b in base) for n in range(4)]


def test_op9_random_texts():
    rng = random.Random(8)
    for _ in range(5000):
        t = "".join(rng.choice("ab1.@+- (5") for _ in range(40))
        assert pii.find(t) == base_spans(t)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail joe (at) exa-mple [dot] com now", "email", "joe (at) exa-mple [dot] com"),
        ("write joe.x at example dot org please", "email", "joe.x at example dot org"),
        ("to jоe@exаmple.com today", "email", "jоe@exаmple.com"),
        ("card ４１１１ １１１１ １１１１ １１１１ x", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("call plus one two three four five six seven eight nine zero now", "phone", "plus one two three four five six seven eight nine zero"),
        ("host ten 10․0․0․7 up", "ip", "10․0․0․7"),
    ],
)
def test_op9_disguises(text, kind, part):
    found = pii.find_all(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in found] == [(kind, part)]
    assert part not in pii.redact(text)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("to jоhn@example.com today", "email", "jоhn@example.com"),
        ("to john@example.cоm today", "email", "john@example.cоm"),
        ("host 10.0.0.1２ up", "ip", "10.0.0.1２"),
        ("call +44 20 7946 095８ now", "phone", "+44 20 7946 095８"),
        ("card 4111 1111 1111 111１ x", "card", "4111 1111 1111 111１"),
    ],
)
def test_op9_disguises_around_base_spans(text, kind, part):
    found = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find_all(text)]
    assert (kind, part) in found and set(pii.find(text)) <= set(pii.find_all(text)) and len(set(found)) == len(found)
    assert pii.redact(text) == text.replace(part, f"<{kind.upper()}>")


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("four" + " one" * 15, "card", "four" + " one" * 15),
        ("pay " + " ".join(["four two"] * 8), "card", " ".join(["four two"] * 8)),
        ("plus one nine one six six one six one six six one", "phone", "plus one nine one six six one six one six six one"),
        ("plus nıne nine ſix nine nine ſix nİne nine nine", "phone", "plus nıne nine ſix nine nine ſix nİne nine nine"),
        ("10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1"),
    ],
)
def test_op9_disguises_in_short_texts(text, kind, part):
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find_all(text)] == [(kind, part)]
    assert pii.redact(text) == text.replace(part, f"<{kind.upper()}>")


@pytest.mark.parametrize("text", ["look at the dot of it", "one two three", "meet me at noon dot", "price: 12 34 56", "Ελληνικά και русский текст"])
def test_op9_leaves_clean_texts(text):
    assert pii.find_all(text) == [] and pii.redact(text) == text


@pytest.mark.parametrize(
    ("text", "part"), [("host 192 dot 168 dot 1 dot 20 up", "192 dot 168 dot 1 dot 20"), ("see 10.0 DOT 0\tdot 1.", "10.0 DOT 0\tdot 1")]
)
def test_op9_said_addresses(text, part):
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find_all(text)] == [("ip", part)]


def test_op9_long_texts():
    """Numbers of thousands of digits, and runs that must not take a square's time."""
    import time

    assert pii.find("0" * 5000 + "1.1.1.1") == [(0, 1, 5007)] and pii.find("1" * 5000 + ".1.1.1") == []
    began = time.process_time()
    for t in (" " * 1_000_000 + "at", "x" + " " * 500_000 + "at dot" + " " * 500_000 + "[ at ]", "[" * 200_000 + " " * 200_000 + "(at)", "a@b.cc " * 30_000 + "(at)", "one-" * 100_000, "+" * 200_000 + "1" * 200_000):
        pii.find_all(t)
    assert time.process_time() - began < 60


def test_op9_empty(spark, nothing):
    assert pii.op9_pii(spark, nothing).count() == 0


def test_op10_held_out_accuracy(spark):
    got = langid.op10_language_id(spark, DATA)
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    both = got.join(truth, "doc_id").where("held_out")
    assert both.where("lang = lang_pred").count() >= 0.97 * both.count()


def test_op10_undecided(spark, folder, texts):
    got = {r["doc_id"]: r for r in langid.op10_language_id(spark, folder).collect()}
    for i, t in texts:
        held = zlib.crc32(str(i).encode()) % 3 == 1 if i is not None else None
        assert got[i]["held_out"] == held
        letters = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (not letters) and 0 <= got[i]["score"] <= 1


def test_op10_without_labels(spark, nothing, docs):
    assert langid.op10_language_id(spark, nothing).count() == 0
    model = langid.train(docs.where("false"), docs["text"], docs["lang"], docs["doc_id"])
    assert {r[0] for r in langid.predict(docs, model).select("language.lang_pred").collect()} == {"und"}


def test_op10_same_as_plain_counts(spark):
    """A plain count-and-log version in Python, on 200 rows."""
    import math

    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(200).select("doc_id", "text", "lang")
    model = langid.train(docs, F.col("text"), F.col("lang"), F.col("doc_id"))
    got = {r["doc_id"]: r["language"] for r in langid.predict(docs, model).collect()}
    rows = [r for r in docs.collect() if r["text"]]

    def grams(text):
        kept, word = [], False
        for c in text:
            if c.isalpha():
                kept.append(c.lower() if len(c.lower()) == 1 else c)
            elif word:
                kept.append(" ")
            word = c.isalpha()
        return [(n, "".join(kept[i : i + n])) for n in langid.ORDERS for i in range(len(kept) - n + 1)]

    def bucket(n, gram):
        acc = 0
        for c in gram:
            acc = (acc * 0x100000001B3 + ord(c)) % 2**64
        return ((acc + (n << 40)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - langid.BUCKETS.bit_length() + 1)

    langs = sorted({r["lang"] for r in rows if r["lang"]})
    counts, sizes = {k: [1] * langid.BUCKETS for k in langs}, {k: 0 for k in langs}
    for r in rows:
        if r["lang"]:
            sizes[r["lang"]] += 1
            for g in grams(r["text"]):
                counts[r["lang"]][bucket(*g)] += 1
    total = {k: sum(c) for k, c in counts.items()}
    for r in rows:
        if not any(c.isalpha() for c in r["text"]):
            continue
        own = [bucket(*g) for g in grams(r["text"])]
        score = {k: math.log(sizes[k] / sum(sizes.values())) + sum(math.log(counts[k][b] / total[k]) for b in own) for k in langs}
        best = max(langs, key=lambda k: score[k])
        share = 1 / sum(math.exp(min(0.0, score[k] - score[best])) for k in langs)
        assert got[r["doc_id"]]["lang_pred"] == best and got[r["doc_id"]]["score"] == pytest.approx(share, abs=1e-3)
