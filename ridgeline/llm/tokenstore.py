"""Operator 7: token ids in wavelet-matrix shards.

Documents are range-partitioned by id; each task encodes its documents, in ascending order, into shards of about
``SHARD_TOKENS`` ids. A shard is one compressed file body: a header, the documents' ids and lengths, and one bit-plane per
bit of the largest id. Each plane is compressed in blocks of ``PLANE_BLOCK`` bytes, with a directory of the blocks' places and of the
ones before every ``BLOCK`` bits, so that access, count and occurrence queries unpack one block a plane and none of the ids.
``token_at``, ``counted`` and ``occurrence`` ask them of a table of shards. Shards are written through Spark's own writer (one row a
shard), so any store that Spark can write will do.

Texts are cut at ASCII white space by Arrow, which numbers a batch's words too. Words, and the pattern's matches in those of Latin letters and ASCII signs, are
encoded once a worker and remembered, where the tokenizer is of the kind that drops white space before it merges (``splits_at_space`` looks at its file); with
any other, whole texts are encoded.

Defined results: null and empty texts hold the end id alone; repeated ids stay separate documents, in the order of their
texts; a null id comes first; no rows give no shards; a document longer than a shard gets a larger shard of its own.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, runs, small_batches, stored, table, texts_of

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
SHARD_TOKENS = 1 << 20
BLOCK = 512
PLANE_BLOCK = 1 << 12
MAX_WORDS, MAX_BYTES = 3 << 18, 1 << 26  # and as many units, that one Python worker remembers: some 200 MB
#: Fixed value: the pattern of the kind of tokenizer that is encoded word by word.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MAGIC = b"WVM2"
_BETWEEN = "|"
# letters that are letters in any version of Unicode, composed, each with one small letter; words of these and ASCII signs are split by the pattern here
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_LATIN = re.compile(f"[!-~{_LETTERS}]+")
_UNIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]| |[^ 0-9{_LETTERS}]+")


class Plane:
    """One bit-plane: bytes, in compressed blocks or plain, and the number of ones before every BLOCK bits."""

    def __init__(self, ranks: np.ndarray, blocks: list[bytes] | None = None, plain: np.ndarray | None = None):
        self.ranks, self.blocks, self.plain = ranks, blocks, plain

    @classmethod
    def of(cls, plain: np.ndarray) -> Plane:
        ones = np.bitwise_count(np.pad(plain, (0, -len(plain) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        return cls(np.concatenate([[0], np.cumsum(ones)]), plain=plain)

    def part(self, lo: int, hi: int) -> np.ndarray:
        """Bytes lo to hi, which lie in one block."""
        if self.plain is not None:
            return self.plain[lo:hi]
        k = lo // PLANE_BLOCK
        return np.frombuffer(_unpacked(self.blocks[k]), np.uint8)[lo - k * PLANE_BLOCK : hi - k * PLANE_BLOCK]

    def whole(self) -> np.ndarray:
        return self.plain if self.plain is not None else np.frombuffer(b"".join(map(_unpacked, self.blocks)), np.uint8)


def _unpacked(block: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(block)


class WaveletMatrix:
    """Bit-planes of an id sequence, highest bit first; each plane stably sorts zeros before ones for the next."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes
        self.zeros = [n - int(p.ranks[-1]) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        at = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for b in range(bits - 1, -1, -1):
            one = (at >> b & 1).astype(bool)
            planes.append(Plane.of(np.packbits(one)))
            at = np.concatenate([at[~one], at[one]])
        return cls(len(ids), planes)

    def _rank1(self, k: int, i: int) -> int:
        block = i // BLOCK
        if not i % BLOCK:
            return int(self.planes[k].ranks[block])
        tail = self.planes[k].part(block * (BLOCK // 8), -(-i // 8)).copy()
        if i % 8:
            tail[-1] &= 0xFF << (8 - i % 8) & 0xFF
        return int(self.planes[k].ranks[block]) + int(np.bitwise_count(tail).sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, plane in enumerate(self.planes):
            one = plane.part(i >> 3, (i >> 3) + 1)[0] >> (7 - (i & 7)) & 1
            value = value << 1 | int(one)
            r = self._rank1(k, i)
            i = self.zeros[k] + r if one else i - r
        return value

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the symbol's occurrences in [lo, hi) stand after the last plane."""
        if symbol >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if symbol >> (len(self.planes) - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def occurrence(self, symbol: int, nth: int) -> int:
        """Position of the symbol's nth occurrence (from 0); -1 where there are fewer."""
        a, b = self._range(symbol, 0, self.n)
        at = a + nth
        if nth < 0 or at >= b:
            return -1
        for k in range(len(self.planes) - 1, -1, -1):
            one = symbol >> (len(self.planes) - 1 - k) & 1
            at = self._select(k, one, at - self.zeros[k] if one else at)
        return at

    def _select(self, k: int, bit: int, nth: int) -> int:
        ones = self.planes[k].ranks
        have = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(have, nth, "right")) - 1
        bits = np.unpackbits(self.planes[k].part(block * (BLOCK // 8), (block + 1) * (BLOCK // 8)))[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[nth - have[block]])

    def ids(self) -> np.ndarray:
        """All ids, by undoing the planes' sorts from the last to the first."""
        dtype = np.uint16 if len(self.planes) <= 16 else np.uint32
        at = np.zeros(self.n, dtype)
        for b, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            one = np.unpackbits(plane.whole(), count=self.n).view(bool)
            above = np.empty(self.n, dtype)
            above[~one], above[one] = at[:zeros], at[zeros:] | dtype(1 << b)
            at = above
        return at


def pack(doc_ids: np.ndarray, lengths: np.ndarray, matrix: WaveletMatrix) -> bytes:
    """Header, documents, then each plane's directory (ones before every BLOCK bits, sizes of blocks) and blocks."""
    deflate = zstandard.ZstdCompressor(level=1).compress
    docs = deflate(doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes())
    out = [_MAGIC, struct.pack("<QQBI", matrix.n, len(doc_ids), len(matrix.planes), len(docs)), docs]
    for plane in matrix.planes:
        raw = plane.whole().tobytes()
        blocks = [deflate(raw[a : a + PLANE_BLOCK]) for a in range(0, len(raw), PLANE_BLOCK)]
        ranks = deflate(plane.ranks.astype("<u4" if matrix.n < 2**32 else "<u8").tobytes())
        out += [struct.pack("<II", len(ranks), len(blocks)), ranks, np.array([len(b) for b in blocks], "<u4").tobytes(), *blocks]
    return b"".join(out)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """The documents, and the matrix with its planes still compressed."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a shard")
    n, docs, planes, size = struct.unpack_from("<QQBI", payload, 4)
    at = 4 + struct.calcsize("<QQBI")
    listed = np.frombuffer(_unpacked(payload[at : at + size]), "<i8")
    at += size
    out = []
    for _ in range(planes):
        size, blocks = struct.unpack_from("<II", payload, at)
        at += 8
        ranks = np.frombuffer(_unpacked(payload[at : at + size]), "<u4" if n < 2**32 else "<u8").astype(np.int64)
        at += size
        ends = at + 4 * blocks + np.concatenate([[0], np.cumsum(np.frombuffer(payload, "<u4", blocks, at), dtype=np.int64)])
        out.append(Plane(ranks, [payload[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]))
        at = int(ends[-1])
    return listed[:docs], listed[docs:], WaveletMatrix(n, out)


def splits_at_space(spec: str) -> bool:
    """Is this a tokenizer of which no match and no merge goes across ASCII white space? Its file must be of a known kind: composed
    characters, white space to blanks, lower case; matches of a pattern, without white space, as bytes; BPE."""
    j = json.loads(spec)
    normal = (j.get("normalizer") or {}).get("normalizers") or [j.get("normalizer") or {}]
    split = (j.get("pre_tokenizer") or {}).get("pretokenizers") or [j.get("pre_tokenizer") or {}]
    known = all(x.get("type") in (None, "NFC", "Lowercase") or x == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for x in normal)
    first, *rest = split
    dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first.get("pattern") == {"Regex": PATTERN}
    plain = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in rest)
    special = all(not any(x[k] for k in ("lstrip", "rstrip", "single_word")) and not any(c.isspace() for c in x["content"]) for x in j.get("added_tokens", ()))
    return bool(known and dropped and plain and special and j["model"]["type"] == "BPE" and not j.get("truncation") and not j["model"].get("dropout"))


def _byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _roomy(values: np.ndarray, n: int) -> np.ndarray:
    """The values, in an array that has room for n."""
    return values if n <= len(values) else np.concatenate([values, np.zeros(max(n - len(values), len(values)), values.dtype)])


class _Memo(dict):
    """Strings in the order in which they were first asked for, and the ids of those that are learnt."""

    def __init__(self):
        super().__init__()
        self.new: list = []
        self.held = 0
        self.known, self.used = 0, 0  # strings and ids; the arrays have room for more
        self.begin, self.size, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)

    def __missing__(self, word) -> int:
        place = len(self)
        self.new.append(word)
        self.held += len(word)
        self[word] = place
        return place

    def learn(self, *parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """The ids of the new strings: which of them, their numbers of ids, and those one after another."""
        self.begin, self.size = _roomy(self.begin, len(self)), _roomy(self.size, len(self))
        for which, sizes, ids in parts:
            self.begin[self.known + which], self.size[self.known + which] = self.used + np.cumsum(sizes) - sizes, sizes
            self.ids = _roomy(self.ids, self.used + len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        self.known, self.new = len(self), []

    def all_ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at these places, one after another, and where each one's end."""
        size = self.size[places]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.begin[places] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends


class WordEncoder:
    """Encode texts word by word, remembering words by their bytes; or whole texts, where words can't be told apart.

    A word is what stands between ASCII white space. A word of Latin letters and ASCII signs is small letters and matches of the pattern (each is merged by
    itself), which need the tokenizer's model alone; other words are left to the whole tokenizer. Texts in which a special token may stand are encoded whole."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(spec)
        self.by_word = splits_at_space(spec)
        between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        # a sign of which the id, with its word end, is its own and no part of any other word's
        self.by_word, self.between = self.by_word and len(between) == 1, between[0] if between else None
        self.merges = Tokenizer(self.tokenizer.model)  # without steps before it
        self.merges.pre_tokenizer = WhitespaceSplit()
        j = json.loads(spec)
        steps = (j.get("normalizer") or {}).get("normalizers") or [j.get("normalizer") or {}]
        self.small = any(x.get("type") == "Lowercase" for x in steps)
        byte_level = [x for x in (j.get("pre_tokenizer") or {}).get("pretokenizers", ()) if x.get("type") == "ByteLevel"]
        self.latin = self.by_word and len(byte_level) == 1 and self.merges.encode(_BETWEEN).ids == between
        self.signs = _byte_signs()
        self.words, self.units = _Memo(), _Memo()

    def _whole(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _each(self, new: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of strings, many at once with a word between them that none of them can give; those with its sign in them one by one."""
        apart = [u for u in new if _BETWEEN in u]
        one_by_one = dict(zip(apart, self._whole(apart, tokenizer), strict=True))
        lines = [f" {_BETWEEN} ".join("" if u in one_by_one else u for u in new[a : a + 1000]) for a in range(0, len(new), 1000)]
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for a, got in zip(range(0, len(new), 1000), self._whole(lines, tokenizer), strict=True):
            cuts = np.flatnonzero(got == self.between)
            size = np.diff(np.concatenate([[-1], cuts, [len(got)]])) - 1
            got = got[got != self.between]
            for k in [k for k, u in enumerate(new[a : a + 1000]) if u in one_by_one] if one_by_one else ():
                at, own = int(size[:k].sum()), one_by_one[new[a + k]]
                got, size[k] = np.concatenate([got[:at], own, got[at:]]), len(own)
            sizes.append(size)
            ids.append(got)
        return np.concatenate(sizes), np.concatenate(ids)

    def _learn(self) -> None:
        """Encode new words: Latin ones by their units, of which new ones pass through the merges, others through the whole tokenizer."""
        new = [w.decode("utf-8", "replace") for w in self.words.new]
        latin = np.fromiter((self.latin and _LATIN.fullmatch(w) is not None for w in new), bool, len(new))
        line = "".join([w + " " for w, own in zip(new, latin.tolist(), strict=True) if own])
        found = _UNIT.findall(line.lower() if self.small else line)
        places = np.fromiter(map(self.units.__getitem__, found), np.int64, len(found))
        if self.units.new:
            signs = [u if u.isascii() else u.encode().decode("latin-1").translate(self.signs) for u in self.units.new]
            self.units.learn((np.arange(len(signs)), *self._each(signs, self.merges)))
        ids, ends = self.units.all_ids(places)
        sizes = np.diff(np.append(0, ends[places == self.units.get(" ", -1)]))  # a blank ends a word and has no ids
        others = [w for w, own in zip(new, latin.tolist(), strict=True) if not own]
        self.words.learn((np.flatnonzero(latin), sizes, ids), (np.flatnonzero(~latin), *self._each(others)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and each row's number of ids."""
        raw = data[offsets[0] : offsets[-1]]
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(raw)])
        if self.by_word and b"<|" not in memoryview(raw).tobytes():
            return self._by_word(texts)
        ids: list = [None] * len(texts)
        apart = [k for k, t in enumerate(texts) if not self.by_word or b"<|" in t.as_py()]
        for k, got in zip(apart, self._whole([texts[k].as_py().decode("utf-8", "replace") for k in apart]), strict=True):
            ids[k] = got
        ids = [self._by_word(texts.slice(k, 1))[0] if x is None else x for k, x in enumerate(ids)]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.array([len(x) for x in ids], np.int64)

    def _by_word(self, texts: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > MAX_WORDS or self.words.held > MAX_BYTES:
            self.words = _Memo()
        if len(self.units) > MAX_WORDS or self.units.held > MAX_BYTES:
            self.units = _Memo()
        split = pc.ascii_split_whitespace(texts.view(pa.large_string()))  # with empty words at the ends, that have no ids
        numbered = split.flatten().dictionary_encode()
        distinct = numbered.dictionary.view(pa.large_binary()).to_pylist()
        places = np.fromiter(map(self.words.__getitem__, distinct), np.int64, len(distinct))
        if self.words.new:
            self._learn()
        ids, ends = self.words.all_ids(places[numbered.indices.to_numpy()])
        first = split.offsets.to_numpy()
        return ids, np.diff(np.concatenate([[0], ends])[first - first[0]])


@lru_cache(maxsize=2)
def word_encoder(spec: str) -> WordEncoder:
    return WordEncoder(spec)


def write_shards(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shards in ascending doc_id order to the shared folder.

    Returns the shards' table as read back: part int, shard int, tokens long, payload binary."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file, a few MB
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = word_encoder(spec.value), TaskContext.get().partitionId(), 0
        doc_ids, lengths, ids, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            payload = pack(np.concatenate(doc_ids), np.concatenate(lengths), WaveletMatrix.build(whole))
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "tokens": len(whole), "payload": payload}], schema)

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            keys = batch.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            for i, j in runs(offsets, min(4 << 20, 4 * shard_tokens)):
                got, n = enc.encode(data, offsets[i : j + 1])
                doc_ids.append(keys[i:j])
                lengths.append(n + 1)
                ids.append(np.insert(got, np.cumsum(n), end_id).astype(np.uint32))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield out()
                    doc_ids, lengths, ids, held, shard = [], [], [], 0, shard + 1
        if ids:
            yield out()

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("tokens", pa.int64()), ("payload", pa.binary())])
    ranged = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ranged.mapInArrow(shards, "part int, shard int, tokens long, payload binary"), "token-shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """Every document of the shards: part, shard, doc_id, start (ids before it in its shard), n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, payload in zip(*(batch.column(k) for k in ("part", "shard", "payload")), strict=True):
                keys, lengths, matrix = unpack(payload.as_py())
                raw, ends = memoryview(matrix.ids().astype("<u4").view(np.uint8)), np.cumsum(lengths)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(part, len(keys)), pa.repeat(shard, len(keys)), pa.array(keys, mask=keys == -(2**63)), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(documents, "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long")


def _asked(returns: T.DataType, ask) -> Column:
    """A column function of payloads and arguments that asks each shard."""

    @F.arrow_udf(returns)
    def answer(payloads: pa.Array, *arguments: pa.Array) -> pa.Array:
        out = []
        for payload, *values in zip(payloads, *arguments, strict=True):
            given = [v.as_py() for v in values]
            out.append(None if payload.as_py() is None or None in given else ask(unpack(payload.as_py())[2], *given))
        return pa.array(out, pa.int64())

    return answer


def token_at(payload: Column | str, position: Column | str) -> Column:
    """The id at a place of a shard (null outside of it)."""
    return _asked(T.LongType(), lambda m, i: m[i] if 0 <= i < m.n else None)(payload, position)


def counted(payload: Column | str, symbol: Column | str) -> Column:
    """How often an id occurs in a shard."""
    return _asked(T.LongType(), lambda m, x: m.count(x))(payload, symbol)


def occurrence(payload: Column | str, symbol: Column | str, nth: Column | str) -> Column:
    """The place of an id's nth occurrence in a shard, from 0 (-1: there are fewer)."""
    return _asked(T.LongType(), lambda m, x, n: m.occurrence(x, n))(payload, symbol, nth)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids and read each document back from the shards, with its place in the whole sequence."""
    shards = write_shards(texts_of(table(spark, sf_dir, "documents")))
    before, total = {}, 0
    for r in shards.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect():  # a row for each range partition
        before[r["part"]], total = total, total + r["n"]
    offsets = spark.createDataFrame(list(before.items()), "part int, part_start long")
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a few shards a part
    within = shards.select("part", "shard", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("shard_start"))
    starts = within.join(offsets, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("before"))
    done = read_documents(shards.select("part", "shard", "payload")).join(starts, ["part", "shard"])
    return done.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
