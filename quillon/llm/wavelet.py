"""Token-id output as wavelet matrices, one for each shard.

Documents are dealt by ranges of doc_id, encoded in order and cut into shards of about a million ids. A shard's file
holds the documents' ids and lengths and one wavelet matrix: a bit-plane for each bit of an id, most significant
first, each plane's order split stably by the plane before, with a directory of ranks. From it alone single ids are
read, counted (rank), located (select) and whole documents decoded. The files are rows of a Parquet table
in the shared folder, written by Spark's committer, so a lost task leaves none of its own behind.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.shared import pieces, slices, written
from quillon.llm.words import span_hash

SHARD_IDS = 1 << 20
#: Characters of a part, at least and at most: parts grow with the corpus, so that their number does not grow as fast. A part is encoded as a stream of shards.
PART_CHARS, PARTS = (8_000_000, 256_000_000), 20_000
END_ID = 1
_MAGIC = b"QWM1"
_RANK = 2048


class WaveletMatrix:
    """Succinct sequence of non-negative integers below 2**bits."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def of(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        x, zeros, planes, ranks = values.astype(np.uint16 if bits <= 16 else np.uint32), [], [], []
        for level in range(bits - 1, -1, -1):
            one = (x >> level & 1).astype(bool)
            plane = np.packbits(one)
            planes.append(plane)
            ones = np.add.reduceat(np.bitwise_count(plane).astype(np.uint32), np.arange(0, len(plane), _RANK // 8)) if len(plane) else np.empty(0, np.uint32)
            ranks.append(np.concatenate(([0], np.cumsum(ones))).astype(np.uint32))
            low, high = x[~one], x[one]
            zeros.append(len(low))
            x = np.concatenate((low, high))
        return cls(len(values), bits, zeros, planes, ranks)

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [_MAGIC, struct.pack("<QB", self.n, self.bits)]
        for zeros, plane, rank in zip(self.zeros, self.planes, self.ranks):
            a, b = pack(plane.tobytes()), pack(rank.tobytes())
            parts += [struct.pack("<QII", zeros, len(a), len(b)), a, b]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        if blob[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, bits = struct.unpack_from("<QB", blob, 4)
        at, zeros, planes, ranks, unpack = 13, [], [], [], zstandard.ZstdDecompressor().decompress
        for _ in range(bits):
            z, a, b = struct.unpack_from("<QII", blob, at)
            at += 16
            zeros.append(z)
            planes.append(np.frombuffer(unpack(blob[at : at + a]), np.uint8))
            ranks.append(np.frombuffer(unpack(blob[at + a : at + a + b]), np.uint32))
            at += a + b
        return cls(n, bits, zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones of the plane before place i."""
        block = i // _RANK
        plane, at = self.planes[level], block * _RANK // 8
        whole = int(np.bitwise_count(plane[at : i // 8]).sum())
        rest = int(plane[i // 8] >> (8 - i % 8)).bit_count() if i % 8 else 0
        return int(self.ranks[level][block]) + whole + rest

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def rank(self, value: int, i: int) -> int:
        """Occurrences of the value before place i."""
        if value >> self.bits:
            return 0
        a, b = 0, min(i, self.n)
        for level in range(self.bits):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if value >> (self.bits - 1 - level) & 1 else (a - x, b - y)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of the value, or -1."""
        if value >> self.bits or not 0 <= k < self.count(value):
            return -1
        a = 0
        for level in range(self.bits):
            x = self._ones(level, a)
            a = self.zeros[level] + x if value >> (self.bits - 1 - level) & 1 else a - x
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            one = bool(value >> (self.bits - 1 - level) & 1)
            need = i - self.zeros[level] if one else i
            lo, hi = 0, self.n - 1  # the place of this plane's bit number `need`
            while lo < hi:
                mid = (lo + hi) // 2
                ones = self._ones(level, mid + 1)
                if (ones if one else mid + 1 - ones) > need:
                    hi = mid
                else:
                    lo = mid + 1
            i = lo
        return i

    def find(self, values: list[int]) -> list[int]:
        """Places where the sequence of values starts: the rarest of them is located, the others are read beside it."""
        if not values:
            return []
        rare = min(range(len(values)), key=lambda k: self.count(values[k]))
        places = (self.select(values[rare], k) - rare for k in range(self.count(values[rare])))
        return [p for p in places if p >= 0 and p + len(values) <= self.n and all(self.access(p + k) == v for k, v in enumerate(values))]

    def decode(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            up = np.empty_like(x)
            up[~one] = x[: self.zeros[level]]
            up[one] = x[self.zeros[level] :] | x.dtype.type(1 << (self.bits - 1 - level))
            x = up
        return x


#: Letters and numbers below U+0250; texts of these, of other printable characters there and of plain white space, but no apostrophe, are split here, others by the library.
_LETTER, _NUMBER = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ɏ]*")
#: The library's pattern that is known here (without an apostrophe it leaves the runs of Encoder._words); a tokenizer with another one is used as it is.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


_KIND = np.zeros(0x250, np.uint8)  # 0 space, 1 letter, 2 number (each alone), 3 other
_LOWER = np.zeros(0x250, np.uint16)
for _c in range(0x250):
    _KIND[_c] = 0 if chr(_c) in "\t\n\r " else 1 if re.match(f"[{_LETTER}]", chr(_c)) else 2 if re.match(f"[{_NUMBER}]", chr(_c)) else 3
    _LOWER[_c] = ord(chr(_c).lower()[0])


class Encoder:
    """Ids of whole texts as the tokenizers library gives them; each distinct word is encoded by it once and kept."""

    #: Ids of known words that are kept, and slots for the words; a word takes the slot that its hash says.
    KEEP, SLOT_BITS = 8_000_000, 21

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.fast = splits[0].get("pattern") == {"Regex": _KNOWN} and [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.bits = max(1, max(self.whole.get_vocab_size() - 1, END_ID).bit_length())
        self.word = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": splits[-1], "added_tokens": []})) if self.fast else None
        self.key, self.used, self.flat = np.zeros(1 << self.SLOT_BITS, np.uint64), 0, np.empty(0, "<u4")
        self.at, self.size = np.zeros(1 << self.SLOT_BITS, np.int32), np.zeros(1 << self.SLOT_BITS, np.int32)

    def _plain(self, text: str) -> bool:
        return self.fast and "'" not in text and _PLAIN.fullmatch(text) is not None and not any(x in text for x in self.special)

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        """Of plain texts: runs of letters or of other signs and single numbers, found at once for all texts."""
        raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-16-le"), np.uint16)
        low, kind = _LOWER[raw], _KIND[raw]
        cut = np.flatnonzero((np.diff(kind, prepend=0) != 0) | (kind == 2))
        word = np.flatnonzero(kind[cut])
        start, end = cut[word], np.append(cut, len(raw))[word + 1]
        key = span_hash(low, start, end)
        slot = (key >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        if self.used > self.KEEP:  # begin anew
            self.key[:], self.used = 0, 0
        new = np.flatnonzero(self.key[slot] != key)
        times, base = self.size[slot], self.at[slot]
        if len(new):
            known, first, place = np.unique(key[new], return_index=True, return_inverse=True)
            first = new[first]
            said = [low[a:b].tobytes().decode("utf-16-le") for a, b in zip(start[first].tolist(), end[first].tolist())]
            ids = [e.ids for e in self.word.encode_batch_fast(said, add_special_tokens=False)]
            size = np.fromiter(map(len, ids), np.int32, len(ids))
            more = np.fromiter(chain.from_iterable(ids), "<u4", int(size.sum()))
            if self.used + len(more) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.empty(max(len(more), self.KEEP // 4), "<u4")))
            begin = self.used + np.cumsum(size, dtype=np.int32) - size
            self.flat[self.used : self.used + len(more)] = more
            self.used += len(more)
            own = slot[first]
            self.key[own], self.at[own], self.size[own] = known, begin, size
            times[new], base[new] = size[place], begin[place]
        ends = np.cumsum(times, dtype=np.int32)
        out = self.flat[np.repeat(base - (ends - times), times) + np.arange(ends[-1], dtype=np.int32)] if len(key) else np.empty(0, "<u4")
        edge = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        stop = np.concatenate(([0], ends))[edge].tolist()
        return [out[a:b] for a, b in zip([0, *stop[:-1]], stop)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and self._plain(t)]
        for i, x in zip(plain, self._words([texts[i] for i in plain]) if plain else ()):
            out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.whole.encode_batch_fast([texts[i] or "" for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4")
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


SHARDS = "part int, seq int, doc_ids array<long>, lengths array<long>, n_ids long, file binary"


def _writer(path: str, end_id: int, shard_ids: int):
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
    names = ["part", "seq", "doc_ids", "lengths", "n_ids", "file"]

    def run(batches):
        from pyspark import TaskContext

        code, part, seq, ids, held, size = encoder(path), TaskContext.get().partitionId(), 0, [], [], 0

        def shard():
            row = (part, seq, ids, [len(x) for x in held], size, WaveletMatrix.of(np.concatenate(held), max(code.bits, int(end_id).bit_length())).to_bytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

        for batch in pieces(batches):
            texts, docs = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices(texts):
                for d, x in zip(docs[a:b], code.encode(texts[a:b])):
                    ids.append(d)
                    held.append(np.append(x, np.uint32(end_id)))
                    size += len(x) + 1
                    if size >= shard_ids:
                        yield shard()
                        seq, ids, held, size = seq + 1, [], [], 0
        if held:
            yield shard()

    return run


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, part_chars: int | None = None) -> DataFrame:
    """A table of shards in ascending order of doc_id: part and seq (their order), doc_ids, lengths (ids of each document, with
    end_id after it), n_ids and file, the wavelet matrix.

    Null and empty texts give end_id alone. A null doc_id comes first; equal doc_ids follow each other by a hash of their text;
    repeated rows are written as often as they occur. Texts are encoded whole; only doc_id and text are read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    part_chars = part_chars or min(PART_CHARS[1], max(PART_CHARS[0], chars // PARTS))
    # rows that are alike in everything may go to any of the parts in which they fall
    dealt = own.repartitionByRange(-(-chars // part_chars) or 1, "doc_id", "tie", F.monotonically_increasing_id()).sortWithinPartitions("doc_id", "tie", "text")
    return written(dealt.select("doc_id", "text").mapInArrow(_writer(tokenizer, end_id, shard_ids), SHARDS), "shards")


def _reader(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = WaveletMatrix.from_bytes(row["file"]).decode().astype("<u4")
            ends = np.cumsum(row["lengths"]).tolist()
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, row["lengths"])]
            n = len(ends)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([row["part"]] * n, pa.int32()), "seq": pa.array([row["seq"]] * n, pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "at": pa.array([e - k for e, k in zip(ends, row["lengths"])], pa.int64()), "n_tokens": pa.array(row["lengths"], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            )


def read_shards(shards: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32 (of the decoded ids, as
    little-endian 32-bit integers)."""
    found = shards.select("part", "seq", "doc_ids", "lengths", "file").mapInArrow(_reader, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(W.orderBy("part")).alias("base"))
    own = shards.select("part", "seq", before(W.partitionBy("part").orderBy("seq")).alias("own"))
    base = own.join(parts, "part").select("part", "seq", (F.col("own") + F.col("base")).alias("base"))
    return found.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
