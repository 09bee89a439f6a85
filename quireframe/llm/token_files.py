"""Token ids in compressed shard files: one wavelet matrix per shard.

Documents are dealt out by ranges of ``doc_id`` and sorted, so shards follow one another in ascending order.  Each shard
holds about ``SHARD`` ids, a document never being cut: a header, the documents' ids and lengths, and one bit-plane per
bit of the largest token.  From an unpacked shard any token can be read (``access``), counted (``rank``) and located
(``select``); ``all`` undoes the planes for a whole shard.

Missing: the file stores no rank marks (the first ``rank`` makes them for every plane), reading anything decompresses the
whole shard, and no Spark function counts or locates a token over the table of shards.

The files are written by Spark itself as binary cells of a Parquet table in a folder that all machines share, so a lost
executor's shards are written anew and nothing is left half-written.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` comes first; rows with one id are ordered by a
hash of their text; an empty table gives no shards and no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireframe.llm.tables import stored

SHARD = 1 << 20
MAGIC = b"WVM1"
#: Bits between two rank marks.
MARK = 512
KEPT_LENGTH, KEPT_WORDS, KEPT_PIECES = 40, 700_000, 700_000
#: Characters whose lower case, composition and class are the same in every library: printable ASCII and precomposed Latin.
PLAIN = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)])) - {"İ"}
#: The pre-tokenizer's pattern (fixed value of the tokenizer file).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, all others take the code points from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}


BYTE_CHARACTERS = byte_characters()


class Tokens(dict):
    """A mapping from words between ASCII white space to the bytes of their ids (uint32), which fills itself from the library."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.split = regex.compile(PIECE).findall
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def __missing__(self, word: str) -> bytes:
        if PLAIN.issuperset(word) and "<|" not in word:
            out, low = b"", word.lower()
            for piece in (low,) if low.isalpha() else self.split(low):
                got = self.pieces.get(piece)
                if got is None:
                    # printable ASCII is its own byte-level form; of other pieces each byte becomes one character
                    form = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_CHARACTERS)
                    ids = [x.id for x in self.model.tokenize(form)]
                    got = struct.pack(f"<{len(ids)}I", *ids)
                    if len(piece) <= KEPT_LENGTH:
                        if len(self.pieces) >= KEPT_PIECES:
                            self.pieces.clear()
                        self.pieces[piece] = got
                out += got
        else:
            out = self.encode(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = out
        return out

    def ids(self, text: str) -> np.ndarray:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint32)


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


class WaveletMatrix:
    """Bit-planes from the highest bit down; each plane puts zeros before ones, both in their old order."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]) -> None:
        self.n, self.planes, self.zeros = n, planes, zeros  # planes: packed bits
        self.marks: list[np.ndarray] = []

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        levels = max(1, int(ids.max()).bit_length()) if ids.size else 1
        a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(levels - 1, -1, -1):
            bit = (a >> level) & 1 == 1
            planes.append(np.packbits(bit))
            low = np.compress(~bit, a)
            zeros.append(low.size)
            a = np.concatenate([low, np.compress(bit, a)])
        return cls(ids.size, planes, zeros)

    def all(self) -> np.ndarray:
        """All ids in order, by undoing the planes from the last to the first."""
        a = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, (plane, z) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            bit = np.unpackbits(plane, count=self.n).view(bool)
            a[z:] |= a.dtype.type(1 << level)
            b = np.empty_like(a)
            b[np.flatnonzero(~bit)] = a[:z]
            b[np.flatnonzero(bit)] = a[z:]
            a = b
        return a.astype(np.uint32)

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane: the mark before it, and the bits since."""
        if not self.marks:
            for p in self.planes:
                per = np.add.reduceat(np.unpackbits(p), np.arange(0, p.size * 8, MARK), dtype=np.int64) if p.size else np.zeros(0, np.int64)
                self.marks.append(np.concatenate([[0], np.cumsum(per)]))
        m = i // MARK
        rest = np.unpackbits(self.planes[level][m * MARK // 8 : -(-i // 8)])[: i - m * MARK]
        return int(self.marks[level][m]) + int(rest.sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def access(self, i: int) -> int:
        v = 0
        for level, z in enumerate(self.zeros):
            b, ones = self._bit(level, i), self._ones(level, i)
            v = v << 1 | b
            i = z + ones if b else i - ones
        return v

    def rank(self, token: int, i: int) -> int:
        """How often the token stands before position i."""
        if token >> len(self.zeros):
            return 0
        a = 0
        for level, z in enumerate(self.zeros):
            x, y = self._ones(level, a), self._ones(level, i)
            a, i = (z + x, z + y) if token >> (len(self.zeros) - 1 - level) & 1 else (a - x, i - y)
        return i - a

    def select(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0); -1 if there is none."""
        if k < 0 or k >= self.rank(token, self.n):
            return -1
        low, high = 0, self.n - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.rank(token, mid + 1) > k else (mid + 1, high)
        return low

    def dump(self) -> bytes:
        head = struct.pack("<II", self.n, len(self.planes)) + np.array(self.zeros, "<u4").tobytes()
        return head + b"".join(p.tobytes() for p in self.planes)

    @classmethod
    def load(cls, data: bytes) -> WaveletMatrix:
        n, levels = struct.unpack_from("<II", data)
        zeros = np.frombuffer(data, "<u4", levels, 8)
        size, at = -(-n // 8), 8 + 4 * levels
        return cls(n, [np.frombuffer(data, np.uint8, size, at + i * size) for i in range(levels)], [int(z) for z in zeros])


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One shard file."""
    import zstandard

    known = np.array([i is not None for i in doc_ids], np.uint8)
    head = struct.pack("<I", len(doc_ids)) + known.tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array([x.size for x in ids], "<u4").tobytes()
    body = WaveletMatrix.build(np.concatenate(ids)).dump()
    return MAGIC + struct.pack("<I", len(head)) + zstandard.ZstdCompressor(level=1).compress(head + body)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """The documents' ids, their lengths and the matrix of a shard file."""
    import zstandard

    if data[:4] != MAGIC:
        raise ValueError("not a token shard")
    size = struct.unpack_from("<I", data, 4)[0]
    raw = zstandard.ZstdDecompressor().decompress(data[8:])
    n = struct.unpack_from("<I", raw)[0]
    known = np.frombuffer(raw, np.uint8, n, 4)
    ids = np.frombuffer(raw, "<i8", n, 4 + n)
    return [int(i) if k else None for i, k in zip(ids, known)], np.frombuffer(raw, "<u4", n, 4 + 9 * n).astype(np.int64), WaveletMatrix.load(raw[size:])


def write(docs: DataFrame, tokenizer: str, end: int, shard: int = SHARD) -> DataFrame:
    """The table of shard files (part, seq, documents, tokens, data): in order of part, then seq, documents ascend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, seq = tokens(tokenizer), TaskContext.get().partitionId(), 0
        tail = np.array([end], np.uint32)
        names, ids, held = [], [], 0

        def shard_row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "documents": pa.array([len(names)], pa.int64()), "tokens": pa.array([held], pa.int64()), "data": pa.array([pack(names, ids)], pa.binary())})

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                for name, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    x = np.concatenate([t.ids(text), tail]) if text else tail
                    if names and held + x.size > shard:
                        yield shard_row()
                        seq, names, ids, held = seq + 1, [], [], 0
                    names.append(name)
                    ids.append(x)
                    held += x.size
        if names:
            yield shard_row()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return stored(d.mapInArrow(run, "part int, seq int, documents long, tokens long, data binary"), "token-shards")


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*(batch.column(c) for c in ("part", "seq", "data"))):
                names, sizes, matrix = unpack(data.as_py())
                ids = matrix.all().astype("<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends, sizes)]
                yield pa.RecordBatch.from_pydict({"part": pa.array([part.as_py()] * len(names), pa.int32()), "seq": pa.array([seq.as_py()] * len(names), pa.int32()), "doc_id": pa.array(names, pa.int64()),
                                                  "within": pa.array(ends - sizes), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64())})

    rows = shards.select("part", "seq", "data").mapInArrow(run, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    # offsets in two steps: of parts (one row for each writing task), and of shards within a part
    ahead = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", ahead(Window.orderBy("part")).alias("before"))
    starts = shards.select("part", "seq", ahead(Window.partitionBy("part").orderBy("seq")).alias("inside")).join(parts, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("first"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
