"""Token ids as wavelet matrices: one succinct, compressed file image per shard.

Spark writes the images as binary cells of a Parquet table, so that they land on any store and
a lost task is simply run again. An image is complete in itself: ``Shard.load`` serves token
access, counting and occurrence lookup from its bit planes, each opened when first read, by rank
and select on stored block counts, without decoding the sequence.

Image: ``TLWM`` | version u8 | planes u8 | tokens u64 | documents u64 | tokens before it in its
part u64 | then length-prefixed zstd frames: document ids (i64), null flags (u8), document
lengths (u32), ones before each plane block (u32), and one frame per plane, highest bit first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.byte_bpe import encoder
from tideline.llm.common import text_of

MAGIC = b"TLWM"
HEAD = "<4sBBQQQ"
BLOCK = 512
SHARD_TOKENS = 1 << 20
FILES = "part int, shard int, n_tokens long, image binary"

_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class PackedPlanes(Sequence):
    """Bit planes that stay compressed until they are first read."""

    def __init__(self, frames: list[bytes]):
        self.frames, self.opened = frames, {}

    def __len__(self) -> int:
        return len(self.frames)

    def __getitem__(self, level: int) -> np.ndarray:
        if level not in self.opened:
            self.opened[level] = np.frombuffer(zstandard.decompress(self.frames[level]), np.uint8)
        return self.opened[level]


class WaveletMatrix:
    """A sequence of unsigned ids as bit planes, each stably parted by its bits."""

    def __init__(self, n: int, planes: Sequence[np.ndarray], ones: np.ndarray | None = None):
        self.n, self.planes = n, planes
        per = BLOCK // 8
        self.before = ones if ones is not None else np.array(
            [np.concatenate(([0], np.cumsum(np.add.reduceat(_BYTE_ONES[p], np.arange(0, len(p), per), dtype=np.int64))))
             if len(p) else [0] for p in planes], dtype=np.uint32,
        ).reshape(len(planes), -1)
        self.zeros = [n - int(b[-1]) for b in self.before]

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for shift in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << shift)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            now = np.concatenate((now.compress(~ones), now.compress(ones)))
        return cls(len(ids), planes)

    def _ones(self, level: int, upto: int) -> int:
        """Ones in the first ``upto`` bits of a plane."""
        plane, block = self.planes[level], upto // BLOCK
        start, last = block * BLOCK // 8, upto // 8
        total = int(self.before[level][block]) + int(_BYTE_ONES[plane[start:last]].sum())
        return total + (bin(plane[last] & ((1 << upto % 8) - 1)).count("1") if upto % 8 else 0)

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, plane in enumerate(self.planes):
            ones = self._ones(level, at)
            bit = int(plane[at >> 3] >> (at & 7) & 1)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        start, end = 0, upto
        for level in range(len(self.planes)):
            a, b = self._ones(level, start), self._ones(level, end)
            if token >> (len(self.planes) - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, upto: int) -> int:
        """How often the token is among the first ``upto``."""
        if token < 0 or token >> len(self.planes):
            return 0
        start, end = self._range(token, upto)
        return end - start

    def _select(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Where in a plane the nth bits (from 0, rising) of this kind lie: a binary search over
        the counts stored for the blocks, then a scan of the blocks found and of no others."""
        if not len(nth):
            return np.empty(0, dtype=np.int64)
        counts = self.before[level].astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts), dtype=np.int64) * BLOCK, self.n) - counts
        block = np.searchsorted(counts, nth, side="right") - 1
        wanted, which = np.unique(block, return_inverse=True)
        per = BLOCK // 8
        plane = self.planes[level]
        rows = np.zeros((len(wanted), per), dtype=np.uint8)
        for i, b in enumerate(wanted):
            part = plane[b * per : (b + 1) * per]
            rows[i, : len(part)] = part
        kind = np.unpackbits(rows if bit else ~rows, axis=1, bitorder="little")
        row, place = np.nonzero(kind)
        first = np.searchsorted(row, np.arange(len(wanted)))
        return block * BLOCK + place[first[which] + nth - counts[block]]

    def _places(self, token: int, first: int, nth: np.ndarray) -> np.ndarray:
        """Places of the token's nth occurrences, from the last plane up to the first."""
        at = first + nth
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def find(self, token: int) -> np.ndarray:
        """All places of the token, in order."""
        if token < 0 or token >> len(self.planes):
            return np.empty(0, dtype=np.int64)
        start, end = self._range(token, self.n)
        return self._places(token, start, np.arange(end - start, dtype=np.int64))

    def select(self, token: int, nth: int) -> int:
        """The place of the nth occurrence, from 0, reading one block of each plane."""
        start, end = self._range(token, self.n) if token >= 0 and not token >> len(self.planes) else (0, 0)
        if not 0 <= nth < end - start:
            raise IndexError(nth)
        return int(self._places(token, start, np.array([nth], dtype=np.int64))[0])

    def ids(self) -> np.ndarray:
        """The whole sequence, by undoing the parting plane by plane."""
        now = np.zeros(self.n, dtype=np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(now)
            above[np.flatnonzero(~ones)] = now[: self.zeros[level]]
            above[np.flatnonzero(ones)] = now[self.zeros[level] :] | now.dtype.type(1 << (len(self.planes) - 1 - level))
            now = above
        return now.astype("<u4")


class Shard:
    """A wavelet matrix and the documents it holds."""

    def __init__(self, matrix: WaveletMatrix, doc_ids: list[int | None], lengths: np.ndarray, start: int):
        self.matrix, self.doc_ids, self.lengths, self.start = matrix, doc_ids, lengths, start

    def dump(self) -> bytes:
        press = zstandard.ZstdCompressor(level=1).compress
        empty = np.array([x is None for x in self.doc_ids], dtype=np.uint8)
        frames = [
            np.array([x or 0 for x in self.doc_ids], dtype="<i8"), empty, self.lengths.astype("<u4"),
            self.matrix.before.astype("<u4"), *self.matrix.planes,
        ]
        out = [struct.pack(HEAD, MAGIC, 1, len(self.matrix.planes), self.matrix.n, len(self.doc_ids), self.start)]
        for frame in frames:
            packed = press(frame.tobytes())
            out += [struct.pack("<Q", len(packed)), packed]
        return b"".join(out)

    @classmethod
    def load(cls, image: bytes) -> Shard:
        magic, version, planes, n, _, start = struct.unpack_from(HEAD, image)
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard image")
        at, frames = struct.calcsize(HEAD), []
        for i in range(4 + planes):
            (size,) = struct.unpack_from("<Q", image, at)
            frame = image[at + 8 : at + 8 + size]
            frames.append(zstandard.decompress(frame) if i < 4 else frame)
            at += 8 + size
        ids, empty, lengths = np.frombuffer(frames[0], "<i8"), np.frombuffer(frames[1], np.uint8), np.frombuffer(frames[2], "<u4")
        before = np.frombuffer(frames[3], "<u4").reshape(planes, -1)
        matrix = WaveletMatrix(n, PackedPlanes(frames[4:]), before)
        return cls(matrix, [None if e else int(i) for i, e in zip(ids, empty)], lengths, start)


def write_shards(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, bits: int = 16, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Ids of all documents, each with ``end_id`` after it, in ascending doc_id order, as shards.

    Texts are range-partitioned by (doc_id, hash, row), so repeated ids do not fill one task, and
    encoded where they land. A shard closes after the document that fills it, so a task holds one
    shard and one batch. Null ids come first; null texts are empty. No rows: no shards.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        pieces = encoder(tokenizer, 500_000)
        ids, doc_ids, size = [], [], 0

        def close() -> pd.DataFrame:
            lengths = np.array([len(x) for x in ids], dtype=np.uint32)
            image = Shard(WaveletMatrix.of(np.concatenate(ids), bits), doc_ids, lengths, before).dump()
            return pd.DataFrame({"part": [part], "shard": [shard], "n_tokens": [size], "image": [image]})

        for batch in batches:
            known = batch["doc_id"].astype("Int64")
            for doc_id, found in zip(known, pieces.encode(batch["text"].tolist(), 1 << 22)):
                ids.append(np.append(found, np.uint32(end_id)))
                doc_ids.append(None if doc_id is pd.NA else int(doc_id))
                size += len(ids[-1])
                if size >= shard_tokens:
                    yield close()
                    shard, before = shard + 1, before + size
                    ids, doc_ids, size = [], [], 0
        if ids:
            yield close()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"),
        F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["doc_id", "h", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInPandas(build, FILES).write.option("compression", "uncompressed").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(path)


def with_starts(files: DataFrame) -> DataFrame:
    """``files`` with ``part_start``, the tokens of all parts before.

    A part is one task of the writer, so there are at most as many rows as it had tasks.
    """
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    return files.join(F.broadcast(starts), "part")


def _per_shard(files: DataFrame, rows, schema: str) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for image, part_start in zip(batch["image"], batch["part_start"]):
                shard = Shard.load(image)
                yield rows(shard, int(part_start) + shard.start)

    return with_starts(files).select("image", "part_start").mapInPandas(work, schema)


def documents_of(files: DataFrame, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the planes."""

    def rows(shard: Shard, start: int) -> pd.DataFrame:
        ids = shard.matrix.ids()
        ends = np.cumsum(shard.lengths, dtype=np.int64)
        parts = [ids[b - n : b] for b, n in zip(ends, shard.lengths.astype(np.int64))]
        out = pd.DataFrame({
            "doc_id": pd.array(shard.doc_ids, dtype="Int64"), "start": start + ends - shard.lengths,
            "n_tokens": shard.lengths.astype(np.int64), "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts],
        })
        return out.assign(ids=[p.astype(np.int32) for p in parts]) if keep_ids else out

    return _per_shard(files, rows, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


def count_token(files: DataFrame, token: int) -> DataFrame:
    """(start, n): per shard, how often the token occurs, by rank alone."""
    return _per_shard(
        files, lambda s, start: pd.DataFrame({"start": [start], "n": [s.matrix.rank(token, s.matrix.n)]}), "start long, n long"
    )


def find_token(files: DataFrame, token: int) -> DataFrame:
    """(place): every place of the token in the whole sequence, by select."""
    return _per_shard(files, lambda s, start: pd.DataFrame({"place": start + s.matrix.find(token)}), "place long")
