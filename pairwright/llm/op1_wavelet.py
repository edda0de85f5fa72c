"""Token ids in wavelet matrices: one self-contained compressed file image per shard.

Documents are dealt into ranges of ascending doc_id by cut points of that column
alone; texts are encoded before the shuffle, which so moves ids and no text. Each
range becomes some shards, in order. A shard's image holds the lengths and ids of
its documents and one bit plane per bit of the largest id, in blocks that are
compressed each on its own. A plane's directory has the place of every block and the
ones before it, so access, rank, select, count and lookup unpack a block or two of
each plane and never the ids. The images are rows of a Parquet table in the shared
folder: any file system that Spark writes will do, and a lost executor's range is
written anew.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks
from .common import partitions, shared_path, table

MAGIC = b"WVMX0002"
#: Tokens in a shard, unless one document has more.
SHARD_TOKENS = 4_000_000
#: Bytes of text to a range of doc_ids aimed at, and most ranges: bounds what the driver and each task hold of their borders.
RANGE_BYTES, MOST_RANGES = 32_000_000, 1 << 16
#: Bits in a block of a plane.
BLOCK = 1 << 16
#: Unpacked blocks that an open matrix keeps.
KEPT_BLOCKS = 256


class WaveletMatrix:
    """A sequence of unsigned integers as bit planes, the highest bit first; a plane is read by blocks."""

    def __init__(self, n: int, ones: list[np.ndarray], block):
        self.n, self.width = n, len(ones)
        self.ones = ones  # of each plane: ones before each block, and of all at last
        self.zeros = [n - int(o[-1]) for o in ones]
        self.block = block  # (plane, block) to packed bits

    @classmethod
    def build(cls, values: np.ndarray) -> WaveletMatrix:
        """From the values; its planes are held as they are."""
        width = max(1, int(values.max()).bit_length()) if len(values) else 1
        values = np.asarray(values, np.uint16 if width <= 16 else np.uint32)
        planes, ones = [], []
        size = BLOCK // 8
        for b in range(width - 1, -1, -1):
            one = (values >> values.dtype.type(b) & values.dtype.type(1)).astype(bool)
            plane = np.packbits(one)
            planes.append(plane)
            count = np.bitwise_count(plane)
            ones.append(np.concatenate([[0], np.cumsum(np.add.reduceat(count, np.arange(0, len(plane), size), dtype=np.int64))]) if len(plane) else np.zeros(1, np.int64))
            values = np.concatenate([values[~one], values[one]])
        return cls(len(values), ones, lambda k, b: planes[k][b * size : (b + 1) * size])

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        b, rest = divmod(i, BLOCK)
        count = int(self.ones[k][b])
        if rest:
            bits = self.block(k, b)
            count += int(np.bitwise_count(bits[: rest // 8]).sum())
            if rest % 8:
                count += (int(bits[rest // 8]) >> (8 - rest % 8)).bit_count()
        return count

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.width):
            bit = int(self.block(k, i // BLOCK)[i % BLOCK // 8]) >> (7 - i % 8) & 1
            ones = self._ones(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        if value < 0 or value >> self.width:
            return 0, 0
        for k in range(self.width):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.width - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of the value before position i."""
        return self.count(value, 0, i)

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(value, max(0, lo), self.n if hi is None else min(hi, self.n))
        return max(0, b - a)

    def _select_bit(self, k: int, bit: int, j: int) -> int:
        """Position of the (j + 1)-th such bit of plane k."""
        ones = self.ones[k]
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        b = int(np.searchsorted(before[:-1], j, side="right")) - 1
        bits = np.unpackbits(self.block(k, b), count=min(BLOCK, self.n - b * BLOCK))
        return b * BLOCK + int(np.flatnonzero(bits == bit)[j - int(before[b])])

    def select(self, value: int, j: int) -> int:
        """Position of the (j + 1)-th occurrence of the value; -1 if there are fewer."""
        lo, hi = self._range(value, 0, self.n)
        if not 0 <= j < hi - lo:
            return -1
        i = lo + j
        for k in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - k) & 1
            i = self._select_bit(k, bit, i - self.zeros[k] if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, j) for j in range(self.count(value))]

    def values(self) -> np.ndarray:
        """All values in order, by undoing the stable partitions from the lowest plane up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        low = np.zeros(self.n, kind)
        for k in range(self.width - 1, -1, -1):
            plane = np.concatenate([self.block(k, b) for b in range(len(self.ones[k]) - 1)] or [np.zeros(0, np.uint8)])
            one = np.unpackbits(plane, count=self.n).astype(bool)
            up = np.empty(self.n, kind)
            zeros = self.zeros[k]
            up[~one], up[one] = low[:zeros], low[zeros:] | kind(1 << self.width - 1 - k)
            low = up
        return low


def to_image(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> bytes:
    """The file image of a shard.

    Magic; numbers of documents, of tokens and of planes; sizes of the compressed doc
    ids, null flags and lengths, and these; for each plane the ones before each block
    and the place of each block (one more: the end); then the blocks, raw where that
    isn't longer.
    """
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    wm = WaveletMatrix.build(values)
    parts = [pack(np.asarray(x, kind).tobytes()) for x, kind in ((doc_ids, "<i8"), (nulls, "u1"), (lengths, "<i8"))]
    directory, blocks, at = [], [], 0
    for k in range(wm.width):
        places = []
        for b in range(len(wm.ones[k]) - 1):
            raw = wm.block(k, b).tobytes()
            small = pack(raw)
            blocks.append(small if len(small) < len(raw) else raw)
            places.append(at)
            at += len(blocks[-1])
        directory += [wm.ones[k].astype("<i8").tobytes(), np.array([*places, at], "<i8").tobytes()]
    head = MAGIC + struct.pack("<QQI3Q", len(lengths), wm.n, wm.width, *map(len, parts))
    return b"".join([head, *parts, *directory, *blocks])


def from_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """doc ids, null flags and lengths of a shard, and its matrix, whose blocks stay packed until they are read."""
    import zstandard

    if image[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    unpack = zstandard.ZstdDecompressor().decompress
    docs, n, width, *sizes = struct.unpack_from("<QQI3Q", image, 8)
    at, parts = 8 + struct.calcsize("<QQI3Q"), []
    for size, kind in zip(sizes, ("<i8", "u1", "<i8")):
        parts.append(np.frombuffer(unpack(image[at : at + size]), kind))
        at += size
    if any(len(p) != docs for p in parts):
        raise ValueError("damaged wavelet shard")
    blocks, ones, places = -(-n // BLOCK), [], []
    for _ in range(width):
        for found in (ones, places):
            found.append(np.frombuffer(image, "<i8", blocks + 1, at))
            at += 8 * (blocks + 1)
    kept: dict[tuple[int, int], np.ndarray] = {}

    def block(k: int, b: int) -> np.ndarray:
        if (k, b) not in kept:
            if len(kept) >= KEPT_BLOCKS:
                kept.clear()
            raw = image[at + places[k][b] : at + places[k][b + 1]]
            whole = -(-min(BLOCK, n - b * BLOCK) // 8)
            kept[k, b] = np.frombuffer(raw if len(raw) == whole else unpack(raw), np.uint8)
        return kept[k, b]

    return *parts, WaveletMatrix(n, ones, block)


class Ranges:
    """Ranges of ascending doc_id of near equal counts. A doc_id that fills several, null too, is dealt over as many parts by its ids."""

    def __init__(self, docs: DataFrame):
        rows, size, nulls = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(F.col("doc_id").isNull())).first()
        n = min(MOST_RANGES, max(partitions(docs.sparkSession), -(-size // RANGE_BYTES)), max(1, rows))
        found = docs.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n))).first()[0] if n > 1 else None
        self.n = n
        self.cuts, self.often = np.unique(np.array(found or [], np.int64), return_counts=True)
        self.null_parts = max(1, -(-nulls * n // max(1, rows)))

    def of(self, doc_ids: pa.Array, ids: list[memoryview]) -> np.ndarray:
        """Numbers of the ranges, ascending with doc_id, null before all."""
        null = doc_ids.is_null().to_numpy(zero_copy_only=False)
        values = doc_ids.fill_null(0).to_numpy()
        at = np.searchsorted(self.cuts, values, "left")
        part = np.zeros(len(values), np.int64)
        on = np.append(self.cuts, 0)[at] == values if len(self.cuts) else np.zeros(len(values), bool)
        on &= at < len(self.cuts)
        parts = np.where(null, self.null_parts, np.where(on, np.append(self.often, 1)[at], 1))
        for i in np.flatnonzero(parts > 1).tolist():
            part[i] = zlib.crc32(ids[i]) % int(parts[i]) + (0 if null[i] else 1)
        return np.where(null, 0, at + 1) * (self.n + 1) + part


def write_shards(docs: DataFrame, file: str, end_id: int, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes the documents and writes the shards of all to `path`: bucket, seq, first (tokens of the bucket before it), n_tokens, image.

    Null text counts as empty: its ids are the end id alone. Rows of equal doc_id, and
    those of null doc_id, which come first, have an order that their ids alone decide.
    Very long texts become a shard of their own. An empty table writes no shard. Other
    columns are left out, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = Ranges(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunks.library_encoder(file)
        for b in batches:
            k = 0
            for n, ids, at in encoder(b.column("text"), end_id):
                raw = pa.py_buffer(ids.astype("<u4", copy=False))
                column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 4).astype(np.int32)), raw])
                doc_ids = b.column("doc_id").slice(k, n)
                view, ends = memoryview(raw), (at * 4).tolist()
                bucket = dealt.of(doc_ids, [view[a:e] for a, e in zip(ends, ends[1:])])
                yield pa.RecordBatch.from_arrays([pa.array(bucket), doc_ids, column], ["bucket", "doc_id", "ids"])
                k += n

    shards = pa.schema([("bucket", pa.int64()), ("seq", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []  # doc ids, lengths, ids of some rows
        bucket, seq, first, size = None, 0, 0, 0

        def shard() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays([h[0] for h in held])
            image = to_image(doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            return pa.RecordBatch.from_pylist([{"bucket": bucket, "seq": seq, "first": first, "n_tokens": size, "image": image}], schema=shards)

        for b in batches:
            of, ids = b.column("bucket").to_numpy(), b.column("ids")
            at = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // 4
            flat = np.frombuffer(ids.buffers()[2], "<u4") if len(ids) else np.zeros(0, np.uint32)
            i = 0
            while i < len(of):
                if held and of[i] != bucket:
                    yield shard()
                    held, seq, first, size = [], 0, 0, 0
                elif held and size + at[i + 1] - at[i] > shard_tokens:
                    yield shard()
                    held, seq, first, size = [], seq + 1, first + size, 0
                bucket = int(of[i])
                fits = int(np.searchsorted(at, at[i] + shard_tokens - size, "right")) - 1
                j = min(max(fits, i + 1), int(np.searchsorted(of, bucket, "right")))  # buckets ascend
                held.append((b.column("doc_id").slice(i, j - i), np.diff(at[i : j + 1]), flat[at[i] : at[j]].copy()))
                size += int(at[j] - at[i])
                i = j
        if held:
            yield shard()

    (
        docs.mapInArrow(encode, "bucket long, doc_id long, ids binary")
        .repartitionById(dealt.n, F.col("bucket").cast("int"))
        .sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
        .mapInArrow(build, "bucket long, seq int, first long, n_tokens long, image binary")
        .write.parquet(path)
    )


def read_shards(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the files; with `keep` its ids.

    The driver gets one number for each range of doc_ids (Ranges bounds these). No shards: no rows.
    """
    shards = spark.read.parquet(path)
    sizes = {r[0]: r[1] for r in shards.groupBy("bucket").agg(F.sum("n_tokens")).collect()}
    before, total = {}, 0
    for k in sorted(sizes):
        before[k] = total
        total += sizes[k]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, first, image in zip(*[b.column(c).to_pylist() for c in ("bucket", "first", "image")]):
                ids, nulls, lengths, wm = from_image(image)
                values = wm.values().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = memoryview(values.tobytes())
                cols = [
                    pa.array(ids, mask=nulls.astype(bool)),
                    pa.array(starts + first + before[bucket]),
                    pa.array(lengths),
                    pa.array([zlib.crc32(raw[a * 4 : e * 4]) for a, e in zip(starts.tolist(), ends.tolist())], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values.astype("i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep else "")
    return shards.select("bucket", "first", "image").mapInArrow(read, schema)


def lookup(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Occurrences of a token by select alone: doc_id, bucket, seq, position in the shard. Ids are never unpacked."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, seq, image in zip(*[b.column(c).to_pylist() for c in ("bucket", "seq", "image")]):
                ids, nulls, lengths, wm = from_image(image)
                at = np.array(wm.occurrences(token), np.int64)
                of = np.searchsorted(np.cumsum(lengths), at, "right")
                docs = pa.array(ids[of], mask=nulls[of].astype(bool))
                yield pa.RecordBatch.from_arrays([docs, pa.array([bucket] * len(at), pa.int64()), pa.array([seq] * len(at), pa.int32()), pa.array(at)], ["doc_id", "bucket", "seq", "position"])

    return spark.read.parquet(path).select("bucket", "seq", "image").mapInArrow(find, "doc_id long, bucket long, seq int, position long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over all documents; see write_shards for nulls, repeated rows, long texts and empty tables."""
    import public_tokenizers as P

    path = shared_path(spark, "wavelet")
    write_shards(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), 2, path)
    return read_shards(spark, path)
