"""Exact substring dedup: difference-cover sample first, then one bucket of suffixes at a time, sorted by their text.

A byte goes if it lies in a LENGTH-byte string that also starts somewhere else. Only suffixes cut to LENGTH bytes have to
be told apart. Two steps by hashes leave out what is alone, a third one decides by bytes.

1. Cover sample. Offsets in a document whose remainder modulo PERIOD is in COVER are the sample: for any two offsets some
   shift below PERIOD puts both into it. If two LENGTH-byte strings are equal, so are the sample strings of
   GRAM = LENGTH - PERIOD + 1 bytes within them at that shift. A suffix none of whose sample strings occurs twice is alone.
2. Hashes of the suffixes left are dealt into buckets; one that occurs once in its bucket is alone.
3. What is left is cut into pieces: runs of neighbouring suffixes whose LENGTH bytes have the same least MINIMIZER-byte
   string, which also names the bucket, so equal suffixes meet whatever surrounds them. Equal pieces are counted, by their
   bytes. The suffixes of a bucket's different pieces are sorted as a difference cover allows it in bounded memory: by
   their first PERIOD - 1 bytes; ties by the ranks of the cover sample, precomputed for the bucket, at the shift that both
   have in common, and then by the last bytes. Neighbours that are equal stay marked; a suffix that only a hash made look
   like another is let go.

Documents travel as compressed blocks of about BLOCK_BYTES. A block sends each bucket its distinct hashes, sorted, as
compressed differences, and gets one bit for each back. So a bucket gets one hash per block of a string that fills a third
of all documents, and one piece. A block's rows are as many as the buckets that its hashes fall into, so beyond some
terabytes a row carries few hashes, and never less than one.

Nulls, ties, repeats: a null text counts as empty; texts shorter than LENGTH bytes lose nothing; of equal strings all go,
none is preferred; equal rows are separate documents, so both lose their long strings; an empty table gives an empty
result; columns beyond doc_id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table

LENGTH = 200
# A perfect difference set, every non-zero difference modulo 73 occurs once.
PERIOD, COVER = 73, (1, 2, 4, 8, 16, 32, 37, 55, 64)
GRAM = LENGTH - PERIOD + 1
BLOCK_BYTES = 2 << 20
#: Hashes that a bucket gets on average, at most, and bytes of text whose pieces make a bucket.
BUCKET_HASHES, BUCKET_TEXT = 1 << 21, 4 << 20
#: Bits of the hashes of sample strings and of suffixes; an accidental match only costs a look at more bytes.
SAMPLE_BITS, SUFFIX_BITS = 40, 64
#: Bytes of the strings whose least names a piece's bucket.
MINIMIZER = 16


def blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, ends, n_bytes, packed): neighbouring documents packed together, without moving any."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        place, count = TaskContext.get().partitionId() << 32, 0
        ids, ends, data = [], [], bytearray()

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([place + count]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([len(data)]), pa.array([press.compress(bytes(data))], pa.binary())],
                ["block", "ids", "ends", "n_bytes", "packed"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8")
                if ids and len(data) + len(raw) > BLOCK_BYTES:
                    yield block()
                    ids, ends, data, count = [], [], bytearray(), count + 1
                data += raw
                ids.append(doc_id.as_py())
                ends.append(len(data))
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "block bigint, ids array<bigint>, ends array<bigint>, n_bytes bigint, packed binary")


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, and a number for each byte value."""
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)


class Block:
    """The bytes of one block and the hashes of strings in it."""

    def __init__(self, packed: bytes, ends: list[int]):
        self.x = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        sizes = self.ends - self.starts
        self.offset = np.arange(len(self.x)) - np.repeat(self.starts, sizes)
        self.rest = np.repeat(self.ends, sizes) - np.arange(len(self.x))
        n = max(len(self.x) + 1, BLOCK_BYTES + 1)
        up, self.down, value = powers(1 << (n - 1).bit_length())
        self.sums = np.zeros(len(self.x) + 1, np.uint64)
        np.cumsum(value[self.x] * up[: len(self.x)], out=self.sums[1:])

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[at + length] - self.sums[at]) * self.down[at]
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(31)

    def sample(self) -> np.ndarray:
        """Places of the cover sample with a whole sample string in their document."""
        chosen = np.zeros(PERIOD, bool)
        chosen[list(COVER)] = True
        return np.flatnonzero(chosen[self.offset % PERIOD] & (self.rest >= GRAM))

    def open_places(self, at: np.ndarray) -> np.ndarray:
        """Places of LENGTH-byte strings that hold one of the sample strings at the given places."""
        marks = np.zeros(len(self.x) + 1, np.int32)
        np.add.at(marks, at - np.minimum(self.offset[at], PERIOD - 1), 1)
        np.add.at(marks, at + 1, -1)
        return np.flatnonzero((np.cumsum(marks[:-1]) > 0) & (self.rest >= LENGTH))

    def pieces(self, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first, last, key) of each run of neighbouring places, in order, with one least MINIMIZER-byte string in their LENGTH bytes."""
        if not len(at):
            return
        bits = np.uint64(len(self.x).bit_length())
        h = self.hashes(np.arange(len(self.x) - MINIMIZER + 1), MINIMIZER)
        # the first place of equal ones is the least
        least = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        width, step = LENGTH - MINIMIZER + 1, 1
        while 2 * step <= width:
            np.minimum(least[:-step], least[step:], out=least[:-step])
            step *= 2
        place = (np.minimum(least[at], least[at + width - step]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        ends = np.flatnonzero(np.append((np.diff(at) != 1) | (np.diff(place) != 0), True))
        keys = h[place[ends]].view(np.int64)
        first = 0
        for end, key in zip(ends.tolist(), keys.tolist(), strict=True):
            yield int(at[first]), int(at[end]), key
            first = end + 1

    def cut(self, at: np.ndarray) -> np.ndarray:
        """Which bytes lie in the LENGTH-byte strings at the given places."""
        marks = np.zeros(len(self.x) + 1, np.int32)
        marks[at] += 1
        marks[at + LENGTH] -= 1
        return np.cumsum(marks[:-1]) > 0


def distinct(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of that many bits, which of them occur twice in the block, and each place's index."""
    values, index, counts = np.unique(h >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
    return values, counts > 1, index


def sent(block: int, h: np.ndarray, bits: int, bucket_bits: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(bucket, block, hashes, twice) for each bucket that gets something."""
    values, twice, _ = distinct(h, bits)
    press = zstandard.ZstdCompressor(level=1)
    bucket = (values >> np.uint64(bits - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(values), np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True):
        if b > a:
            steps = np.diff(values[a:b], prepend=np.uint64(0))
            planes = steps.view(np.uint8).reshape(-1, 8).T.copy()
            yield int(bucket[a]), block, press.compress(planes.tobytes()), np.packbits(twice[a:b]).tobytes()


def told_apart(sends: DataFrame) -> DataFrame:
    """(block, again, marks): per block and sent hash whether it occurs twice in all, and how many do. Sorts one bucket at a time."""

    def made(t: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        lists = [np.cumsum(np.ascontiguousarray(np.frombuffer(unpack.decompress(v.as_py()), np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64) for v in t.column("hashes")]
        twice = [np.unpackbits(np.frombuffer(v.as_py(), np.uint8), count=len(x)).astype(bool) for v, x in zip(t.column("twice"), lists, strict=True)]
        everything = np.sort(np.concatenate(lists))
        again = everything[1:][everything[1:] == everything[:-1]]
        again = np.unique(np.concatenate([again, *(x[y] for x, y in zip(lists, twice, strict=True))]))
        marks, counts = [], []
        for x in lists:
            at = np.minimum(np.searchsorted(again, x), max(len(again) - 1, 0))
            found = again[at] == x if len(again) else np.zeros(len(x), bool)
            marks.append(np.packbits(found).tobytes())
            counts.append(int(found.sum()))
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "size": pa.array([len(x) for x in lists], pa.int32()), "again": pa.array(counts, pa.int64()), "marks": pa.array(marks, pa.binary())})

    found = settle(sends.groupBy("bucket").applyInArrow(made, "block bigint, bucket bigint, size int, again bigint, marks binary"))
    # a block has few rows
    return found.groupBy("block").agg(F.sum("again").alias("again"), F.sort_array(F.collect_list(F.struct("bucket", "size", "marks"))).alias("marks"))


def flags(marks: list[dict] | None) -> np.ndarray:
    """The bits of a block's distinct hashes in their order."""
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(m["marks"], np.uint8), count=m["size"]).astype(bool) for m in marks or [])])


def candidates(b: Block, marks: list[dict] | None) -> np.ndarray:
    """Places of the suffixes that the cover sample leaves open."""
    at = b.sample()
    if not len(at):
        return at
    _, _, index = distinct(b.hashes(at, GRAM), SAMPLE_BITS)
    return b.open_places(at[flags(marks)[index]])


def repeats(b: Block, sample_marks: list[dict] | None, marks: list[dict] | None, suffix_bits: int) -> np.ndarray:
    """Places of the suffixes whose hash occurs again."""
    at = candidates(b, sample_marks)
    if not len(at):
        return at
    _, _, index = distinct(b.hashes(at, LENGTH), suffix_bits)
    return at[flags(marks)[index]]


def dense(a: np.ndarray) -> np.ndarray:
    """Ranks from 0 on; equal values have equal ranks."""
    return np.unique(a, return_inverse=True)[1]


def cover_shifts() -> np.ndarray:
    """For two remainders modulo PERIOD the least shift that puts both into the cover."""
    out = np.zeros((PERIOD, PERIOD), np.int64)
    chosen = np.zeros(2 * PERIOD, bool)
    chosen[[c + k * PERIOD for c in COVER for k in (0, 1)]] = True
    for d in range(PERIOD - 1, -1, -1):
        hit = chosen[np.arange(PERIOD) + d]
        out[np.ix_(hit, hit)] = d
    return out


SHIFTS = cover_shifts()


def told_by_bytes(pieces: list[bytes]) -> list[np.ndarray]:
    """Per piece, for each LENGTH-byte string in it, whether an equal one starts elsewhere in the pieces."""
    ends = np.cumsum([len(p) for p in pieces])
    x = np.frombuffer(b"".join(pieces) + bytes(2 * LENGTH), np.uint8)
    n = int(ends[-1])
    suffixes = np.concatenate([np.arange(e - len(p), e - LENGTH + 1) for e, p in zip(ends.tolist(), pieces, strict=True)])

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return dense(a * (b.max() + 1) + b)

    def later(a: np.ndarray, k: int) -> np.ndarray:
        return np.append(a[k:], np.zeros(k, a.dtype))

    word = np.zeros(n + LENGTH, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | x[k : k + n + LENGTH]
    eight = rank = dense(word)
    for k in (8, 16, 32):
        rank = joined(rank, later(rank, k))
    heads = joined(rank, later(eight, 64))
    # the cover sample's ranks, of GRAM = 2 * 64 bytes each
    sample = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    ranks = np.full(n + LENGTH, -1, np.int64)
    ranks[sample] = joined(rank[sample], rank[sample + 64])

    order = np.argsort(heads[suffixes], kind="stable")
    at, group = suffixes[order], heads[suffixes[order]]
    same = np.zeros(len(at), bool)
    live = np.arange(len(at))
    draw = np.random.Generator(np.random.PCG64(5))
    while len(live):
        # of each group of ties a pivot, and what is less, equal and greater by the sample's ranks at a common shift
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        counts = np.diff(np.append(starts, len(group)))
        which = np.repeat(np.arange(len(starts)), counts)
        p = at[live]
        pivot = p[starts + (draw.random(len(starts)) * counts).astype(np.int64)][which]
        shift = SHIFTS[p % PERIOD, pivot % PERIOD]
        sign = np.sign(ranks[p + shift] - ranks[pivot + shift])
        tie = sign == 0
        sign[tie] = np.sign(heads[p[tie] + GRAM] - heads[pivot[tie] + GRAM])
        equal = sign == 0
        same[live[equal]] = (np.bincount(which, equal, len(starts)) > 1)[which[equal]]
        group, live = (2 * which + (sign > 0))[~equal], live[~equal]
        order_ = np.argsort(group, kind="stable")
        group, live = group[order_], live[order_]
        if len(group):
            many = np.bincount(group)[group] > 1
            group, live = group[many], live[many]
    out = np.zeros(len(at), bool)
    out[order] = same
    return np.split(out, np.cumsum([len(p) - LENGTH + 1 for p in pieces])[:-1])


def mistaken(pieces: DataFrame) -> DataFrame:
    """(piece, alone): the pieces with suffixes that occur nowhere else by their bytes, with a bit for each of them.

    pieces: (bucket, key, piece, n), dealt by bucket, each once. A piece that occurs twice needs no look, and one alone is
    held against those of its key.
    """

    def made(t: pa.Table) -> pa.Table:
        by_key: dict[int, list[tuple[bytes, int]]] = {}
        for key, piece, n in zip(*(t.column(c).to_pylist() for c in ("key", "piece", "n")), strict=True):
            by_key.setdefault(key, []).append((piece, n))
        looked = [x for xs in by_key.values() if any(n == 1 for _, n in xs) for x in xs]
        rows = []
        if looked:
            for (piece, n), same in zip(looked, told_by_bytes([p for p, _ in looked]), strict=True):
                if n == 1 and not same.all():
                    rows.append((piece, np.packbits(~same).tobytes()))
        return pa.table({c: pa.array([r[k] for r in rows], pa.binary()) for k, c in enumerate(("piece", "alone"))})

    return pieces.groupBy("bucket").applyInArrow(made, "piece binary, alone binary")


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def sendings(rows: Iterator[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "block", "hashes", "twice"])


SENT = "bucket bigint, block bigint, hashes binary, twice binary"


def without_repeats(docs: DataFrame, suffix_bits: int = SUFFIX_BITS) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept) per row of docs: the runs removed, as byte offsets, and the bytes that remain."""
    packed = settle(blocks(docs))
    n_bytes = packed.agg(F.sum("n_bytes")).first()[0] or 0

    def bits_for(n_hashes: float) -> int:
        return max(0, int(n_hashes / BUCKET_HASHES)).bit_length()

    sample_bits = bits_for(n_bytes * len(COVER) / PERIOD)

    def sample_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                b = Block(row["packed"], row["ends"])
                yield sendings(sent(row["block"], b.hashes(b.sample(), GRAM), SAMPLE_BITS, sample_bits))

    ranks = settle(told_apart(packed.select("block", "ends", "packed").mapInArrow(sample_sent, SENT)).withColumnsRenamed({"marks": "sample_marks", "again": "n_open"}))
    # each of these leaves so many suffixes open, at most
    n_open = (ranks.agg(F.sum("n_open")).first()[0] or 0) * PERIOD
    bucket_bits = min(bits_for(min(n_open, n_bytes)), suffix_bits)

    def suffixes_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                b = Block(row["packed"], row["ends"])
                yield sendings(sent(row["block"], b.hashes(candidates(b, row["sample_marks"]), LENGTH), suffix_bits, bucket_bits))

    ranked = packed.join(ranks, "block", "left").select("block", "ids", "ends", "packed", "sample_marks")
    found = told_apart(ranked.select("block", "ends", "packed", "sample_marks").mapInArrow(suffixes_sent, SENT)).drop("again")
    marked = settle(ranked.join(found, "block", "left"))
    n_buckets = max(1, n_bytes // BUCKET_TEXT)

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                b = Block(row["packed"], row["ends"])
                counts: dict[tuple[int, bytes], int] = {}
                for first, last, key in b.pieces(repeats(b, row["sample_marks"], row["marks"], suffix_bits)):
                    piece = key, b.x[first : last + LENGTH].tobytes()
                    counts[piece] = counts.get(piece, 0) + 1
                columns = [pa.array([row["block"]] * len(counts), pa.int64()), pa.array([k for k, _ in counts], pa.int64()), pa.array([p for _, p in counts], pa.binary()), pa.array(counts.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "key", "piece", "n"])

    pieces = marked.select("block", "ends", "packed", "sample_marks", "marks").mapInArrow(pieces_of, "block bigint, key bigint, piece binary, n bigint")
    dealt = pieces.select(F.pmod("key", F.lit(n_buckets)).alias("bucket"), "key", "piece", "n").repartition("bucket")
    wrong = settle(mistaken(dealt.groupBy("bucket", "key", "piece").agg(F.sum("n").alias("n"))))
    # as a rule nothing: 64-bit hashes of different strings that are equal
    if wrong.isEmpty():
        marked = marked.withColumn("wrong", F.lit(None).cast("array<struct<piece:binary,alone:binary>>"))
    else:
        of_block = pieces.select("block", "piece").join(wrong, "piece").groupBy("block").agg(F.collect_list(F.struct("piece", "alone")).alias("wrong"))
        marked = marked.join(of_block, "block", "left")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                b = Block(row["packed"], row["ends"])
                at = repeats(b, row["sample_marks"], row["marks"], suffix_bits)
                if row["wrong"]:
                    alone = {w["piece"]: w["alone"] for w in row["wrong"]}
                    keep = np.ones(len(b.x) + 1, bool)
                    for first, last, _ in b.pieces(at):
                        if bits := alone.get(b.x[first : last + LENGTH].tobytes()):
                            keep[first : last + 1] = ~np.unpackbits(np.frombuffer(bits, np.uint8), count=last - first + 1).astype(bool)
                    at = at[keep[at]]
                gone = b.cut(at)
                first = gone & ((b.offset == 0) | ~np.concatenate([[False], gone[:-1]])) if len(gone) else gone
                last = gone & ((b.rest == 1) | ~np.concatenate([gone[1:], [False]])) if len(gone) else gone
                starts, ends, kept = [], [], []
                for s, e in zip(b.starts, b.ends, strict=True):
                    starts.append(np.flatnonzero(first[s:e]).tolist())
                    ends.append((np.flatnonzero(last[s:e]) + 1).tolist())
                    kept.append(b.x[s:e][~gone[s:e]].tobytes())
                spans = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(b.ends - b.starts), pa.array(starts, spans), pa.array(ends, spans), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "starts", "ends", "kept"])

    last = marked.select("ids", "ends", "packed", "sample_marks", "marks", "wrong")
    return last.mapInArrow(removed, "doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    df = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
