"""Alignment of two tokenizers: which tokens of one stand where which of the other do, over the whole corpus.

Both tokenizers cut the same bytes. Where a token of A and one of B end together, a group ends; all tokens of A in a group
are linked with all of B in it. A pair of ids counts once per document that has it linked.

Counting is external and goes by runs. A task aligns texts of about BATCH_BYTES at once, sorts their (id of A, id of B,
document) records, cuts them by radix of A's id and writes each part as a run of compressed columns to the shared folder:
the pairs with their numbers of documents, and apart from these the documents with their numbers of links. The runs of one
radix and salt, RUNS of them, are merged by a heap, pair by pair, side A first, which adds up the documents of each pair; these
sums are added up over salts, and since the pairs of one id of A lie together, its maximum is there when they end. Then the
runs stream past the counts of their radix, one run after another, and give each document its part of the results. So no
task holds more than the counts of one radix, whose number the vocabularies bound, and one run; frequent ids are dealt
over salts like all others.

Nulls, ties, repeats: null or empty text, and text that either tokenizer does not give back unchanged, has no tokens,
zeros and an empty digest; of pairs with equal counts all are best; a repeated row counts as another document; an empty
table gives an empty result; columns beyond doc_id and text don't matter. A task holds one whole text at a time. Strings
of special tokens are plain text. Tokenizer files are parameters and are read by each Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import settle, table

#: Classes that A's ids are dealt to; runs that are merged together; runs that stream past one copy of the counts.
RADIX, RUNS, STREAM = 16, 64, 64
#: Bytes of text that are aligned at once; links of a group beyond which it is counted by distinct ids.
BATCH_BYTES, WIDE = 4 << 20, 1 << 16
#: Segments of text that a Python worker remembers for B, and their length at most.
CACHE, CACHED_CHARS = 1 << 19, 32
MEASURES = ("n_a", "n_b", "n_groups", "n_links")
SPACE = "▁"
ROW = "key bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, radix int, turn bigint, pairs binary, documents binary"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteSide:
    """Byte-level BPE from a tokenizer file whose ids follow the order of its merges."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i not in special}
        merged = [ranks[bytes(letters[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids don't follow the merges")
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.encode = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class PieceSide:
    """Pieces with byte fallback. Where no piece has a space behind another character, stretches that begin with spaces are encoded each on its own, once while they are remembered."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        as_byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.bytes_of = {i: bytes([int(m[1], 16)]) if (m := as_byte.fullmatch(p)) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)}
        self.alone = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.space = self.model.piece_to_id(SPACE)
        self.stretches = re.compile(" +[^ ]*").findall
        self.remembered: dict[str, bytes] = {}

    def given_back(self, ids: list[int], text: str) -> bytes | None:
        """Packed ids, None where they don't give the text back behind a space."""
        return array("H", ids).tobytes() if b"".join(map(self.bytes_of.__getitem__, ids)) == f" {text}".encode() else None

    def encoded(self, texts: list[str]) -> list[bytes | None]:
        """Packed ids of each text; None where they don't give it back."""
        if not self.alone:
            return [self.given_back(ids, t) for ids, t in zip(self.model.encode(texts, num_threads=1), texts, strict=True)]
        if len(self.remembered) > CACHE:
            self.remembered.clear()
        cut = [self.stretches(" " + t) for t in texts]
        # the encoder adds the first space itself, but for nothing
        new = [s[1:] for s in set().union(*cut) - self.remembered.keys()]
        ids = self.model.encode(new, num_threads=1) if new else []
        now = {" " + s: self.given_back(i if s else [self.space], s) for s, i in zip(new, ids, strict=True)}
        self.remembered |= {s: i for s, i in now.items() if len(s) <= CACHED_CHARS}
        out, known = [], self.remembered.get
        for stretches in cut:
            parts = [known(s) or now.get(s) for s in stretches]
            out.append(None if None in parts else b"".join(parts))
        return out


class Sides:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        sizes = [max(s.bytes_of) + 1 for s in (self.a, self.b)]
        if sizes[0] > 1 << 16 or sizes[1] > 1 << 16:
            raise ValueError("vocabularies beyond 65,536 ids")
        self.lengths = [np.array([len(s.bytes_of.get(i, b"")) for i in range(n)]) for s, n in zip((self.a, self.b), sizes, strict=True)]
        # a token as it is written: A's before another of A or before B's, B's before another of B or at the end of its group
        self.written = [f"{i}{mark}" for n, marks in zip(sizes, (",|", ",;"), strict=True) for mark in marks for i in range(n)]
        self.starts = [0, sizes[0], 2 * sizes[0], 2 * sizes[0] + sizes[1]]

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text, or none where one of them doesn't give the text back."""
        none, one, two = np.zeros(0, np.int64), [], []
        for text, packed in zip(texts, self.b.encoded(texts), strict=True):
            a = np.array(self.a.encode(" " + text), np.int64) if text and packed else none
            # bytes that merge: only the number of them could differ
            same = len(a) > 0 and self.lengths[0][a].sum() == len(text.encode()) + 1
            one.append(a if same else none)
            two.append(np.frombuffer(packed, np.uint16).astype(np.int64) if same else none)
        return one, two


@lru_cache(1)
def sides(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def aligned(both: Sides, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of some texts: the measures, a row for each; the digests; and the links as sorted keys (id of A, id of B, text) of 16, 16 and 32 bits with their numbers."""
    sides_ = both.tokens(texts)
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in sides_)
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in sides_)
    doc_a, doc_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
    # texts lie end to end and have as many bytes on both sides, so that each text's end is a common one
    ends_a, ends_b = np.cumsum(both.lengths[0][a]), np.cumsum(both.lengths[1][b])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    of = doc_a[first_a] if len(common) else np.zeros(0, np.int64)
    measures = np.stack([n_a, n_b, np.bincount(of, minlength=len(texts)), np.bincount(of, in_a * in_b, len(texts)).astype(np.int64)], 1) if len(texts) else np.zeros((0, 4), np.int64)

    # the text of the groups: A's tokens of a group, then B's
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[first_a + in_a - 1], last_b[first_b + in_b - 1] = True, True
    codes = np.empty(len(a) + len(b), np.int64)
    at_a, at_b = np.arange(len(a)) + first_b[group_a], np.arange(len(b)) + (first_a + in_a)[group_b]
    codes[at_a] = a + np.where(last_a, both.starts[1], both.starts[0])
    codes[at_b] = b + np.where(last_b, both.starts[3], both.starts[2])
    digests, at = [], 0
    for n in (n_a + n_b).tolist():
        shown = "".join(map(both.written.__getitem__, codes[at : at + n].tolist()))
        digests.append(hashlib.sha256(shown[:-1].encode()).hexdigest() if n else "")
        at += n

    # the links: each token of A with all of B in its group
    wide = (in_a * in_b > WIDE).nonzero()[0]
    few = np.ones(len(common), bool)
    few[wide] = False
    some = few[group_a]
    repeats = in_b[group_a[some]]
    nth = np.arange(repeats.sum()) - np.repeat(np.cumsum(repeats) - repeats, repeats)
    partner = b[np.repeat(first_b[group_a[some]], repeats) + nth]
    key = lambda x, y, d: x.astype(np.uint64) << np.uint64(48) | y.astype(np.uint64) << np.uint64(32) | np.asarray(d).astype(np.uint64)
    keys, times = np.unique(key(np.repeat(a[some], repeats), partner, np.repeat(doc_a[some], repeats)), return_counts=True)
    if len(wide):
        keys, times = [keys], [times]
        for g in wide.tolist():
            x, nx = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            y, ny = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            keys.append(key(np.repeat(x, len(y)), np.tile(y, len(x)), of[g]))
            times.append(np.outer(nx, ny).ravel())
        keys, back = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.bincount(back, np.concatenate(times)).astype(np.int64)
    return measures, digests, keys, times


def packed(*columns: np.ndarray) -> bytes:
    """Unsigned 32-bit columns of one length, compressed one after the other."""
    return zstandard.ZstdCompressor(level=3).compress(b"".join(c.astype(np.uint32).tobytes() for c in columns))


def unpacked(raw: bytes, n: int) -> list[np.ndarray]:
    return np.split(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint32), n)


def runs_of(keys: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(radix, pairs, documents) of sorted keys: pairs with their numbers of documents; documents of one pair after another with their numbers of links."""
    pair, doc = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    radix = (pair >> np.uint64(16)) % np.uint64(RADIX)
    for r in range(RADIX):
        mine = radix == r
        if mine.any():
            pairs, n = np.unique(pair[mine], return_counts=True)
            # differences compress better
            yield r, packed(np.diff(pairs, prepend=np.uint64(0)), n), packed(doc[mine], times[mine])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document with its measures, and the runs, which have a radix; settled, so that keys stay."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(path_a, path_b)
        first = TaskContext.get().partitionId() << 40
        schema = pa.schema([(c, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[k]) for c, k in (x.split(" ") for x in ROW.split(", "))])

        def done(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
            measures, digests, keys, times = aligned(both, texts)
            named = {"key": np.arange(first, first + len(ids)), "doc_id": pa.array(ids, pa.int64()), **{c: measures[:, k] for k, c in enumerate(MEASURES)}, "groups_sha256": digests}
            yield pa.RecordBatch.from_arrays([pa.array(named[c], k) if c in named else pa.nulls(len(ids), k) for c, k in zip(schema.names, schema.types, strict=True)], schema=schema)
            rows = [{"key": first, "radix": r, "turn": first, "pairs": p, "documents": d} for r, p, d in runs_of(keys, times)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(doc_id)
                texts.append(text)
                held += len(text) + 64
                if held > BATCH_BYTES:
                    yield from done(ids, texts)
                    first += len(ids)
                    ids, texts, held = [], [], 0
        yield from done(ids, texts)

    return settle(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, ROW))


def merged_counts(runs: DataFrame, salts: int) -> DataFrame:
    """(radix, a, bs, counts, best): per id of A its pairs with their numbers of documents and the highest of these; settled."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # no order within a group: the heap makes it
    dealt = runs.select("radix", F.pmod(F.xxhash64("turn"), F.lit(salts)).alias("salt"), "pairs").repartition(parts, "radix", "salt").sortWithinPartitions("radix", "salt")

    def stream(raw: bytes) -> Iterator[tuple[int, int]]:
        steps, n = unpacked(raw, 2)
        return zip(np.cumsum(steps, dtype=np.uint64).tolist(), n.tolist(), strict=True)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(held: list[bytes]) -> pa.RecordBatch:
            pairs, counts, last = array("Q"), array("Q"), None
            for pair, n in heapq.merge(*map(stream, held)):
                if pair == last:
                    counts[-1] += n
                else:
                    pairs.append(pair)
                    counts.append(n)
                    last = pair
            pairs = np.frombuffer(pairs, np.uint64) if pairs else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array((pairs >> np.uint64(16)).astype(np.int32)), pa.array((pairs & np.uint64(0xFFFF)).astype(np.int32)), pa.array(np.array(counts, np.int64))], ["a", "b", "n"])

        group, held = None, []
        for batch in batches:
            for radix, salt, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (group != (radix, salt) or len(held) == RUNS):
                    yield merged(held)
                    held = []
                group = radix, salt
                held.append(raw)
        if held:
            yield merged(held)

    counts = dealt.mapInArrow(made, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # at most as many rows in one list as B has ids
    sides_ = counts.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("x"))
    return settle(sides_.select((F.col("a") % RADIX).cast("int").alias("radix"), "a", F.col("x.b").alias("bs"), F.col("x.n").alias("counts"), F.array_max("x.n").alias("best")))


def contributions(runs: DataFrame, counts: DataFrame, salts: int) -> DataFrame:
    """(key, n_best, count_sum): what each run gives to its documents; several rows for one document."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = {c: F.lit(None).cast(k).alias(c) for c, k in (("a", "int"), ("bs", "array<int>"), ("counts", "array<bigint>"), ("best", "bigint"), ("key", "bigint"), ("pairs", "binary"), ("documents", "binary"))}
    heads = counts.select("radix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"), "a", "bs", "counts", "best", none["key"], none["pairs"], none["documents"])
    tails = runs.select("radix", F.pmod(F.xxhash64("turn"), F.lit(salts)).alias("salt"), none["a"], none["bs"], none["counts"], none["best"], "key", "pairs", "documents")
    rows = heads.unionByName(tails).repartition(parts, "radix", "salt").sortWithinPartitions("radix", "salt", F.col("a").asc_nulls_last())

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, known = None, [], None
        for batch in batches:
            out = []
            for radix, salt, a, bs, counts_, best, key, pairs, documents in zip(*batch.columns, strict=True):
                at = radix.as_py(), salt.as_py()
                if at != group:
                    group, held, known = at, [], None
                if a.as_py() is not None:
                    # A's ids ascend, so that the pairs do
                    b = bs.values.to_numpy().astype(np.uint64)
                    n = counts_.values.to_numpy()
                    held.append((np.uint64(a.as_py()) << np.uint64(16) | b, n, n == best.as_py()))
                    continue
                if known is None:
                    known, held = [np.concatenate(x) for x in zip(*held, strict=True)], []
                steps, n_docs = unpacked(pairs.as_py(), 2)
                place = np.repeat(np.searchsorted(known[0], np.cumsum(steps, dtype=np.uint64)), n_docs)
                doc, times = unpacked(documents.as_py(), 2)
                found, which = np.unique(doc, return_inverse=True)
                n_best, count_sum = (np.zeros(len(found), np.int64) for _ in range(2))
                np.add.at(n_best, which, times * known[2][place])
                np.add.at(count_sum, which, times * known[1][place])
                out.append((key.as_py() + found.astype(np.int64), n_best, count_sum))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["key", "n_best", "count_sum"])

    return rows.mapInArrow(made, "key bigint, n_best bigint, count_sum bigint")


def compared(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, its tokens, groups and links, those of the best pairs, the sum of the pairs' counts, and a digest of the groups."""
    default = default_paths()
    rows = align(docs, path_a or default[0], path_b or default[1])
    runs = rows.filter("radix IS NOT NULL")
    n_runs = max((r["n"] for r in runs.groupBy("radix").agg(F.count(F.lit(1)).alias("n")).collect()), default=0)
    counts = merged_counts(runs, n_runs // RUNS + 1)
    sums = contributions(runs, counts, n_runs // STREAM + 1).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.filter("radix IS NULL").join(sums, "key", "left").fillna(0, ["n_best", "count_sum"])
    return out.select("doc_id", *MEASURES, "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents"))
