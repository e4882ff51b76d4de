"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A piece of text (a match of the split pattern) starts as one symbol per byte. The leaves of the tree hold the ranks of
its adjacent pairs, each inner node the smaller of its two children by rank, then by position, so the root names the
leftmost pair of lowest rank. A merge changes three leaves at most, each update climbs one path, and the work on a piece
of n bytes is n log n whatever its content. Pieces that return are looked up in a bounded cache.

The tokenizer file is a parameter and is read by each Python worker. Each row is encoded on its own: no shuffle.

Nulls, ties, repeats: null text counts as empty and has no tokens; equal ranks merge from the left; identical rows give
identical results; an empty table gives an empty result; columns beyond doc_id and text don't matter. Strings of special
tokens in a text become those tokens, the longest first.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, table

# Fixed value: the split pattern of byte-level BPE, white space spelt out as Unicode's White_Space.
SPACES = r"\t-\r \x85\xa0  -     　"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Pieces that a Python worker remembers, and their length at most.
CACHE, CACHED_CHARS = 1 << 19, 32
#: Bytes of text in a batch that goes back to Spark.
BATCH_BYTES = 4 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBPE:
    def __init__(self, path: str, cache: int):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        id_of = {b: i for i, b in self.bytes_of.items()}
        self.first = [id_of[bytes([b])] for b in range(256)]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.special_pattern = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.special, key=lambda t: (-len(t), t)))) if self.special else None
        self.remembered = lru_cache(cache)(self.encode_piece)

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one piece, packed as unsigned 32-bit integers."""
        ids = [self.first[b] for b in piece.encode("utf-8")]
        n = len(ids)
        if n > 1:
            self.merge(ids, n)
        return array("I", [i for i in ids if i >= 0]).tobytes()

    def merge(self, ids: list[int], n: int) -> None:
        """Merges in place; a symbol that has gone into its left neighbour becomes -1. A node's value is rank * n + position."""
        rank_of, merged, none = self.ranks.get, self.merged, 1 << 62
        ranks = [rank_of(a << 20 | b) for a, b in zip(ids, ids[1:], strict=False)]
        leaves = [none if r is None else r * n + i for i, r in enumerate(ranks)]
        size = 1 << (n - 2).bit_length()
        tree = [none] * size + leaves + [none] * (size - n + 1)
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while (top := tree[1]) < none:
            rank, i = divmod(top, n)
            j = after[i]
            ids[i], ids[j] = new, _ = merged[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                r = rank_of(new << 20 | ids[k])
                self.update(tree, size + i, none if r is None else r * n + i)
                self.update(tree, size + j, none)
            else:
                self.update(tree, size + i, none)
            if (h := before[i]) >= 0:
                r = rank_of(ids[h] << 20 | new)
                self.update(tree, size + h, none if r is None else r * n + h)

    @staticmethod
    def update(tree: list[int], k: int, value: int) -> None:
        """Sets a leaf and the nodes above it, as far up as they change."""
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:
                return
            tree[k] = value

    def encode(self, text: str) -> bytes:
        if not self.special_pattern or not self.special_pattern.search(text):
            return self.encode_plain(text)
        out = []
        for part in self.special_pattern.split(text):
            if part:
                out.append(array("I", [self.special[part]]).tobytes() if part in self.special else self.encode_plain(part))
        return b"".join(out)

    def encode_plain(self, text: str) -> bytes:
        remembered, plain = self.remembered, self.encode_piece
        return b"".join([remembered(p) if len(p) <= CACHED_CHARS else plain(p) for p in PATTERN.findall(text)])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str, cache: int = CACHE) -> ByteBPE:
    return ByteBPE(path, cache)


def tokenised(docs: DataFrame, path: str | None = None, cache: int = CACHE, keep: bool = True) -> DataFrame:
    """(doc_id, ids, decoded) per row of docs: ids as little-endian unsigned 32-bit integers, and the text they decode to.

    cache: pieces that a Python worker remembers, about 300 bytes each. keep: whether a worker keeps the tokenizer and these
    for its next tasks; otherwise each task reads the file, and nothing is left beside other stages.
    """
    path = path or default_path()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, cache) if keep else ByteBPE(path, cache)
        for batch in batches:
            ids, packed, texts, held = [], [], [], 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                codes = bpe.encode(text.as_py() or "")
                ids.append(doc_id.as_py())
                packed.append(codes)
                texts.append(bpe.decode(codes))
                held += 2 * len(codes)
                if held > BATCH_BYTES:
                    yield made()
                    ids, packed, texts, held = [], [], [], 0
            yield made()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encoded if keep else releasing(encoded), "doc_id bigint, ids binary, decoded string")


def digests(tokens: DataFrame, *more: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and the columns named."""
    return tokens.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(tokenised(table(spark, sf_dir, "documents")))
