"""Byte-pair encoding and decoding by tree concatenation.

Texts up to leaf_chars are encoded where they lie. A longer text is cut into
leaves that are encoded in parallel, wherever in the cluster there is room:
at places where the pre-tokenizer must split whatever surrounds them, and,
inside a run that it doesn't split, in halves of halves. The halves of such a
run are joined two by two: the bytes around the join are encoded again in a
window that grows until its first token is the one that the left side has
there and its last token the one that the right side has. Two neighbouring
tokens of a byte-pair encoding stay valid wherever they stand, so the joined
sequence is then exactly the encoding of the whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, lean, list_array, slices, small_batches, tokenizer_path

#: The pre-tokenizer of the public 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 32768
OUT = "doc_id long, n_tokens int, token_ids array<int>, round_trip boolean"


class Bpe:
    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def encode_piece(self, piece: bytes) -> list[int]:
        """The encoding of bytes that the pre-tokenizer doesn't split."""
        return self.encoding._core_bpe.encode_single_piece(piece) if piece else []

    def decode(self, ids) -> bytes:
        return b"".join([self.pieces[i] for i in ids])

    def decode_any(self, ids) -> str:
        """The text of ids that may be none of ours: nulls are passed over, an id that isn't in the vocabulary gives U+FFFD, as do bytes that aren't UTF-8."""
        n = len(self.pieces)
        return b"".join([self.pieces[i] if 0 <= i < n else b"\xef\xbf\xbd" for i in ids if i is not None]).decode(errors="replace")

    def leaves(self, text: str, leaf: int) -> Iterator[tuple[int, bytes]]:
        """(run, bytes): leaves of one run above 0 are parts of one unsplit piece; run 0 is a text of its own."""
        at, n, run = 0, len(text), 0
        while n - at > leaf:
            cut = at + leaf
            while (cut := text.rfind(" ", at + 1, cut)) > 0:
                if not text[cut - 1].isspace() and not text[cut + 1].isspace():
                    break
            if cut > 0:
                yield 0, text[at:cut].encode()
                at = cut
                continue
            end = 0
            for m in self.pattern.finditer(text, at):
                if m.end() - at > leaf:
                    break
                if not m.group().isspace():
                    end = m.end()
            if end:
                yield 0, text[at:end].encode()
                at = end
                continue
            m = self.pattern.match(text, at)
            run += 1
            parts = 1
            while (m.end() - at) / parts > leaf:
                parts *= 2
            edges = [at + (m.end() - at) * i // parts for i in range(parts + 1)]
            for a, b in zip(edges, edges[1:]):
                yield run, text[a:b].encode()
            at = m.end()
        if at < n:
            yield 0, text[at:].encode()

    def join(self, left: list[int], right: list[int], window: int = 32) -> list[int]:
        """The encoding of an unsplit piece from those of its halves."""
        if not left or not right:
            return left or right
        size = lambda t: len(self.pieces[t])
        while True:
            i, width = len(left), 0
            while i and width < window:
                i -= 1
                width += size(left[i])
            j, width = 0, 0
            while j < len(right) and width < window:
                width += size(right[j])
                j += 1
            mid = self.encode_piece(self.decode(left[i:]) + self.decode(right[:j]))
            agrees_left = i == 0 or mid[0] == left[i]
            agrees_right = j == len(right) or mid[-1] == right[j - 1]
            if agrees_left and agrees_right and (len(mid) > 1 or (i == 0 and j == len(right))):
                return left[:i] + mid + right[j:]
            window *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def encode_tree(self, text: str, leaf: int) -> list[int]:
        """What the cluster does with a long text, in one process."""
        out, run, parts = [], 0, []
        for r, piece in [*self.leaves(text, leaf), (0, b"")]:
            if run and r != run:
                out += self.tree(parts)
                parts = []
            if r:
                parts.append(self.encode_piece(piece))
            else:
                out += self.encode(piece.decode()).tolist()
            run = r
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        empty = np.zeros(0, dtype=np.uint32)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = column(batch, "text").to_pylist()
                ids = [empty if x is None else bpe.encode(x) for x in texts]
                valid = [x is not None for x in texts]
                back = [None if x is None else bpe.decode(i.tolist()) == x.encode() for x, i in zip(texts, ids)]
                lengths = [len(x) for x in ids]
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                counts = pa.array([n if v else None for n, v in zip(lengths, valid)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id"), counts, list_array(flat, lengths, pa.int32(), valid), pa.array(back, pa.bool_())],
                    names=["doc_id", "n_tokens", "token_ids", "round_trip"],
                )

    return run


def _leaf_batches(path: str, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for k, text in enumerate(column(batch, "text").to_pylist()):
                rows = list(bpe.leaves(text, leaf))
                row = batch.slice(k, 1)
                take = pa.array(np.zeros(len(rows), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [column(row, "doc_id").take(take), column(row, "key").take(take), pa.array(range(len(rows)), pa.int32()), pa.array([r for r, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())],
                    names=["doc_id", "key", "seq", "run", "piece"],
                )

    return run


def _encode_leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for batch in slices(whole, "piece"):
                pairs = zip(column(batch, "run").to_pylist(), column(batch, "piece").to_pylist())
                ids = [np.asarray(bpe.encode_piece(p) if r else bpe.encode(p.decode()), dtype=np.int32) for r, p in pairs]
                tokens = list_array(np.concatenate(ids), [len(x) for x in ids], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(column(batch, c) for c in ("doc_id", "key", "seq", "run")), tokens], names=["doc_id", "key", "seq", "run", "tokens"]
                )

    return run


def _join_leaves(path: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bpe = load(path)
        copies = int((pdf["seq"] == 0).sum())
        pdf = pdf.drop_duplicates("seq").sort_values("seq")
        out: list[int] = []
        parts: list[list[int]] = []
        last = 0
        for r, tokens in [*zip(pdf["run"], pdf["tokens"]), (0, [])]:
            if last and r != last:
                out += bpe.tree(parts)
                parts = []
            if r:
                parts.append(list(tokens))
            else:
                out += list(tokens)
            last = r
        import xxhash

        first = pdf.iloc[0]
        same = xxhash.xxh64_intdigest(bpe.decode(out), seed=42) == int(first["key"]) % (1 << 64)
        ids = pd.array([None if pd.isna(first["doc_id"]) else int(first["doc_id"])] * copies, dtype="Int64")
        return pd.DataFrame({"doc_id": ids, "n_tokens": len(out), "token_ids": [out] * copies, "round_trip": same})

    return run


def encode(docs: DataFrame, path: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, token_ids and round_trip (the ids decode to the very text) of every row.

    A null text gives null in the other three, an empty one no tokens. Repeated
    rows and equal or null doc_ids keep a row each; other columns are ignored;
    an empty table gives an empty one. Any length of text is encoded whole.
    """
    small_batches(docs.sparkSession)
    path = tokenizer_path(path)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > leaf_chars
    short = base.where(~is_long).mapInArrow(lean(_encode_batches(path)), OUT)
    leaves = (
        base.where(is_long)
        .withColumn("key", F.xxhash64("text"))
        .mapInArrow(lean(_leaf_batches(path, leaf_chars)), "doc_id long, key long, seq int, run int, piece binary")
        .repartition("doc_id", "key", "seq")
        .mapInArrow(lean(_encode_leaves(path)), "doc_id long, key long, seq int, run int, tokens array<int>")
    )
    return short.unionByName(leaves.groupBy("doc_id", "key").applyInPandas(_join_leaves(path), OUT))


def _decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = column(batch, "token_ids").to_pylist()
            texts = [None if x is None else bpe.decode_any(x) for x in ids]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of token_ids.

    Null token_ids give a null text, an empty list an empty one. Null members are
    passed over; an id that the vocabulary lacks, negative ones too, gives U+FFFD, as do
    bytes that aren't UTF-8. Repeated rows and equal or null doc_ids keep a row
    each; other columns are ignored; an empty table gives an empty one.
    """
    cols = F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")
    return encoded.select(*cols).mapInArrow(lean(_decode_batches(tokenizer_path(path))), "doc_id long, text string")
