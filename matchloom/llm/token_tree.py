"""Problem 6: encoding of the whole corpus with a public tokenizer, as a reduction over a monoid.

The monoid's elements are encoded stretches of text: the start offsets of their pre-tokens and the ids of each. Texts
are halved recursively; leaves are encoded by the library's own merges. Two neighbours are joined by encoding again a
window across the boundary. The pre-tokenizer scans left to right and a pre-token depends only on its characters and
at most `REACH` characters after its end, so on the left every pre-token that ends at least `REACH` characters before
the boundary stands. On the right the window grows until one of its pre-tokens starts where a pre-token of the right
half starts: from there on the two scans see the same text and agree. Byte-level merges never cross pre-tokens, so
the ids outside the window are those of the whole text. Decoding concatenates up the tree.

Each task keeps a bounded cache from pre-tokens to ids; rows are encoded where they lie, without a shuffle.

Results for odd input: null and empty texts give an empty list; strings that look like special tokens are ordinary
text; texts of any length are encoded whole; other columns of the input are dropped, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

REACH = 3  # characters after its end that can still change a pre-token ('re needs two, a run of spaces one)
LEAF = 8192  # characters up to which a text is encoded at once
CACHE = 300_000  # pre-tokens kept per Python worker


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Piece(NamedTuple):
    """An encoded stretch: text, start of each pre-token, ids of each pre-token."""

    text: str
    starts: list[int]
    ids: list[tuple[int, ...]]


class TreeEncoder:
    def __init__(self, path: str | None = None, leaf: int = LEAF):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path or vocabulary_path(), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.by_id = {v: k for k, v in ranks.items()}
        self.leaf = leaf
        self.cache: dict[str, tuple[int, ...]] = {}

    def _ids(self, token: str) -> tuple[int, ...]:
        got = self.cache.get(token)
        if got is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            got = self.cache[token] = tuple(self.bpe.encode_ordinary(token))
        return got

    def encode_leaf(self, text: str) -> Piece:
        found = [(m.start(), self._ids(m.group())) for m in self.pattern.finditer(text)]
        return Piece(text, [s for s, _ in found], [i for _, i in found])

    def join(self, left: Piece, right: Piece) -> Piece:
        """The monoid's operation; the empty piece is its neutral element."""
        if not left.text or not right.text:
            return left if left.text else right
        text, cut = left.text + right.text, len(left.text)
        keep = len(left.starts)
        while keep and (left.starts[keep] if keep < len(left.starts) else cut) > cut - REACH:
            keep -= 1
        begin = left.starts[keep] if keep < len(left.starts) else cut
        known = {s + cut: i for i, s in enumerate(right.starts)}
        starts, ids, rest = left.starts[:keep], left.ids[:keep], len(right.starts)
        for m in self.pattern.finditer(text, begin):
            if m.start() in known:
                rest = known[m.start()]
                break
            starts.append(m.start())
            ids.append(self._ids(m.group()))
        return Piece(text, starts + [s + cut for s in right.starts[rest:]], ids + right.ids[rest:])

    def encode_tree(self, text: str) -> Piece:
        if len(text) <= self.leaf:
            return self.encode_leaf(text)
        half = len(text) // 2
        return self.join(self.encode_tree(text[:half]), self.encode_tree(text[half:]))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        if len(text) <= self.leaf:  # a single leaf needs no offsets
            cache, miss = self.cache, self._ids
            for token in self.pattern.findall(text):
                out += cache.get(token) or miss(token)
            return out
        for ids in self.encode_tree(text).ids:
            out += ids
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) <= self.leaf:
            cache, miss = self.cache, self._ids
            return sum(len(cache.get(token) or miss(token)) for token in self.pattern.findall(text))
        return sum(map(len, self.encode_tree(text).ids))

    def decode(self, ids: list[int]) -> str:
        """Bytes of the ids, concatenated up the tree."""

        def up(lo: int, hi: int) -> bytes:
            if hi - lo <= 4096:
                return b"".join(self.by_id[i] for i in ids[lo:hi])
            mid = (lo + hi) // 2
            return up(lo, mid) + up(mid, hi)

        return up(0, len(ids)).decode("utf-8", "replace")


_encoders: dict[tuple[str | None, int], TreeEncoder] = {}


def encoder(path: str | None = None, leaf: int = LEAF) -> TreeEncoder:
    """One encoder per Python worker, whose cache lives on between tasks."""
    key = (path, leaf)
    if key not in _encoders:
        _encoders[key] = TreeEncoder(path, leaf)
    return _encoders[key]


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf)
        for batch in batches:
            flat: list[int] = []
            offsets = [0]
            for text in batch.column(1).to_pylist():
                flat += enc.encode(text)
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} bigint, ids array<int>")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, tokens, chars) of every row; zero for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = pa.array([enc.count(t) for t in texts], pa.int32())
            chars = pa.array([len(t or "") for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, chars], names=[id_col, "tokens", "chars"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} bigint, tokens int, chars int")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of each document's text by byte_bpe_50k, without special tokens."""
    return encode_corpus(spark.read.parquet(f"{folder}/documents.parquet"))
