"""Encoding with a public byte-level BPE vocabulary by merge replay over all distinct words of a slice at once."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenizer pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered between slices; more are encoded again when they recur.
MEMO_WORDS = 400_000


def load_ranks(path: str = TOKENIZER) -> dict[bytes, int]:
    """Token bytes to id, read on the driver; the executors get it as a broadcast of fixed size."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    """Replays merges in rank order over many words at once.

    An inverted index keeps, for every rank that some adjacent pair would give, the positions of such pairs in all
    words. The lowest rank is taken from a heap, all its positions are merged from left to right, and only the
    pairs with the two neighbours of a merged position are looked up again.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.byte_id = [ranks[bytes([i])] for i in range(256)]
        self.spelling = {i: b for b, i in ranks.items()}
        self.pair_id: dict[tuple[int, int], int] = {}

    def _merged(self, a: int, b: int) -> int:
        key = (a, b)
        got = self.pair_id.get(key)
        if got is None:
            got = self.pair_id[key] = self.ranks.get(self.spelling[a] + self.spelling[b], -1)
        return got

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        ids: list[int] = []
        nxt: list[int] = []
        starts: list[int] = []
        merged, byte_id = self._merged, self.byte_id
        at: dict[int, list[int]] = {}
        for w in words:
            start = len(ids)
            starts.append(start)
            whole = self.ranks.get(w)
            if whole is not None:
                ids.append(whole)
                nxt.append(-1)
                continue
            sym = [byte_id[c] for c in w]
            ids += sym
            nxt += [*range(start + 1, start + len(sym)), -1]
            for k in range(len(sym) - 1):
                m = merged(sym[k], sym[k + 1])
                if m >= 0:
                    at.setdefault(m, []).append(start + k)
        prv = [-1] * len(ids)
        for i, j in enumerate(nxt):
            if j >= 0:
                prv[j] = i
        heap = list(at)
        heapq.heapify(heap)
        while heap:
            m = heapq.heappop(heap)
            for i in sorted(at.pop(m)):
                j = nxt[i]
                # stale: the position was merged away or its pair has changed
                if j < 0 or ids[i] < 0 or merged(ids[i], ids[j]) != m:
                    continue
                ids[i], ids[j] = m, -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prv[k] = i
                    new = merged(m, ids[k])
                    if new >= 0:
                        if new not in at:
                            at[new] = []
                            heapq.heappush(heap, new)
                        at[new].append(i)
                h = prv[i]
                if h >= 0:
                    new = merged(ids[h], m)
                    if new >= 0:
                        if new not in at:
                            at[new] = []
                            heapq.heappush(heap, new)
                        at[new].append(h)
        out = []
        for s in starts:
            word, i = [], s
            while i >= 0 and i < len(ids):
                word.append(ids[i])
                i = nxt[i]
            out.append(word)
        return out


class SliceEncoder:
    """Encodes slices of texts; the distinct unseen words of a slice share one replay."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.replay = MergeReplay(ranks)
        self.split = regex.compile(PATTERN)
        self.memo: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        memo = self.memo
        parts = [self.split.findall(t) if t else [] for t in texts]
        todo = list(dict.fromkeys(w for p in parts for w in p if w not in memo))
        if todo:
            # a lone surrogate cannot be encoded; it counts as the replacement character
            coded = [w.encode("utf-8", "replace") if w.isascii() else w.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode() for w in todo]
            memo.update(zip(todo, self.replay.encode_words(coded), strict=True))
        out = []
        for p in parts:
            ids: list[int] = []
            for w in p:
                ids += memo[w]
            out.append(ids)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, which bounds what long texts hold in memory at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
    flat = np.fromiter((x for r in rows for x in r), dtype=np.int32, count=int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def encode_corpus(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) for every row, without special tokens; null and empty texts have the empty list.

    The corpus is encoded slice by slice where it is read: no shuffle, and the work is proportional to the distinct
    words of a slice and the length of the result. Special tokens' strings in a text are ordinary text.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = SliceEncoder(ranks.value)
        for b in slices(batches):
            ids = _lists(enc.encode(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
