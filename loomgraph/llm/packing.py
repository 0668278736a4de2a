"""Filling fixed-capacity containers: each seed document is joined by its lexical neighbours."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.tokens import TOKENIZER, SliceEncoder, load_ranks, slices
from loomgraph.runtime import staged

K1, B = 1.2, 0.75
#: Documents of one shard; a shard is packed in one task, so this bounds a task's memory.
SHARD_DOCS = 20_000


def token_profiles(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, terms, tf): size in tokens and the distinct token ids with their counts, per row."""
    ranks = documents.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = SliceEncoder(ranks.value)
        for b in slices(batches):
            n, terms, tf = [], [], []
            for ids in enc.encode(b.column("text").to_pylist()):
                t, c = np.unique(np.array(ids, dtype=np.int32), return_counts=True)
                n.append(len(ids))
                terms.append(t.tolist())
                tf.append(c.tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "terms", "tf"]
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, terms array<int>, tf array<int>"
    )


def term_weights(profiles: DataFrame) -> tuple[np.ndarray, float]:
    """(idf by token id, mean document length) over all documents; at most one row per id of the vocabulary."""
    n, mean = profiles.where("n_tokens > 0").agg(F.count("*"), F.avg("n_tokens")).first()
    df = profiles.select(F.explode("terms").alias("t")).groupBy("t").count().toPandas()
    idf = np.zeros(int(df["t"].max()) + 1 if len(df) else 1, dtype=np.float32)
    if len(df):
        idf[df["t"].to_numpy()] = np.log1p((n - df["count"].to_numpy() + 0.5) / (df["count"].to_numpy() + 0.5))
    return idf, float(mean or 1.0)


def pack_shard(doc_id: list[int], part: list[int], size: list[int], terms: list[np.ndarray], weights: list[np.ndarray], capacity: int) -> list[int]:
    """Container number of every item of one shard; no item is larger than ``capacity``.

    Seeds go from large to small (ties by doc_id and part). A seed's unused neighbours by BM25 over the shard's
    inverted index of all terms fill its window, best first; what no neighbour fits is filled with the largest unused item that
    does, until none does.
    """
    n = len(size)
    index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if n:
        at = np.repeat(np.arange(n), [len(t) for t in terms])
        term, weight = np.concatenate(terms), np.concatenate(weights)
        by = np.argsort(term, kind="stable")
        begin = np.flatnonzero(np.diff(term[by], prepend=-1))
        for b, e in zip(begin, np.append(begin[1:], len(by)), strict=True):
            if e - b > 1:
                index[int(term[by[b]])] = (at[by[b:e]], weight[by[b:e]])
    sizes_of, free = np.array(size, dtype=np.int64), np.ones(n, dtype=bool)
    box = [-1] * n
    order = sorted(range(n), key=lambda i: (-size[i], doc_id[i], part[i]))
    # unused items by size, for the gaps that neighbours leave
    left: dict[int, list[int]] = {}
    for i in reversed(order):
        left.setdefault(size[i], []).append(i)
    sizes = sorted(left)

    def largest(room: int) -> int:
        k = bisect.bisect_right(sizes, room) - 1
        while k >= 0:
            stack = left[sizes[k]]
            while stack and box[stack[-1]] >= 0:
                stack.pop()
            if stack:
                return stack[-1]
            sizes.pop(k)
            k -= 1
        return -1

    used = 0
    for seed in order:
        if box[seed] >= 0:
            continue
        box[seed], room = used, capacity - size[seed]
        free[seed] = False
        if room > 0:
            hits = [index[t] for t in terms[seed].tolist() if t in index]
            if hits:
                score = np.bincount(np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]), minlength=n)
                u = np.flatnonzero((score > 0) & free & (sizes_of <= room))
                for j in u[np.lexsort((u, -score[u]))].tolist():
                    if size[j] <= room:
                        box[j], room = used, room - size[j]
                        free[j] = False
                        if room <= 0:
                            break
            while room > 0 and (j := largest(room)) >= 0:
                box[j], room = used, room - size[j]
                free[j] = False
        used += 1
    return box


def pack_documents(documents: DataFrame, capacity: int = 2048, path: str = TOKENIZER, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(container_id, doc_id, part, n_tokens): every row of ``documents`` in exactly one container per part.

    A document of more than ``capacity`` tokens is cut into parts of ``capacity`` tokens and a rest; no other is
    split. Documents without tokens (null and empty texts) take no space: container_id null, part 0. Shards are
    formed by a hash of doc_id, so hot sources and copies spread evenly; term statistics cover all documents.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    profiles = staged(token_profiles(documents, path), "profiles")
    idf, mean = term_weights(profiles)
    shared = documents.sparkSession.sparkContext.broadcast((idf, mean))
    shards = max(1, -(-profiles.count() // shard_docs))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        idf, mean = shared.value
        pdf = pdf.sort_values("doc_id", kind="stable")
        ids, part, size, terms, weights = [], [], [], [], []
        for d, n, t, c in zip(pdf["doc_id"], pdf["n_tokens"], pdf["terms"], pdf["tf"], strict=True):
            t, c = np.asarray(t, dtype=np.int64), np.asarray(c, dtype=np.float64)
            w = idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * n / mean))
            for k in range(max(1, -(-int(n) // capacity))):
                ids.append(d)
                part.append(k)
                size.append(min(capacity, int(n) - k * capacity))
                terms.append(t)
                weights.append(w)
        full = [i for i in range(len(ids)) if size[i] > 0]
        box = pack_shard([ids[i] for i in full], [part[i] for i in full], [size[i] for i in full], [terms[i] for i in full], [weights[i] for i in full], capacity)
        name: list[str | None] = [None] * len(ids)
        for i, b in zip(full, box, strict=True):
            name[i] = f"{key[0]:06d}-{b:06d}"
        return pd.DataFrame({"container_id": name, "doc_id": ids, "part": part, "n_tokens": size})

    cut = profiles.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return cut.groupBy("shard").applyInPandas(pack, "container_id string, doc_id long, part int, n_tokens long")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(n_containers, n_items, n_tokens, fill): fill is the used share of all containers' space."""
    used = packed.where("container_id IS NOT NULL")
    return used.agg(
        F.count_distinct("container_id").alias("n_containers"), F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_tokens") / (F.count_distinct("container_id") * capacity)).alias("fill"),
    )
