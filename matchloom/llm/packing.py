"""Problem 7: filling fixed-capacity containers with items, by vector best-fit.

An item is a document with its size in tokens of a public tokenizer; one longer than a container is split into parts
of the capacity and a rest. Items are spread by hash over shards of about `SHARD` items, so that no task grows with
the input and each still has enough small items to fill gaps. Within a shard items are placed largest first; each goes
into the open container that has room in every dimension (tokens, documents, attention cost) and whose residual vector
after placing has the smallest weighted norm; a container too full for the smallest item still to come is closed. The
attention cost of an item is the square of its tokens; a container holds `ATTENTION` of what one full item costs, so
that two long items do not meet even where their tokens fit. An item that costs more than that by itself is alone.

Results for odd input: null and empty texts are items of size zero and take a document's place in a container; equal
sizes go by doc_id and part; repeated doc_ids are separate items; an empty table gives no containers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .token_tree import token_counts

CAPACITY = 4096  # tokens of a container
DOCUMENTS = 128  # documents of a container
ATTENTION = 0.75  # attention cost of a container, in that of one item of its capacity
SHARD = 5000  # items of a shard, about
WEIGHTS = (1.0, 0.05, 0.1)  # of the residual's dimensions


def vector_best_fit(sizes: np.ndarray, capacity: int, documents: int, attention: float, weights=WEIGHTS) -> np.ndarray:
    """Container number of each item; sizes descending, none above the capacity."""
    n = len(sizes)
    where = np.empty(n, np.int64)
    need = np.column_stack([sizes / capacity, np.full(n, 1 / documents), sizes.astype(float) ** 2 / attention])
    smallest = sizes[-1] / capacity if n else 0.0
    least = float(sizes[-1]) ** 2 / attention if n else 0.0
    scale = np.sqrt(np.array(weights))
    room = np.empty((64, 3))
    ids = np.empty(64, np.int64)
    open_, made = 0, 0
    slack = 1e-9
    for i in range(n):
        w = need[i]
        left = room[:open_] - w
        fits = np.flatnonzero((left >= -slack).all(axis=1))
        if len(fits):
            norm = ((left[fits] * scale) ** 2).sum(axis=1)
            k = fits[int(norm.argmin())]
            room[k] = left[k]
        else:
            if open_ == len(room):
                room = np.concatenate([room, np.empty_like(room)])
                ids = np.concatenate([ids, np.empty_like(ids)])
            k = open_
            room[k], ids[k] = 1.0 - w, made
            open_, made = open_ + 1, made + 1
        where[i] = ids[k]
        if room[k, 0] < smallest - slack or room[k, 1] < 1 / documents - slack or room[k, 2] < least - slack:  # closed: nothing to come fits
            open_ -= 1
            room[k], ids[k] = room[open_], ids[open_]
    return where


def pack(
    items: DataFrame, count: int, capacity: int = CAPACITY, documents: int = DOCUMENTS, attention: float | None = None, shard: int = SHARD
) -> DataFrame:
    """items (doc_id, tokens) -> (doc_id, part, tokens, container). count: about how many parts; container: 'shard-number'."""
    attention = attention or ATTENTION * float(capacity) ** 2
    parts = items.select(
        "doc_id", F.posexplode(F.expr(f"""case when tokens <= {capacity} then array(tokens)
        else transform(sequence(0, cast(ceil(tokens / {capacity}) as int) - 1), k -> least({capacity}, tokens - k * {capacity})) end""")).alias("part", "tokens"),
    )
    shards = max(1, round(count / shard))
    sharded = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int"))

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True])
        where = vector_best_fit(frame["tokens"].to_numpy(), capacity, documents, attention)
        frame["container"] = [f"{key[0]}-{c}" for c in where]
        return frame[["doc_id", "part", "tokens", "container"]]

    return sharded.repartition(shards, "shard").groupBy("shard").applyInPandas(run, "doc_id bigint, part int, tokens int, container string")


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, in tokens of byte_bpe_50k."""
    items = checkpointed(token_counts(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "tokens"))
    parts = items.select(F.sum(F.greatest(F.ceil(F.col("tokens") / CAPACITY), F.lit(1)))).first()[0] or 0
    return pack(items, parts)
