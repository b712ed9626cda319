"""Length buckets with least padding, and token-budget batches inside them.

Texts longer than the context are cut into chunks of at most ``context`` tokens. The global
histogram of chunk lengths, rounded up to ``step``, has at most ``context / step`` bins, whatever the
corpus; a dynamic program over it chooses the ``buckets`` upper limits with the least padding. Chunks
of a bucket are numbered in the order of (doc_id, chunk); ``budget // limit`` of them form a batch.

Null and empty texts have length 0 and no chunk: they come back with no batch (nulls), never
dropped. Null ids come first; equal ids are ordered by a hash of the text. Of equally good limits
the smaller ones are chosen.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.pieces import encoder
from fleetcast.llm.words import slices, text_bytes
from fleetcast.operators.ordered import CHUNK, POS, order_chunks, with_index
from fleetcast.session import stage

CONTEXT = 2048
STEP = 16
BUCKETS = 8
BUDGET = 1 << 15


def word_count(text: Column) -> Column:
    """Words between blanks (space and the controls 09-0D), plus one for the end of the text; empty texts have none."""
    words = F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    return F.when(F.coalesce(words, F.lit(0)) > 0, words + 1).otherwise(0).cast("long")


def token_count(text: Column, vocabulary: str) -> Column:
    """Tokens of the vocabulary, plus one for the end of the text; empty texts have none."""

    def count(texts: pa.Array) -> pa.Array:
        words, out = encoder(vocabulary), []
        for part in slices(pa.record_batch({"text": texts}), "text", 1 << 20):
            raw, at = text_bytes(part.column("text"))
            start, slot = words.pieces(raw, at)
            total = np.concatenate([[0], np.cumsum(words.counts(slot))])
            many = np.diff(total[np.searchsorted(start, at)])
            out.append(many + (many > 0))
        return pa.array(np.concatenate([np.zeros(0, np.int64), *out]), pa.int64())

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(count, "long")(text)


def best_limits(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Upper limits of at most ``buckets`` buckets over distinct rounded ``lengths`` (ascending) with the least padded tokens."""
    size = np.asarray(lengths, np.int64)
    before = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
    n = len(size)
    best = size * before[1:]  # one bucket over the first i + 1 lengths
    came = [np.full(n, -1)]
    for _ in range(1, min(buckets, n)):
        # the last bucket takes lengths j + 1 .. i and is as wide as the longest
        cost = best[None, :] + size[:, None] * (before[1:, None] - before[None, 1:])
        cost[np.triu_indices(n)] = np.iinfo(np.int64).max
        j = cost.argmin(axis=1)
        split = cost[np.arange(n), j]
        came.append(np.where(split < best, j, -2))  # -2: fewer buckets are as good
        best = np.minimum(best, split)
    limits, i, k = [], n - 1, len(came) - 1
    while i >= 0:
        while k and came[k][i] == -2:
            k -= 1
        limits.append(int(size[i]))
        i, k = (int(came[k][i]), k - 1) if k else (-1, k)
    return limits[::-1]


def pack(
    docs: DataFrame,
    length: Column,
    *,
    doc_id: str = "doc_id",
    tie: Column | None = None,
    context: int = CONTEXT,
    step: int = STEP,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """One row per chunk: doc_id, chunk, n_tokens, bucket (its limit), batch (inside the bucket) and slot.

    Only ids and lengths move. Numbering uses a range partitioning of (bucket, id, chunk), so a
    bucket with most of the rows spreads over all tasks.
    """
    chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / context).cast("int") - 1, F.lit(0)))
    cut = stage(docs.select(F.col(doc_id).alias("doc_id"), length.cast("long").alias("_n"), (tie if tie is not None else F.lit(0)).alias("_tie")))
    rows = cut.select("doc_id", "_tie", "_n", F.explode(chunks).alias("chunk"))
    rows = rows.withColumn("n_tokens", F.least(F.lit(context).cast("long"), F.col("_n") - F.col("chunk") * context)).drop("_n")
    rounded = (F.ceil(F.col("n_tokens") / step) * step).cast("long")
    # at most context / step rows
    bins = sorted((r[0], r[1]) for r in rows.filter("n_tokens > 0").groupBy(rounded.alias("l")).agg(F.count(F.lit(1))).collect())
    limits = best_limits([b[0] for b in bins], [b[1] for b in bins], buckets) if bins else []
    bucket = F.lit(None).cast("long")
    for limit in reversed(limits):
        bucket = F.when(rounded <= limit, F.lit(limit).cast("long")).otherwise(bucket)
    placed = rows.withColumn("bucket", F.when(F.col("n_tokens") > 0, bucket))
    numbered = with_index(order_chunks(placed, ["bucket", "doc_id", "_tie", "chunk"]))
    first = {r[0]: r[1] for r in numbered.groupBy("bucket").agg(F.min("_idx")).collect()}  # a row a bucket
    base = F.lit(None).cast("long")
    for limit, low in first.items():
        base = F.when(F.col("bucket").eqNullSafe(F.lit(limit).cast("long")), F.lit(low).cast("long")).otherwise(base)
    place = F.col("_idx") - base
    per = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket")).cast("long"))
    return numbered.select(
        "doc_id",
        F.col("chunk").cast("long").alias("chunk"),
        "n_tokens",
        "bucket",
        F.floor(place / per).cast("long").alias("batch"),
        F.when(F.col("bucket").isNotNull(), place % per).alias("slot"),
    ).withColumn("batch", F.when(F.col("bucket").isNotNull(), F.col("batch")))


def batch_table(packed: DataFrame) -> DataFrame:
    """Batches with their rows, tokens and padding."""
    rows = packed.filter(F.col("bucket").isNotNull()).groupBy("bucket", "batch")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("bucket") - F.col("n_tokens")).alias("padding")
    )
