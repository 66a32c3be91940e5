"""Filling fixed-capacity containers with documents (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnesis.shared import materialise, spread

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Items that one packer sees. Fixed, so that a task's work does not grow with the corpus; the last
#: windows of a block that stay open are a fraction of a per cent of its windows.
BLOCK_ITEMS = 20_000

_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoder(ranks: bytes):
    """A byte-level tokenizer from the content of a file of ranks."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of whole texts; null texts have 0 tokens.

    The file of ranks (a public vocabulary, about a megabyte) is read on the driver and sent to the tasks.
    """
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks.value).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in pdf["text"]]})

    return spread(documents.select("doc_id", "text")).mapInPandas(count, "doc_id bigint, n_tokens bigint")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number and offset for each item (1 <= size <= capacity), placed in the given order.

    ``level[h]`` counts the open containers filled to ``h``. Each item goes where the sum of
    ``level[h] ** 2`` over partly filled levels becomes least: lifting a container from ``h`` to
    ``h + s`` changes it by ``-2 level[h] + 1`` and ``+2 level[h + s] + 1``; a container that
    becomes full leaves the sum. Among equals the fullest container is taken.
    """
    level = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n_bins = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), 0
    for k, s in enumerate(sizes):
        s = int(s)
        # from level h = 0 .. capacity - s; h = 0 opens a container, h = capacity - s fills one
        gain = 2 * level[s : capacity + 1] + 1
        gain[-1] = 0
        cost = -2 * level[: capacity - s + 1] + 1
        cost[0] = 0
        change = np.where(level[: capacity - s + 1] > 0, gain + cost, np.iinfo(np.int64).max)
        change[0] = gain[0]
        h = len(change) - 1 - int(change[::-1].argmin())
        if h:
            b = stacks[h].pop()
            level[h] -= 1
        else:
            b, n_bins = n_bins, n_bins + 1
        bins[k], offsets[k] = b, h
        if h + s < capacity:
            stacks[h + s].append(b)
            level[h + s] += 1
    return bins, offsets


_SCHEMA = "doc_id bigint, piece_no int, n_tokens bigint, block bigint, container bigint, start_at bigint"


def _pack_block(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece_no", "n_tokens"]).reset_index(drop=True)
    if len(pdf):
        pdf["container"], pdf["start_at"] = sum_of_squares(pdf["n_tokens"].to_numpy(), capacity)
    else:
        pdf["container"], pdf["start_at"] = pd.Series(dtype="int64"), pd.Series(dtype="int64")
    return pdf[["doc_id", "piece_no", "n_tokens", "block", "container", "start_at"]]


def pack(sizes: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Place every item: ``doc_id, piece_no, n_tokens, container_id, start_at``.

    Items longer than the capacity are split into full pieces and a rest; no other item is split.
    Items of no tokens need no room: they keep one row with a null container. Items are spread
    by a hash over blocks of about ``block_items`` and packed block by block with the sum of
    squares rule online, one after the other in the order of their ids. A repeated ``doc_id`` is an item
    of its own. Negative and null sizes count as 0; an empty table gives an empty result.
    """
    n = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0))
    items = sizes.select("doc_id", n.cast("bigint").alias("n"))
    pieces = items.withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("int"))))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(capacity), F.col("n") - (F.col("piece_no") - 1) * capacity).cast("bigint"))
    pieces = pieces.select("doc_id", "piece_no", "n_tokens")
    pieces = materialise(pieces, "pack-pieces")  # tokens are counted once
    whole = pieces.where(F.col("n_tokens") == capacity)
    part = pieces.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity))
    blocks = max(1, -(-part.count() // block_items))
    spread = part.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(blocks)).cast("bigint"))
    packed = spread.groupBy("block").applyInPandas(lambda pdf: _pack_block(pdf, capacity), _SCHEMA)
    name = F.concat_ws("-", F.lit("c"), "block", "container")
    columns = ["doc_id", "piece_no", "n_tokens", "container_id", "start_at"]
    return (
        packed.withColumn("container_id", name).select(columns)
        .unionByName(whole.withColumns({"container_id": F.concat_ws("-", F.lit("w"), "doc_id", "piece_no"), "start_at": F.lit(0).cast("bigint")}).select(columns))
        .unionByName(pieces.where("n_tokens = 0").withColumns({"container_id": F.lit(None).cast("string"), "start_at": F.lit(None).cast("bigint")}).select(columns))
    )


def pack_documents(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Containers of ``capacity`` tokens for the texts of ``documents``."""
    return pack(token_counts(documents, tokenizer), capacity)
