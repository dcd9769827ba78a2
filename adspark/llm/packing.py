"""Documents packed into containers of limited size (problem 8).

Sizes are tokens of a public tokenizer. Documents are never split unless one exceeds the largest container; such a document is
cut into pieces of exactly that size and a rest. Containers come in several permitted sizes.

Packing is variable-capacity best fit. Items are taken by falling size; each goes to the open container whose room it fills
best. If none has room, a container is opened: of the permitted sizes that hold the item, the one of least expected cost per
token. A container costs its size, and is expected to be filled with the item and with as many of the tokens still to come as
the rooms already open do not take; so all sizes are optimised together: full-size containers while there is enough to fill
them, smaller ones for the last items. At the end each container is replaced by the smallest permitted size that holds its
contents. No container exceeds the largest permitted size, 2,048 tokens unless told otherwise.

Containers are filled within blocks. A block is a hash bucket of documents, its number chosen so that a block has about
`block_rows` items, whatever the size of the collection; so no task sees more than its block, and only (document, size)
pairs are shuffled, never texts. The waste that block borders add is less than one container per block.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.runtime import cut, spread

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
SIZES = (256, 512, 1024, 2048)


def counter(path: str, memory: int = 500_000) -> Callable[[str], int]:
    """A function that counts the tokens of a text; the pieces between which no merge reaches are counted once and remembered."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    piece = regex.compile(PATTERN)
    known: dict[str, int] = {}

    def count(text: str) -> int:
        n = 0
        for w in piece.findall(text):
            k = known.get(w)
            if k is None:
                if len(known) >= memory:
                    known.clear()
                k = known[w] = len(encode(w))
            n += k
        return n

    return count


def count_tokens(docs: DataFrame, key: str, text: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): tokens of each whole text; NULL counts as empty. One Arrow pass; strings of special tokens are text.

    `folder` must be readable where the tasks run; a vocabulary shipped with addFile is read from there if the folder lacks it.
    """
    path = str(Path(folder) / vocabulary)
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path if Path(path).exists() else SparkFiles.get(vocabulary))
        for b in batches:
            n = [count(x) if x else 0 for x in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(n, pa.int64())], names=["k", "n_tokens"])

    return spread(src).mapInArrow(run, f"k {kind}, n_tokens bigint").withColumnRenamed("k", key)


def pieces(sized: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, first_token, n_tokens): documents whole, those beyond the capacity in full pieces and a rest."""
    n = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1))
    p = sized.select(key, "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("piece"))
    first = F.col("piece") * capacity
    return p.select(key, F.col("piece").cast("int").alias("piece"), first.alias("first_token"), F.least(F.col("n_tokens") - first, F.lit(capacity)).alias("n_tokens"))


def best_fit(sizes: np.ndarray, permitted: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container number and offset of each item, and each container's final size. Items of size 0 take no room.

    Of equal rooms the container opened first is filled; of equal items the first comes first.
    """
    order = np.argsort(-sizes, kind="stable")
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    cap: list[int] = []
    rooms: list[tuple[int, int]] = []  # (room, container), sorted
    left, open_room = int(sizes.sum()), 0  # tokens not yet placed; room in open containers
    for i in order:
        s = int(sizes[i])
        at = bisect.bisect_left(rooms, (s, -1))
        if at == len(rooms):
            fits = [c for c in permitted if c >= s]
            spare = max(0, left - s - open_room)
            c = -min((c / max(s + min(c - s, spare), 1), -c) for c in fits)[1]
            b = len(used)
            used.append(0)
            cap.append(c)
            open_room += c
        else:
            room, b = rooms.pop(at)
        bin_of[i], offset[i] = b, used[b]
        used[b] += s
        open_room -= s
        left -= s
        if cap[b] > used[b]:
            bisect.insort(rooms, (cap[b] - used[b], b))
    final = np.array([next(c for c in permitted if c >= u) for u in used], np.int64)
    return bin_of, offset, final


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = SIZES, block_rows: int = 20_000, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, piece, n_tokens, first_token, container, container_size, position, offset): one row per document or piece.

    `container` is unique in the result, `position` counts from 1 in a container. Documents delivered twice count once (the
    larger token count holds). NULL and empty texts are items of 0 tokens and get a place; a NULL key is a document like any
    other. Ties in size keep the order of keys, so the result is the same for the same rows. Very long texts are tokenized
    whole and cut only between containers. Extra columns are ignored; an empty table gives no rows.
    """
    capacity = max(sizes)
    permitted = tuple(sorted(sizes))
    sized = count_tokens(docs, key, text, folder, vocabulary).groupBy(key).agg(F.max("n_tokens").alias("n_tokens"))
    items = cut(pieces(sized, key, capacity))
    blocks = max(1, -(-items.count() // block_rows))
    kind = items.schema[key].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "piece"], kind="stable", na_position="first").reset_index(drop=True)
        bin_of, offset, final = best_fit(pdf["n_tokens"].to_numpy(np.int64), permitted)
        out = pdf[[key, "piece", "n_tokens", "first_token"]].copy()
        out["container"] = pdf["block"].to_numpy(np.int64) * (1 << 40) + bin_of
        out["container_size"] = final[bin_of] if len(final) else 0
        out["offset"] = offset
        # An empty item begins where another does; it comes first there.
        out = out.sort_values(["container", "offset", "n_tokens", key, "piece"], kind="stable")
        out["position"] = out.groupby("container").cumcount() + 1
        return out[[key, "piece", "n_tokens", "first_token", "container", "container_size", "position", "offset"]]

    block = F.pmod(F.xxhash64(key, "piece"), F.lit(blocks)).alias("block")
    schema = f"{key} {kind}, piece int, n_tokens bigint, first_token bigint, container bigint, container_size bigint, position int, offset bigint"
    return items.select("*", block).groupBy("block").applyInPandas(fill, schema)
