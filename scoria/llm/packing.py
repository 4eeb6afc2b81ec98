"""Filling fixed-capacity containers with items (problem 6).

Bounded-space online best fit: each task keeps a fixed number of open windows, puts an
item into the fullest window that still holds it, and emits the fullest window when
none does. What is open at the end of a task is merged in a last step over windows, not items:
their number depends on the tasks, not on the rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small, store

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
OPEN = 64
#: Windows left open that one task of the last step merges.
MERGE_ROWS = 200_000
# Fixed value: how the tokenizer parts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """A tokenizer from a file of ranks: a token in base 64 and its number on each line."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Windows:
    """Open windows of one task, sorted by the space they have left."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.seq = capacity, most, 0
        self.free: list[tuple[int, int]] = []  # (space left, window)

    def place(self, size: int) -> tuple[int, int, int | None]:
        """(window, offset, window emitted or None) for an item."""
        i, out = bisect_left(self.free, (size, -1)), None
        if i < len(self.free):
            left, window = self.free.pop(i)
        else:
            if len(self.free) >= self.most:
                out = self.free.pop(0)[1]
            left, window, self.seq = self.capacity, self.seq, self.seq + 1
        insort(self.free, (left - size, window))
        return window, self.capacity - left, out


def _pack(capacity: int, most: int, path: str | None):
    """mapInPandas: items with window and offset; without a path, items come with their size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        windows = Windows(capacity, most)
        for pdf in batches:
            if path:
                texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
                sizes = [len(x) for x in encoding(path).encode_ordinary_batch(texts, num_threads=1)]
            else:
                sizes = pdf["size"].tolist()
            rows = []
            for key, size in zip(pdf["key"], sizes):
                part, start = 0, 0
                while size - start > capacity:  # too long for any: cut into full containers and a rest
                    rows.append((key, part, start, capacity, base + windows.seq, 0))
                    windows.seq, part, start = windows.seq + 1, part + 1, start + capacity
                window, offset, _ = windows.place(size - start)
                rows.append((key, part, start, size - start, base + window, offset))
            yield pd.DataFrame(rows, columns=["key", "part", "start", "size", "window", "offset"])

    return run


def pack(items: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, open_windows: int = OPEN, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, part, start, tokens, container, place) of every item.

    `start` is where the part begins in its text, `place` where it lies in its container,
    both in tokens. A text is divided only if it is longer than the capacity, into full
    containers and a rest that is packed like any other item. Null and empty texts have no tokens
    and still get a place; repeated rows and null keys are packed row by row; an empty
    table gives an empty result. Texts are measured whole.
    """
    kind = items.schema[key].dataType.simpleString()
    schema = f"key {kind}, part int, start long, size int, window long, offset int"
    first = items.select(F.col(key).alias("key"), F.col(text).alias("text"))
    placed = store(first.mapInPandas(_pack(capacity, open_windows, tokenizer), schema))

    # Windows that are not full and were open at the end may still be merged. Which ones were
    # emitted earlier does not matter here: any window with space left takes part once.
    fill = placed.groupBy("window").agg(F.sum("size").alias("size")).filter(F.col("size") <= capacity * 3 // 4)
    n = fill.count()
    left = fill.select(F.col("window").alias("key"), F.col("size").cast("int")).repartition(max(1, -(-n // MERGE_ROWS)), "key")
    left = left.sortWithinPartitions(F.col("size").desc(), "key")
    merged = left.mapInPandas(_pack(capacity, max(open_windows, MERGE_ROWS), None), "key long, part int, start long, size int, window long, offset int")
    # A merged container takes the number of the window that lies at its start.
    merged = store(merged.select("key", "window", "offset"))
    first_of = merged.filter("offset = 0").groupBy("window").agg(F.min("key").alias("container"))
    moves = merged.join(first_of, "window").select(F.col("key").alias("window"), F.col("container"), F.col("offset").alias("shift"))
    out = placed.join(small(moves), "window", "left")
    return out.select(
        F.col("key").alias(key), "part", "start", F.col("size").alias("tokens"),
        F.coalesce("container", "window").alias("container"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("place"),
    )


def packing_checks(packed: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row of what must hold of a packing, counted where it does not, and how full it is.

    items: distinct keys; overfull: containers above the capacity; gaps: places where a container's parts do not follow one
    another; torn: parts that do not follow one another in their text, or texts in parts that would fit whole; loose: 1 if
    there are over two hundredths and one more containers than the tokens need.
    """
    place, text = Window.partitionBy("container").orderBy("place", "tokens", key, "part"), Window.partitionBy(key).orderBy("part")
    end = F.lag(F.col("place") + F.col("tokens")).over(place)
    before = F.lag(F.col("start") + F.col("tokens")).over(text)
    rows = packed.withColumn("gap", (F.coalesce(end, F.lit(0)) != F.col("place")).cast("int"))
    boxes = rows.groupBy("container").agg(F.sum("tokens").alias("size"), F.sum("gap").alias("gaps"))
    boxes = boxes.agg(
        F.count_if(F.col("size") > capacity).alias("overfull"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"),
        (F.count_if(F.col("size") > 0) > F.ceil(F.ceil(F.sum("size") / capacity) * 1.02) + 1).cast("int").alias("loose"),
    )
    parts = packed.withColumn("torn", (F.coalesce(before, F.lit(0)) != F.col("start")).cast("int"))
    each = parts.groupBy(key).agg(F.sum("tokens").alias("size"), F.count("*").alias("parts"), F.sum("torn").alias("torn"))
    wrong = (F.col("torn") > 0) | (F.col("parts") != F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)))
    texts = each.agg(F.count("*").alias("items"), F.count_if(wrong).alias("torn"))
    return texts.join(boxes.hint("broadcast"), F.lit(True))  # one row each
