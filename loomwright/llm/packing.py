"""Filling windows of fixed capacity with texts: bounded-space online packing.

Every text is measured once, in tokens of a public tokenizer. Each partition then keeps
``OPEN`` windows open for each capacity and places its texts one after another: a text goes
to the open window that it fills best; when it fits none and all are in use, the fullest
window is emitted and a new one opened. A text longer than the capacity fills windows of
its own and only its rest is placed. The windows that are still open at the end of a
partition are the leftovers: they are merged, whole, in groups of about ``MERGE`` by the
same rule, largest first, so no task ever holds more than a group.

Defined results: null texts and texts without tokens take no space and are not placed; a
document delivered twice is placed once; a capacity that is null or below one gives no
rows; a text as long as the capacity fills one window.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import staged

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OPEN, MERGE = 64, 4_096
PLACEMENT = "pack_id int, window_id string, place int, doc_id long, piece int, first_token long, tokens int"
_loaded: dict = {}


def encoder(path: str, pattern: str = PATTERN):
    """The tokenizer of a rank file; kept for the life of a worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(documents: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, tokens)`` of whole texts, one row for each document with tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode_ordinary
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(encode(t)) for t in texts], pa.int32())], names=["doc_id", "tokens"]
            )

    picked = documents.select(F.col("doc_id").cast("long"), "text").where("text is not null and doc_id is not null")
    counted = picked.mapInArrow(run, "doc_id long, tokens int").where("tokens > 0")
    return counted.groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


class Shelf:
    """At most ``most`` open windows, ordered by the room they have left."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.made = 0

    def put(self, size: int, item) -> list | None:
        """Place an item; gives the contents of the window that had to be emitted."""
        at = bisect.bisect_left(self.rooms, (size, -1))
        emitted = None
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.most:
                _, full = self.rooms.pop(0)
                emitted = self.held.pop(full)
            room, window = self.capacity, self.made
            self.made += 1
            self.held[window] = []
        self.held[window].append(item)
        if room == size:
            done = self.held.pop(window)
            return done if emitted is None else [*emitted, None, *done]
        bisect.insort(self.rooms, (room - size, window))
        return emitted

    def rest(self) -> list[tuple[int, list]]:
        """What the open windows hold, with their sizes."""
        return [(self.capacity - room, self.held[w]) for room, w in self.rooms]


def _windows(contents: list) -> Iterator[list]:
    """The windows of what :meth:`Shelf.put` gave; None parts two of them."""
    window: list = []
    for item in contents:
        if item is None:
            yield window
            window = []
        else:
            window.append(item)
    if window:
        yield window


def place_texts(sizes: DataFrame, capacities: list[tuple[int, int]], open_windows: int = OPEN) -> DataFrame:
    """The placement of ``sizes (doc_id, tokens)`` in windows of ``(pack_id, capacity)``."""
    valid = [(int(p), int(c)) for p, c in capacities if p is not None and c is not None and c >= 1]
    schema = (
        "pack_id int, window_id string, size int, closed boolean, "
        "items array<struct<doc_id: long, piece: int, first_token: long, tokens: int>>"
    )

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        shelves = {p: Shelf(c, open_windows) for p, c in valid}
        number = dict.fromkeys(shelves, 0)
        rows: list[tuple] = []

        def emit(pack: int, window: list, size: int, closed: bool) -> None:
            rows.append((pack, f"{part}-{number[pack]}", size, closed, window))
            number[pack] += 1

        for frame in parts:
            for doc, tokens in zip(frame["doc_id"].tolist(), frame["tokens"].tolist()):
                for pack, capacity in valid:
                    begin, piece = 0, 0
                    while tokens - begin >= capacity:
                        emit(pack, [(doc, piece, begin, capacity)], capacity, True)
                        begin, piece = begin + capacity, piece + 1
                    if begin == tokens:
                        continue
                    item = (doc, piece, begin, tokens - begin)
                    for window in _windows(shelves[pack].put(tokens - begin, item) or []):
                        emit(pack, window, sum(i[3] for i in window), True)
            yield _frame(rows)
            rows = []
        for pack, shelf in shelves.items():
            for size, window in shelf.rest():
                emit(pack, window, size, False)
        yield _frame(rows)

    packed = staged(sizes.select("doc_id", "tokens").mapInPandas(first, schema), "packing")
    left = packed.where("not closed")
    groups = max(1, -(-left.count() // (MERGE * max(1, len(valid)))))
    capacity_of = dict(valid)

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        pack, group = int(key[0]), int(key[1])
        shelf = Shelf(capacity_of[pack], len(frame) + 1)
        done: list[list] = []
        order = frame.sort_values(["size", "window_id"], ascending=[False, True])
        for size, items in zip(order["size"].tolist(), order["items"].tolist()):
            done.extend(_windows(shelf.put(int(size), items) or []))
        done.extend(window for _, window in shelf.rest())
        rows = []
        for n, window in enumerate(done):
            flat = [_item(i) for items in window for i in items]
            rows.append((pack, f"m{group}-{n}", sum(i[3] for i in flat), True, flat))
        return _frame(rows)

    grouped = left.withColumn("group", F.pmod(F.xxhash64("window_id"), F.lit(groups)))
    merged = grouped.groupBy("pack_id", "group").applyInPandas(merge, schema)
    windows = packed.where("closed").unionByName(merged)
    return windows.select("pack_id", "window_id", F.posexplode("items").alias("place", "i")).select(
        "pack_id", "window_id", F.col("place").cast("int"), "i.doc_id", "i.piece", "i.first_token", "i.tokens"
    )


def _item(item) -> tuple:
    return tuple(item.values()) if isinstance(item, dict) else tuple(item)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["pack_id", "window_id", "size", "closed", "items"]
    keys = ("doc_id", "piece", "first_token", "tokens")
    return pd.DataFrame([(*r[:4], [dict(zip(keys, i)) for i in r[4]]) for r in rows], columns=names)


def packed_documents(documents: DataFrame, capacities: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The placement of whole documents for every window size of a table of capacities."""
    sizes = staged(token_counts(documents, path), "token-counts")
    listed = [(r[0], r[1]) for r in capacities.select("pack_id", "capacity_tokens").distinct().collect()]
    return place_texts(sizes, sorted(listed, key=lambda x: (x[0] is None, x[0])))


def packing_report(documents: DataFrame, capacities: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Windows, tokens and the share of them that is filled, for each capacity."""
    placed = packed_documents(documents, capacities, path)
    used = placed.groupBy("pack_id").agg(
        F.count_distinct("window_id").alias("windows"), F.sum("tokens").alias("tokens")
    )
    sizes = capacities.select("pack_id", "capacity_tokens").distinct()
    return used.join(sizes, "pack_id").select(
        "pack_id",
        "windows",
        "tokens",
        (F.col("tokens") / (F.col("windows") * F.col("capacity_tokens"))).alias("filled"),
    )


def placement_faults(placed: DataFrame, sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """``(pack_id, documents, misplaced, overfull)`` of a placement of ``sizes (doc_id, tokens)``.

    A document is misplaced if its pieces don't follow each other from its first token to
    its last, or if it is divided though it fits; a window is overfull above its capacity.
    """
    caps = capacities.where("capacity_tokens > 0").select("pack_id", "capacity_tokens").distinct()
    pieces = placed.groupBy("pack_id", "doc_id").agg(
        F.sum("tokens").alias("held"),
        F.max(F.col("first_token") + F.col("tokens")).alias("last"),
        F.count_distinct("first_token").alias("starts"),
        F.count("*").alias("pieces"),
    )
    wanted = sizes.select("doc_id", F.col("tokens").alias("size")).join(F.broadcast(caps))
    whole = (F.col("held") == F.col("size")) & (F.col("last") == F.col("size")) & (F.col("starts") == F.col("pieces"))
    fits = (F.col("pieces") == 1) | (F.col("size") > F.col("capacity_tokens"))
    documents = (
        wanted.join(pieces, ["pack_id", "doc_id"], "full")
        .groupBy("pack_id")
        .agg(F.count("held").alias("documents"), F.count_if(~F.coalesce(whole & fits, F.lit(False))).alias("misplaced"))
    )
    windows = (
        placed.groupBy("pack_id", "window_id").agg(F.sum("tokens").alias("held")).join(F.broadcast(caps), "pack_id")
        .groupBy("pack_id").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("overfull"))
    )
    return documents.join(windows, "pack_id")


def check_placement(documents: DataFrame, capacities: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The faults of the placement of whole documents."""
    return placement_faults(packed_documents(documents, capacities, path), token_counts(documents, path), capacities)
