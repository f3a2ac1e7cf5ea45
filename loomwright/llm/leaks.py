"""Evaluation passages inside a training corpus, whole or in part.

Items are cut into all windows of ``WINDOW`` words. A window's fingerprint is the 64-bit
SimHash of its words. Documents are slid over word by word, and a multi-index of three
blocks of the fingerprint finds every item window within ``RADIUS`` bits: two
fingerprints at most two bits apart agree in at least one of three blocks.

The window is short so that the search can lose nothing: a passage of ``PASSAGE`` words
or more with at most one in ``ERRORS`` replaced, misspelt, added or missing has at least
three windows without an error, and those are at distance 0: ``e`` errors leave ``n - e``
words in ``e + 1`` runs, and a run of ``r`` words has ``r - 5`` windows, so at least
``n - e - 5 * (e + 1)``. That is 5 for 28 words with 3 errors and 3 for 32 with 4, the least:
eight further words allow one more error and give two more windows. Candidates are pairs of a
document and an item with ``LEAST`` near windows about one diagonal. They are verified
exactly: the document is aligned with the item word by word, every word a shingle of
weight one, and the pair is kept if some run of at least ``PASSAGE`` item words keeps the
error bound. Weights by rarity would let a passage of stock words fail, so there are none.

Case, accents, punctuation, blanks, line breaks, quoting marks, markup and invisible
characters don't count. The items are a query set: they go to the tasks in blocks of at
most ``BLOCK_WORDS`` words, one pass over the documents for each block, so what is sent has
a fixed bound whatever their number.

Defined results: null and empty texts and items shorter than ``PASSAGE`` words match
nothing; repeated items or documents give their pairs once.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.textkit import WORD, WordHashes, kept

WINDOW, RADIUS, PASSAGE, ERRORS = 6, 2, 28, 8
LEAST, BAND = 3, 6
BLOCK_WORDS = 2_000_000
_BITS = (21, 21, 22)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_INVISIBLE = {ord(c): None for c in "­​‌‍⁠﻿"}
_ENTITY = re.compile(r"&(?:#?\w{2,10});")


def plain_words(text: str) -> list[str]:
    """Words without case, accents, markup and invisible characters."""
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_INVISIBLE).casefold())
        text = "".join([c for c in text if not unicodedata.combining(c)]) if not text.isascii() else text
        return WORD.findall(text)
    return WORD.findall(text.lower())


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SimHash of every window of ``WINDOW`` words in a run of word hashes."""
    count = len(hashes) - WINDOW + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    total = bits[0:count].copy()
    for k in range(1, WINDOW):
        total += bits[k : k + count]
    return np.packbits(total > WINDOW // 2, axis=1).reshape(-1, 8).copy().view(np.uint64).ravel()


class WindowIndex:
    """Multi-index Hamming blocks over the windows of a block of items."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        hashes = WordHashes()
        self.items = [(i, hashes.of(w)) for i, w in items]
        prints, owner, place = [], [], []
        for n, (_, h) in enumerate(self.items):
            made = fingerprints(h)
            prints.append(made)
            owner.append(np.full(len(made), n))
            place.append(np.arange(len(made)))
        self.prints = np.concatenate(prints)
        self.owner = np.concatenate(owner)
        self.place = np.concatenate(place)
        self.blocks = []
        shift = 0
        for width in _BITS:
            value = ((self.prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            start = np.searchsorted(value[order], np.arange((1 << width) + 1)).astype(np.int32)
            self.blocks.append((shift, width, order, start))
            shift += width

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``prints``, window) at most ``RADIUS`` bits apart."""
        found_at, found = [], []
        for b, (shift, width, order, start) in enumerate(self.blocks):
            value = ((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
            first, size = start[value], start[value + 1] - start[value]
            at = np.nonzero(size)[0]
            if len(at) == 0:
                continue
            size = size[at].astype(np.int64)
            rows = np.repeat(at, size)
            inside = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
            window = order[np.repeat(first[at].astype(np.int64), size) + inside]
            apart = prints[rows] ^ self.prints[window]
            keep = np.bitwise_count(apart) <= RADIUS
            for earlier_shift, earlier_width, _, _ in self.blocks[:b]:  # found there already
                mask = np.uint64(((1 << earlier_width) - 1) << earlier_shift)
                keep &= (apart & mask) != 0
            found_at.append(rows[keep])
            found.append(window[keep])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)


def _holds(doc: list[int], item: list[int], diagonal: int) -> bool:
    """Whether some run of item words stands in the document within the error bound.

    A banded alignment around ``diagonal`` (document place less item place) with the
    fewest errors; then runs along its path.
    """
    wide = 2 * BAND + 1
    far = 1 << 20
    size = len(doc)
    errors = [1] * len(item)  # an item word that no document word meets is an error
    added = [0] * (len(item) + 1)
    steps: list[list[int]] = []

    def walk(last: int, row: list[int]) -> None:
        """Mark the words along the best path that ends after item word ``last``."""
        k, i = min(range(wide), key=lambda x: row[x]), last
        while i > last - len(steps):
            how = steps[i - last - 1][k]
            if how == 1:
                errors[i] = int(doc[i + diagonal - BAND + k] != item[i])
                i -= 1
            elif how == 2:
                i, k = i - 1, k + 1
            else:
                added[i] += 1
                k -= 1

    row = [0 if 0 <= diagonal - BAND + k <= size else far for k in range(wide)]
    for i, word in enumerate(item):
        low = i + diagonal - BAND  # document place before column k is low + k
        new, step = [far] * wide, [0] * wide
        for k in range(wide):
            j = low + k  # the word at j, when column k of the new row ends at j + 1
            best, how = far, 0
            if 0 <= j < size and row[k] < far:
                best, how = row[k] + (doc[j] != word), 1
            if k + 1 < wide and row[k + 1] + 1 < best and 0 <= j + 1 <= size:
                best, how = row[k + 1] + 1, 2
            if k and new[k - 1] + 1 < best and 0 <= j < size:
                best, how = new[k - 1] + 1, 3
            new[k], step[k] = best, how
        if min(new) >= far:  # the band is outside the document
            if steps:
                walk(i - 1, row)
                steps = []
            new = [0 if 0 <= low + 1 + k <= size else far for k in range(wide)]
        else:
            steps.append(step)
        row = new
    if steps:
        walk(len(item) - 1, row)
    score, lowest, history = 0, 0, [0]
    for i, error in enumerate(errors):
        score += 1 - ERRORS * error - (ERRORS * added[i] if i else 0)
        history.append(score)
        if i + 1 >= PASSAGE:
            lowest = min(lowest, history[i + 1 - PASSAGE]) if i + 1 > PASSAGE else history[0]
            if score >= lowest:
                return True
    return False


def _may_hold(doc: np.ndarray, item: np.ndarray, diagonal: int) -> bool:
    """A bound of :func:`_holds`: whether some run is long enough if every item word that
    the band meets at all counts as met in its place, and no word as added."""
    count = len(item)
    if count < PASSAGE or len(doc) == 0:
        return False
    at = np.arange(diagonal - BAND, diagonal + BAND + count)
    around = doc[np.clip(at, 0, len(doc) - 1)]
    inside = (at >= 0) & (at < len(doc))
    met = np.zeros(count, dtype=bool)
    for k in range(2 * BAND + 1):
        met |= (around[k : k + count] == item) & inside[k : k + count]
    score = np.concatenate([[0], np.cumsum(np.where(met, 1, 1 - ERRORS))])
    lowest = np.minimum.accumulate(score[: count + 1 - PASSAGE])
    return bool((score[PASSAGE:] >= lowest).any())


def leaked(doc: np.ndarray, at: np.ndarray, window: np.ndarray, index: WindowIndex) -> list[int]:
    """Items of the index that a document holds, from its near windows."""
    out = []
    owner = index.owner[window]
    order = np.argsort(owner, kind="stable")
    owner, at, window = owner[order], at[order], window[order]
    names, start, size = np.unique(owner, return_index=True, return_counts=True)
    words = None
    for n, s, c in zip(names, start, size):
        if c < LEAST:
            continue
        diagonal = np.sort(at[s : s + c] - index.place[window[s : s + c]])
        close = np.searchsorted(diagonal, diagonal + BAND, side="right") - np.arange(c)
        item_id, item = index.items[n]
        done_to = None
        for i in np.argsort(-close, kind="stable"):
            if close[i] < LEAST:
                break
            centre = int(diagonal[i : i + close[i]][close[i] // 2])
            if done_to is not None and any(abs(centre - d) <= 1 for d in done_to):
                continue
            done_to = [*(done_to or []), centre]
            if not _may_hold(doc, item, centre):
                continue
            if words is None:
                words = doc.tolist()
            if _holds(words, item.tolist(), centre):
                out.append(item_id)
                break
    return out


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """The distinct items in blocks of at most ``BLOCK_WORDS`` words."""
    block: list[tuple[int, list[str]]] = []
    size = 0
    rows = items.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    for row in rows.toLocalIterator():
        tokens = plain_words(row["text"])
        if len(tokens) < PASSAGE:
            continue
        if block and size + len(tokens) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], tokens))
        size += len(tokens)
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` of the documents that hold a passage of an item."""
    spark = documents.sparkSession
    schema = "doc_id long, item_id long"
    out = None
    for block in _item_blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = kept(shared, WindowIndex)
            hashes = WordHashes()
            for batch in batches:
                ids, texts = (c.to_pylist() for c in batch.columns)
                pairs: list[tuple[int, int]] = []
                for low, high in _groups([len(t) for t in texts]):
                    docs = [hashes.of(plain_words(t)) for t in texts[low:high]]
                    flat = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
                    if len(flat) < WINDOW:
                        continue
                    at, window = index.near(fingerprints(flat))
                    ends = np.cumsum([len(d) for d in docs])
                    doc = np.searchsorted(ends, at, side="right")
                    keep = at + WINDOW <= ends[doc]
                    at, window, doc = at[keep], window[keep], doc[keep]
                    order = np.argsort(doc, kind="stable")
                    at, window, doc = at[order], window[order], doc[order]
                    names, start, size = np.unique(doc, return_index=True, return_counts=True)
                    for d, s, c in zip(names, start, size):
                        if c >= LEAST:
                            begin = ends[d] - len(docs[d])
                            held = leaked(docs[d], at[s : s + c] - begin, window[s : s + c], index)
                            pairs.extend((ids[low + d], item) for item in held)
                if pairs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), pa.int64()) for c in zip(*pairs)], names=["doc_id", "item_id"]
                    )

        found = (
            documents.where("text is not null and doc_id is not null")
            .select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(run, schema)
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        return documents.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("item_id")).where("false")
    return out.distinct()


def _groups(sizes: list[int], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters together."""
    low = total = 0
    for i, size in enumerate(sizes):
        if i > low and total + size > most:
            yield low, i
            low, total = i, 0
        total += size
    if sizes:
        yield low, len(sizes)


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """For each item the documents that hold it, and their sources."""
    found = leaked_items(documents, items)
    named = found.join(documents.select("doc_id", "source"), "doc_id")
    return named.groupBy("item_id").agg(
        F.count("*").alias("documents"), F.count_distinct("source").alias("sources")
    )
