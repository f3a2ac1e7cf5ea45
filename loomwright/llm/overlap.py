"""Same or near-same records across splits: an exact prefix-filter bipartite join.

Texts of the evaluation side and of the training side are sets of rare shingles: runs of
``WORDS`` words after the words that stand in more than ``COMMON`` of all texts are left
out. Poor texts, which keep less than ``POOR`` of their words then, also are sets of
shingles of all their words. A total order puts rare shingles first, so two texts whose shingle sets reach the
similarity ``SHINGLE`` share a shingle among the first ``m - ceil(SHINGLE * m) + 1`` of
both. Evaluation prefixes are the index, training prefixes probe it. Length, position
and parity-bitmap filters, all of them upper bounds that lose nothing, leave few
candidates; these are verified by the multiset similarity of their words.

The join is exact for pairs that reach ``SHINGLE`` on rare shingles, or on shingles of all
words if both are poor, and the asked similarity on words. A text that keeps less than
``BARE`` has next to no rare shingles, and an edited form of it may keep up to ``RICH``:
texts between ``POOR`` and ``RICH`` send those of their shingles of all words that a bare
text of the other side holds. Five-word shingles of all words bound the word similarity more
tightly, but here nine in ten of them are stock phrases that both sides share: they sent
four times the rows. Texts of at most ``SHORT`` words are also indexed by their single
words and joined exactly at 0.7; both texts of a pair fall under that bound whenever one
has ``TINY`` words or fewer, and those have no shingles.

Rarity and presence come from hashed tables of fixed size, built over all texts: for each
side ``BUCKETS`` counts and a bitmap of ``PRESENT`` places. Any order that both
sides share keeps the filter exact, so hash collisions cost time only. A shingle that the
other side's bitmap doesn't hold is not sent. A pair must also meet in as many prefix
shingles as its sizes require (what both share, less what can lie beyond a prefix). A key
whose bucket has more than ``CELL`` rows on a side, and more than four times the mean
bucket, is cut into a grid of cells: each row takes its own line of the grid and is
repeated across, so every pair still meets in exactly one cell, and a cell gets about the
greater of the two numbers of rows of a side, however hot the key is.

Copies of a text are one class: rows of a class collapse after the exchange, before the
join. Defined results: null splits or roles, null texts and texts without letters or
digits overlap with nothing; repeated rows count once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.neardup import COMMON, common_words
from loomwright.llm.similar import class_texts, record_pairs, verified
from loomwright.llm.textkit import WordHashes, mix, words
from loomwright.session import staged

SHINGLE, WORDS, TINY, SHORT = 0.05, 4, 40, 57
BARE, POOR, RICH = 0.15, 0.3, 0.52
SINGLE = 0.7
FAN = 16
BUCKETS, PRESENT, BLOCK = 1 << 20, 1 << 26, 1 << 20
KEY_BITS, COUNT_BITS = 40, 13
CELL = 4096
LANES = 6
PARITY = 64 * LANES - 16
_LANES = [f"b{k}" for k in range(LANES)]
CHUNK = (1 << 64 - KEY_BITS - COUNT_BITS) // 3
"""Texts whose three sets can be numbered in the bits beside a key and its count."""

_ROLE_OF = {
    "train": "t",
    "training": "t",
    "validation": "e",
    "valid": "e",
    "dev": "e",
    "test": "e",
}
_PILOT_ROLE_OF = {
    "train": "t",
    "training": "t",
    "development": "e",
    "dev": "e",
    "final_eval": "e",
    "final-eval": "e",
}


def side_of(column: Column, names: dict[str, str] = _ROLE_OF) -> Column:
    """``t``, ``e`` or null from a split or role; case and outer blanks don't count."""
    cleaned = F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))
    out = F.lit(None).cast("string")
    for side in ("t", "e"):
        out = F.when(cleaned.isin([k for k, v in names.items() if v == side]), F.lit(side)).otherwise(out)
    return out


_SPLIT_OF = {"training": "train", "valid": "validation", "dev": "validation"}
_PILOT_SPLIT_OF = {"train": "training", "dev": "development", "final-eval": "final_eval"}


def split_of(column: Column, names: dict[str, str] = _SPLIT_OF) -> Column:
    """A split or role by its one name; case and outer blanks don't count."""
    out = cleaned = F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))
    for spelling, name in names.items():
        out = F.when(cleaned == spelling, F.lit(name)).otherwise(out)
    return out


def sided_texts(design: DataFrame, pilot: DataFrame, probes: DataFrame) -> DataFrame:
    """``(rid, field, side, table, split, source, text)`` of the three tables; rows of neither
    side are left out. The source is ``provenance.source`` of probes, ``provenance`` of pilot
    passages and the book of designs, ``archive-<book>`` as in the keys of ``splits.py``."""
    told = F.expr(
        "concat_ws(' ', transform(filter(messages, m -> m.role in ('user', 'assistant')), m -> m.content))"
    )
    parts = [
        *[
            design.select(
                F.col("id").alias("rid"),
                F.lit(name).alias("field"),
                side_of(F.col("split")).alias("side"),
                F.lit("starter_design").alias("table"),
                split_of(F.col("split")).alias("split"),
                F.concat(F.lit("archive-"), F.col("book").cast("string")).alias("source"),
                F.col(name).alias("text"),
            )
            for name in ("prose", "source")
        ],
        pilot.select(
            F.col("id").alias("rid"),
            F.lit("text").alias("field"),
            side_of(F.col("role"), _PILOT_ROLE_OF).alias("side"),
            F.lit("pilot_matched_v1").alias("table"),
            split_of(F.col("role"), _PILOT_SPLIT_OF).alias("split"),
            F.col("provenance").alias("source"),
            F.col("text"),
        ),
        probes.select(
            F.col("id").alias("rid"),
            F.lit("messages").alias("field"),
            side_of(F.col("split")).alias("side"),
            F.lit("sft_mask_probes").alias("table"),
            split_of(F.col("split")).alias("split"),
            F.col("provenance.source").alias("source"),
            told.alias("text"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("text is not null and side is not null and rid is not null")


_U = np.uint64
_MOST = (1 << 32) - 1


class _Bags:
    """Hashed words and shingle sets of at most ``CHUNK`` texts, made in one go."""

    def __init__(self, texts: list[str], hashes: WordHashes) -> None:
        lists = [words(t) for t in texts]
        self.n = np.array([len(x) for x in lists], dtype=np.int64)
        number = hashes.numbers([t for x in lists for t in x])
        self.flat, self.rare = hashes.values[number], hashes.free[number]
        self.owner = np.repeat(np.arange(len(lists)), self.n)

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """Owner and value of every word, the k-th occurrence of a word with its own value."""
        flat, owner = self.flat, self.owner.astype(np.uint64)
        line = np.sort((owner << _U(54)) | (flat >> _U(10)))
        if len(line) == 0:
            return line.astype(np.int64), line
        new = np.ones(len(line), dtype=bool)
        new[1:] = line[1:] != line[:-1]
        place = np.arange(len(line))
        first = np.maximum.accumulate(np.where(new, place, 0))
        value = (line << _U(10)) + (place - first).astype(np.uint64) * _U(0x9E3779B97F4A7C15)
        return (line >> _U(54)).astype(np.int64), mix(mix(value))

    def identify(self, owner: np.ndarray, value: np.ndarray) -> None:
        """Class ids and parity bitmaps; the first 16 bits hold the number of words."""
        count = len(self.n)
        self.cid = np.zeros(count, dtype=np.uint64)
        np.add.at(self.cid, owner, mix(value + _U(7)))
        bit = (value % _U(PARITY)).astype(np.int64)
        odd = np.bincount(owner * PARITY + bit, minlength=count * PARITY).reshape(-1, PARITY) & 1
        room = np.zeros((count, 8 * LANES), dtype=np.uint8)
        room[:, 2:] = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little")
        self.bits = room.view("<i8").copy()
        self.bits[:, 0] |= np.minimum(self.n, 65535)

    def _runs(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owner and value of every run of ``WORDS`` of the kept words of a text."""
        flat, of = self.flat[keep], self.owner[keep]
        at = np.arange(max(0, len(flat) - WORDS + 1))
        at = at[of[at] == of[at + WORDS - 1]]
        rolled = np.zeros(len(at), dtype=np.uint64)
        for k in range(WORDS):
            rolled = mix(rolled * _U(0x100000001B3) + flat[at + k])
        return of[at], rolled

    def richness(self) -> np.ndarray:
        """The share of rare words of each text; texts that have no shingles count as rich."""
        kept = np.bincount(self.owner[self.rare], minlength=len(self.n))
        return np.where(self.n > TINY, kept / np.maximum(self.n, 1), 1.0)

    def sets(
        self, owner: np.ndarray | None = None, value: np.ndarray | None = None, rich: float = POOR
    ) -> tuple[np.ndarray, np.ndarray]:
        """Set and key of every member: set 3i has the rare shingles of text i, 3i + 1 its
        words, 3i + 2 all its shingles if it is poorer than ``rich``."""
        long = (self.n > TINY)[self.owner]
        of, rolled = self._runs(self.rare & long)
        share = self.richness()
        poor_of, poor_rolled = of[:0], rolled[:0]
        if (share < rich).any():
            poor_of, poor_rolled = self._runs((share < rich)[self.owner])
        if value is None:
            owner, value = self.numbered() if (self.n <= SHORT).any() else (of[:0], rolled[:0])
        short = (self.n <= SHORT)[owner]
        member = np.concatenate([3 * of, 3 * owner[short] + 1, 3 * poor_of + 2])
        key = np.concatenate([rolled, mix(value[short] + _U(11)), mix(poor_rolled + _U(13))])
        return member, key >> _U(64 - KEY_BITS)


def _bare(key: np.ndarray) -> np.ndarray:
    """The keys under which the shingles of bare texts are marked a second time."""
    return mix(key + _U(17)) >> _U(64 - KEY_BITS)


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key >> _U(KEY_BITS - 20)).astype(np.int64)


def _place(key: np.ndarray) -> np.ndarray:
    return (key >> _U(KEY_BITS - 26)).astype(np.int64)


def _pack(places: np.ndarray) -> bytes:
    """Sorted places as their packed gaps."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNK):
            yield batch.slice(start, CHUNK)


class Tables:
    """Shingle counts and presence bitmaps of the two sides."""

    def __init__(self) -> None:
        self.counts = {s: np.zeros(BUCKETS, dtype="<u4") for s in ("e", "t")}
        self.bare = {s: False for s in ("e", "t")}
        self.present = {s: np.zeros(PRESENT // 8, dtype=np.uint8) for s in ("e", "t")}

    def merge(self, side: str, kind: str, block: int, places: np.ndarray, counts: bytes) -> None:
        at = block * BLOCK + places
        if kind == "counts":
            known = self.counts[side][at] + np.frombuffer(zlib.decompress(counts), "<u4").astype(np.int64)
            self.counts[side][at] = np.minimum(known, _MOST)
        elif kind == "present":
            np.bitwise_or.at(self.present[side], at >> 3, (1 << (at & 7)).astype(np.uint8))
        else:
            self.bare[side] = True

    def holds(self, side: str, key: np.ndarray) -> np.ndarray:
        place = _place(key)
        return (self.present[side][place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def shingle_tables(texts: DataFrame, common: list[str], rich: float = POOR) -> Tables:
    """The tables over all texts; if some are bare, over the shingles up to ``RICH``. What reaches the driver has a fixed size: for each side
    ``BUCKETS`` counts of four bytes and ``PRESENT`` bits. The tables of the tasks are
    merged in a tree, ``FAN`` at a time."""
    left_out = frozenset(common)
    schema = "side string, kind string, block int, part int, places binary, counts binary"

    def rows(side: str, kind: str, part: int, cut: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([side] * len(cut)),
                pa.array([kind] * len(cut)),
                pa.array([b for b, _, _ in cut], pa.int32()),
                pa.array([part] * len(cut), pa.int32()),
                pa.array([_pack(places) for _, places, _ in cut], pa.binary()),
                pa.array([zlib.compress(counts.astype("<u4").tobytes(), 1) for _, _, counts in cut], pa.binary()),
            ],
            names=["side", "kind", "block", "part", "places", "counts"],
        )

    def blocks(side: str, kind: str, part: int, places: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        ends = np.searchsorted(places, np.arange(0, places[-1] + BLOCK + 1, BLOCK))
        used = [b for b in range(len(ends) - 1) if ends[b] < ends[b + 1]]
        return rows(side, kind, part, [(b, places[ends[b] : ends[b + 1]] % BLOCK, counts[ends[b] : ends[b + 1]]) for b in used])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        hashes = WordHashes(left_out)
        held: dict[str, list] = {"e": [], "t": []}
        counts = {s: np.zeros(BUCKETS, dtype=np.int64) for s in held}
        bare = {s: False for s in held}
        for batch in _chunks(batches):
            bags = _Bags(batch.column("text").to_pylist(), hashes)
            member, key = bags.sets(rich=rich)
            is_e = np.array(batch.column("side").to_pylist()) == "e"
            none_left = (bags.richness() < BARE)[member // 3] & (member % 3 == 2)
            is_e = is_e[member // 3]
            for side, mine in (("e", is_e), ("t", ~is_e)):
                if mine.any():
                    counts[side] += np.bincount(_bucket(key[mine]), minlength=BUCKETS)
                    twice = _bare(key[mine & none_left])
                    bare[side] |= len(twice) > 0
                    held[side].append(np.unique(_place(np.concatenate([key[mine], twice]))).astype(np.int32))
                if len(held[side]) > 40:
                    held[side] = [np.unique(np.concatenate(held[side]))]
        for side in held:
            if held[side]:
                places = np.unique(np.concatenate(held[side]))
                yield blocks(side, "present", part, places, np.zeros(0))
                full = np.nonzero(counts[side])[0]
                yield blocks(side, "counts", part, full, np.minimum(counts[side][full], _MOST))
            if bare[side]:
                yield rows(side, "bare", part, [(0, np.zeros(1, dtype=np.int64), np.zeros(1))])

    def merge(group: pa.Table) -> pa.Table:
        side, kind, block, part = (group.column(c)[0].as_py() for c in ("side", "kind", "block", "part"))
        table = np.zeros(BLOCK, dtype=np.int64)
        for places, counts in zip(group.column("places"), group.column("counts")):
            at = _unpack(places.as_py())
            table[at] += np.frombuffer(zlib.decompress(counts.as_py()), "<u4") if kind == "counts" else 1
        at = np.nonzero(table)[0]
        merged = np.minimum(table[at], _MOST) if kind == "counts" else np.zeros(0)
        return pa.Table.from_batches([rows(side, kind, part, [(block, at, merged)])])

    merged = texts.select("side", "text").mapInArrow(count, schema)
    tasks = texts.rdd.getNumPartitions()
    while True:
        tasks = -(-tasks // FAN)
        fanned = merged.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        merged = fanned.groupBy("side", "kind", "block", "part").applyInArrow(merge, schema)
        if tasks <= 1:
            break
    out = Tables()
    for row in merged.collect():
        out.merge(row["side"], row["kind"], row["block"], _unpack(row["places"]), bytes(row["counts"]))
    if rich == POOR and (out.bare["e"] or out.bare["t"]):
        return shingle_tables(texts, common, RICH)
    return out


ROW_SCHEMA = "rid string, field string, side string, cid long, " + ", ".join(f"{b} long" for b in _LANES) + ", keys array<long>"


def prefix_rows(texts: DataFrame, common: list[str], tables: Tables) -> DataFrame:
    """One row for each text, with the packed prefix keys to be sent.

    A packed key has 44 bits of hash, 9 of the set's members from here on, 1 that tells
    single words, 10 of all members (the highest number stands for it and more). Within a partition only the first text of a class and side has keys.
    """
    shared = texts.sparkSession.sparkContext.broadcast(tables)
    left_out = frozenset(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        mean = {s: float(held.counts[s].mean()) for s in held.counts}
        hot = {s: max(CELL, math.ceil(4 * mean[s])) for s in mean}
        bare = held.bare["e"] or held.bare["t"]
        hashes, seen = WordHashes(left_out), set()
        for batch in _chunks(batches):
            bags = _Bags(batch.column("text").to_pylist(), hashes)
            words_of, value = bags.numbered()
            bags.identify(words_of, value)
            sides = np.array(batch.column("side").to_pylist())
            fresh = np.zeros(len(sides), dtype=bool)
            for i, pair in enumerate(zip(sides.tolist(), bags.cid.tolist())):
                if bags.n[i] and pair not in seen:
                    seen.add(pair)
                    fresh[i] = True
            member, key = bags.sets(words_of, value, RICH if bare else POOR)
            share = bags.richness()
            use = fresh[member // 3]
            member, key = member[use], key[use]
            place = _bucket(key)
            rarity = held.counts["e"][place].astype(np.int64) + held.counts["t"][place]
            rarity = np.minimum(rarity, (1 << COUNT_BITS) - 1).astype(np.uint64)
            line = (member.astype(np.uint64) << _U(KEY_BITS + COUNT_BITS)) | (rarity << _U(KEY_BITS)) | key
            line = np.unique(line)
            member = (line >> _U(KEY_BITS + COUNT_BITS)).astype(np.int64)
            key = line & _U((1 << KEY_BITS) - 1)
            m = np.bincount(member, minlength=3 * len(sides))
            start = np.concatenate([[0], np.cumsum(m)[:-1]])
            rank = np.arange(len(member)) - start[member]
            threshold = np.tile([SHINGLE, SINGLE, SHINGLE], len(sides))
            prefix = m - np.ceil(threshold * m - 1e-9).astype(np.int64) + 1
            is_e = (sides == "e")[member // 3]
            there = np.where(is_e, held.holds("t", key), held.holds("e", key))
            if bare:
                every = member % 3 == 2
                twice = _bare(key)
                near_bare = np.where(is_e, held.holds("t", twice), held.holds("e", twice))
                there = np.where(every & (share >= POOR)[member // 3], near_bare, there)
            use = (rank < prefix[member]) & there
            member, key, rank, is_e = (x[use] for x in (member, key, rank, is_e))
            place = _bucket(key)
            wide = {
                s: np.where(held.counts[s][place] > hot[s], -(-held.counts[s][place].astype(np.int64) // hot[s]), 1)
                for s in ("e", "t")
            }
            grid = (wide["e"] > 1) | (wide["t"] > 1)
            key = key << _U(4)
            if grid.any():
                times = np.where(is_e, wide["t"], wide["e"])
                back = np.repeat(np.arange(len(member)), times)
                across = np.arange(len(back)) - np.repeat(np.cumsum(times) - times, times)
                member, key, rank, is_e = member[back], key[back], rank[back], is_e[back]
                wide_e, wide_t = wide["e"][back], wide["t"][back]
                own = bags.cid[member // 3]
                line_e = np.where(is_e, (own % wide_e.astype(np.uint64)).astype(np.int64), across)
                line_t = np.where(is_e, across, (own % wide_t.astype(np.uint64)).astype(np.int64))
                cell = (line_e * wide_t + line_t).astype(np.uint64)
                moved = mix(key + cell * _U(0x9E3779B97F4A7C15)) >> _U(20)
                key = np.where(cell > 0, moved, key)
            rest = np.minimum(m[member] - rank, 511).astype(np.uint64)
            kind = (member % 3 == 1).astype(np.uint64)
            packed = (key << _U(20)) | (rest << _U(11)) | (kind << _U(10)) | np.minimum(m[member], 1023).astype(np.uint64)
            sizes = np.bincount(member // 3, minlength=len(sides))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            made = pa.RecordBatch.from_arrays(
                [
                    batch.column("rid"),
                    batch.column("field"),
                    batch.column("side"),
                    pa.array(bags.cid.view(np.int64)),
                    *[pa.array(bags.bits[:, k]) for k in range(LANES)],
                    pa.ListArray.from_arrays(offsets, pa.array(packed.view(np.int64))),
                ],
                names=["rid", "field", "side", "cid", *_LANES, "keys"],
            )
            yield made.filter(pa.array(bags.n > 0))

    return texts.select("rid", "field", "side", "text").mapInArrow(run, ROW_SCHEMA)


def _pair_filter(threshold: float) -> str:
    """Join condition on rows ``e`` and ``t``: the filters as SQL, all of them bounds."""
    n = lambda x: f"({x}.b0 & 65535)"
    share = (1 - threshold) / (1 + threshold)
    differ = " + ".join(["bit_count((e.b0 ^ t.b0) & -65536L)", *[f"bit_count(e.{b} ^ t.{b})" for b in _LANES[1:]]])
    lengths = f"least({n('e')}, {n('t')}) >= {threshold} * greatest({n('e')}, {n('t')}) - 1e-9"
    parity = f"{differ} <= {share} * ({n('e')} + {n('t')}) + 1e-9"
    unknown = f"greatest({n('e')}, {n('t')}) = 65535"
    single = lambda x: f"({x}.packed & 1024)"
    return f"{single('e')} = {single('t')} and ({unknown} or ({lengths} and {parity}))"


def _position() -> str:
    """Members from the first meeting of a pair on, at least what its sizes ``m`` and ``n`` require.

    ``rest`` is the most over the meetings. It holds for the first alone: later meetings of
    a true pair may have less left, and all of them count towards :func:`_meetings`.
    """
    return f"(rest = 511 or rest >= {SHINGLE / (1 + SHINGLE)} * (m + n) - 1e-9)"


def _meetings() -> str:
    """The least number of keys in which a true pair meets, from the sizes ``m`` and ``n`` of its sets."""
    least = lambda t: f"ceil({t / (1 + t)} * (m + n) - 1e-9) - ceil({t} * greatest(m, n) - 1e-9) + 1"
    return f"if(greatest(m, n) = 1023, 1, if(single, {least(SINGLE)}, {least(SHINGLE)}))"


def split_overlaps(texts: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Verified links ``(a, b, similarity)`` from evaluation to training classes, and the
    members ``(side, cid, rid)`` of the classes."""
    common = common_words(texts, COMMON)
    signed = staged(prefix_rows(texts, common, shingle_tables(texts, common)), "overlap")
    members = signed.select("side", "cid", "rid").distinct()

    def rows(side: str) -> DataFrame:
        sent = signed.where((F.col("side") == side) & (F.size("keys") > 0)).select(
            F.explode("keys").alias("packed"), "cid", *_LANES
        )
        keyed = sent.withColumn("key", F.expr("shiftright(packed, 20)"))
        return (
            keyed.repartition(F.col("key")).groupBy("key", "packed", "cid", *_LANES).agg(F.lit(1).alias("one"))
        )

    found = (
        rows("e")
        .alias("e")
        .join(rows("t").alias("t"), F.expr("e.key = t.key and " + _pair_filter(threshold)))
        .where("e.cid <> t.cid")
        .groupBy(
            F.col("e.cid").alias("a"),
            F.col("t.cid").alias("b"),
            F.expr("cast(e.packed & 2047 as int)").alias("m"),
            F.expr("cast(t.packed & 1023 as int)").alias("n"),
        )
        .agg(
            F.count("*").alias("met"),
            F.expr("max(least(shiftright(e.packed, 11) & 511, shiftright(t.packed, 11) & 511))").alias("rest"),
        )
        .withColumn("single", F.expr("m >= 1024"))
        .withColumn("m", F.expr("m & 1023"))
        .where("met >= " + _meetings() + " and " + _position())
        .select("a", "b")
    )
    both = members.where("side = 'e'").select("cid").intersect(members.where("side = 't'").select("cid"))
    pairs = staged(found.distinct(), "overlap-pairs")
    one = signed.where(F.size("keys") > 0).groupBy("cid").agg(F.first(F.struct("rid", "field")).alias("one"))
    held = class_texts(pairs, ["a", "b"], one.select("cid", "one.*"), texts)
    links = verified(pairs, held, held, threshold)
    same = both.select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(1.0).alias("similarity"))
    return links.unionByName(same), members


def overlap_pairs(texts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``(id_a, id_b)``: records of the two sides with near-same texts."""
    links, members = split_overlaps(texts, threshold)
    sides = [members.where(F.col("side") == s).select("cid", "rid") for s in ("e", "t")]
    none = members.select(F.col("rid").alias("x"), F.col("rid").alias("y")).where("false")
    return record_pairs(links, sides[0], sides[1], none)


def overlap_report(texts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """For each table, split and source: records of the evaluation side, and how many of them overlap."""
    links, members = split_overlaps(texts, threshold)
    hit = (
        links.select(F.col("a").alias("cid"))
        .distinct()
        .join(members.where("side = 'e'").select("cid", "rid"), "cid")
        .select("rid")
        .distinct()
        .withColumn("hit", F.lit(1))
    )
    asked = texts.where("side = 'e'").select("rid", "table", "split", "source").distinct()
    return (
        asked.join(hit, "rid", "left")
        .groupBy("table", "split", "source")
        .agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))
    )
