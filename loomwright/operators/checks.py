"""Declarative checks on texts and their roll-up; judge scores; near-duplicate audit."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.session import staged


SAMPLE, STOCK = 10_000, 3
"""Texts from which the stock shingles are told, and how many of them hold one."""
PLACES = 1 << 18
"""Places of the filter on keys: its size, and so what is broadcast, is fixed."""
MORE = 50
"""A text is asked for one more meeting for every so many shingles."""
BINS = 64
"""Bins by which the shingles of a set are counted."""
FLUSH = 1 << 22
"""Shingles after which a batch is handed on."""

PREPARED = ("_body", "_folded", "_words", "_stripped", "_absent")


def prepared(df: DataFrame, text: str = "text") -> DataFrame:
    """The forms of a text that checks ask for, made once before a text meets its checks."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        *[c for c in df.columns if c != text],
        body.alias("_body"),
        T.fold(body).alias("_folded"),
        F.size(T.spaced(body)).alias("_words"),
        (T.strip(body) != "").alias("_stripped"),
        F.col(text).isNull().alias("_absent"),
    )


def evaluate(df: DataFrame, text: str = "text") -> DataFrame:
    """Apply the check of each row to its text: adds ``status`` and ``passed``.

    Columns of a check: ``kind``, ``wanted`` (array of strings), ``low``, ``high``. The text
    is a column, or stands in the columns of :func:`prepared`. A missing text fails the
    kinds that forbid something (the check has no subject); an unknown kind is
    ``unknown_kind``; an unscored check has a null ``passed``.
    """
    kept = df.columns
    rows = df if "_body" in kept else prepared(df.withColumn("_text", F.col(text)), "_text")
    holds = lambda w: F.contains("_folded", T.fold(w))
    rules: dict[str, Column] = {
        "nonempty": F.col("_stripped"),
        "contains": F.exists("wanted", holds),
        "excludes": ~F.exists("wanted", holds),
        "excludes_all": ~F.exists("wanted", holds),
        "word_range": F.col("_words").between(F.col("low"), F.col("high")),
        "exact": F.exists("wanted", lambda w: w == F.col("_body")),
        "alias_answer": F.exists("wanted", lambda w: T.alias(w) == T.alias(F.col("_body"))),
    }
    passed, known = F.lit(None).cast("boolean"), list(rules)
    for kind, rule in rules.items():
        passed = F.when(F.col("kind") == kind, rule).otherwise(passed)
    absent = F.col("_absent") & F.col("kind").isin("excludes", "excludes_all", "exact")
    status = F.when(~F.col("kind").isin(*known), "unknown_kind").when(absent, "unscored").otherwise("ok")
    return rows.select(*kept, status.alias("status"), F.when(absent, False).otherwise(passed).alias("passed"))


_LINK = r"\\[\\[([^\\]|#]+)(?:[#|][^\\]]*)?\\]\\]"


def evaluate_files(df: DataFrame, before: str = "before", after: str = "after", seen: str = "seen") -> DataFrame:
    """Apply the file check of each row: adds ``passed``, null for an unknown kind.

    Columns: two file maps, ``seen`` (what successful reads and searches returned), and a
    check with ``kind``, ``path``, ``wanted`` (array of strings) and ``high``. Kinds:

    * ``protected``: the file at ``path`` is as it was; with ``wanted``, its first text
      stands in the file before and after;
    * ``allowed_changes``: every path that was added, removed or changed fits a pattern;
    * ``kb_word_budget``: the files under ``kb/`` have at most ``high`` words;
    * ``wiki_links``: ``kb/`` has two pages or more, all their ``[[links]]`` name pages, and
      ``path`` (else ``kb/index.md``) reaches every page;
    * ``evidence_exposed``: some of ``seen`` holds a wanted text, letter case aside.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = df.withColumns({
        "_b": F.coalesce(before, none), "_a": F.coalesce(after, none), "_w": F.coalesce("wanted", F.array().cast("array<string>")),
    }).withColumn("_kb", F.map_filter("_a", lambda p, t: p.startswith("kb/")))
    was, now = F.try_element_at("_b", F.col("path")), F.try_element_at("_a", F.col("path"))
    wanted = F.get("_w", F.lit(0))
    protected = F.when(F.size("_w") == 0, was.eqNullSafe(now)).otherwise(
        F.coalesce(F.contains(now, wanted) & F.contains(was, wanted), F.lit(False))
    )
    paths = F.array_union(F.map_keys("_b"), F.map_keys("_a"))
    changed = F.filter(paths, lambda p: ~F.try_element_at("_b", p).eqNullSafe(F.try_element_at("_a", p)))
    allowed = F.forall(changed, lambda p: F.exists("_w", lambda g: F.rlike(p, _glob(g))))
    words = F.aggregate(F.transform(F.map_values("_kb"), lambda t: F.size(T.spaced(t))), F.lit(0), lambda s, n: s + n)
    reach = F.expr(
        "aggregate(sequence(1, greatest(size(_kb), 1)), array(coalesce(path, 'kb/index.md')), (s, _) -> array_distinct(concat(s, "
        f"flatten(transform(filter(s, p -> map_contains_key(_kb, p)), p -> transform(regexp_extract_all(_kb[p], '{_LINK}', 1), "
        "l -> concat('kb/', trim(l), '.md')))))))"
    )
    links = (
        (F.size("_kb") >= 2)
        & F.forall(reach, lambda p: F.map_contains_key("_kb", p))
        & (F.size(F.array_except(F.map_keys("_kb"), reach)) == 0)
    )
    exposed = F.exists("_w", lambda w: F.exists(F.coalesce(seen, F.array().cast("array<string>")), lambda s: F.contains(T.fold(s), T.fold(w))))
    kinds = {
        "protected": protected, "allowed_changes": allowed, "kb_word_budget": words <= F.col("high"),
        "wiki_links": links, "evidence_exposed": exposed,
    }
    passed = F.lit(None).cast("boolean")
    for kind, rule in kinds.items():
        passed = F.when(F.col("kind") == kind, rule).otherwise(passed)
    return rows.select(*df.columns, passed.alias("passed"))


def _glob(pattern: Column) -> Column:
    """A shell pattern of ``*`` and ``?`` as an anchored regular expression."""
    quoted = F.regexp_replace(pattern, r"([\\.^$+{}()|\[\]])", r"\\$1")
    return F.concat(F.lit("^(?s:"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\?", "."), F.lit(")$"))


def roll_up(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted share of passed checks for each metric; pending until all are scored."""
    scored = F.col("status") == "ok"
    weight = F.coalesce(F.col("weight"), F.lit(1.0))
    total = F.sum(F.when(scored, weight))
    return checks.groupBy(*keys, "metric").agg(
        F.try_divide(F.sum(F.when(scored & F.col("passed"), weight).otherwise(F.lit(0.0))), total).alias("value"),
        F.when(F.bool_and(scored), "ok").otherwise("pending").alias("status"),
        F.count_if(~scored).alias("pending"),
    )


def required_verdict(checks: DataFrame, keys: list[str]) -> DataFrame:
    """0 when a required check failed, 1 when all passed, null while one is unscored."""
    asked = F.col("required")
    failed = F.bool_or(asked & (F.col("passed") == F.lit(False)))
    open_ = F.bool_or(asked & (F.col("status") != "ok"))
    return checks.groupBy(*keys).agg(
        F.when(failed, 0).when(F.coalesce(open_, F.lit(False)), None).otherwise(1).alias("verdict")
    )


def judge_scores(reviews: DataFrame, weights: dict[str, float], negative: list[str], most: float = 5.0) -> DataFrame:
    """Each review's weighted mean over its criteria: ``(review_id, judge, score, criteria)``.

    The last value of a criterion wins; values are clamped to 0 and ``most``; negative
    criteria count backwards. A criterion without a weight counts 1.
    """
    told = F.transform("record.assessments", lambda a: F.struct(a["metric"].alias("metric"), a["value"].alias("value")))
    one = reviews.where("record.status = 'ok'").select("review_id", "record.judge", told.alias("told"))
    rows = one.dropDuplicates(["review_id"]).select("review_id", "judge", F.posexplode("told").alias("pos", "a"))
    last = rows.groupBy("review_id", "judge", F.lower(F.trim("a.metric")).alias("metric")).agg(
        F.max_by(F.col("a.value").cast("double"), "pos").alias("value")
    )
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("metric") == name.lower(), F.lit(float(w))).otherwise(weight)
    clamped = F.greatest(F.lit(0.0), F.least(F.col("value"), F.lit(most)))
    turned = F.when(F.col("metric").isin([n.lower() for n in negative]), most - clamped).otherwise(clamped)
    valued = last.where("value is not null").withColumns({"w": weight, "x": turned})
    return valued.groupBy("review_id", "judge").agg(
        F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("score"), F.count("*").alias("criteria")
    )


def staccato_factor(index: Column, free: float = 5.0, ceiling: float = 18.0, floor: float = 0.6) -> Column:
    """A penalty that falls from 1 to ``floor`` between two indices."""
    middle = 1 - (index - free) / (ceiling - free) * (1 - floor)
    return F.when(index < free, 1.0).when(index > ceiling, floor).otherwise(middle)


def overlap_audit(df: DataFrame, key: str, text: str = "text", threshold: float = 0.85, sketch: int = 12) -> DataFrame:
    """Near-duplicate pairs by bottom-``sketch`` shingle hashes: ``(left, right, jaccard)``.

    Texts with the same five-word shingles are one class, told by its smallest key; the
    pairs are between classes, :func:`overlap_members` lists the texts of each class. All
    near-duplicate texts are the members of a pair of classes, and those of one class.
    Pairs that share none of their smallest hashes are not candidates.

    Stock shingles among the smallest hashes are shared by pairs without number, so classes
    don't meet on these. They meet on a prefix: in any order of all shingles, two sets that
    reach the threshold share ``more`` of their first ``n - ceil(threshold * n) + more``
    shingles, and behind each of these meetings enough shingles must be left. Stock shingles
    come last in the order, and ``more`` grows with the set, so that few pairs meet by
    chance. Pairs that met are then held to the smallest hashes, and what is left to the
    shingles of both, made again for these texts alone. No filter loses a pair.
    """
    kind = df.schema[key].dataType.simpleString()
    words = _joined(df, key, text)
    shared = df.sparkSession.sparkContext.broadcast(_stock(words, df.count()))

    def sign(s: np.ndarray) -> tuple:
        stock, counts = shared.value
        at = np.searchsorted(stock, s)
        often = np.where(stock[np.minimum(at, len(stock) - 1)] == s, counts[np.minimum(at, len(stock) - 1)], 0) if len(stock) else at
        least = max(1, math.ceil(threshold * len(s) - 1e-9))
        more = min(1 + len(s) // MORE, least)
        first = s[np.argsort(often, kind="stable")[: len(s) - least + more]]
        bins = np.bincount((s % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        return len(s), more, s[:sketch].view(np.int64), first.view(np.int64), bins

    columns = {"n": "int", "more": "int", "low": "array<bigint>", "prefix": "array<bigint>", "bins": "array<int>"}
    signed = _hashed(words, kind, sign, columns)
    classes = staged(
        signed.groupBy("cls")
        .agg(F.min("key").alias("key"), F.first(F.struct(*columns)).alias("one"))
        .select("cls", "key", "one.*"),
        "classes",
    )
    rows = classes.select("cls", "n", "more", F.posexplode("prefix").alias("at", "h")).select("h", "cls", "n", "more", F.expr("n - at as rest"))
    needed = F.lit(threshold / (1 + threshold)) * F.expr("a.n + b.n") - 1e-9
    met = (
        rows.alias("a")
        # of the first `more` that two sets share, the last has `more - 1` shared ones before it
        .join(rows.alias("b"), F.expr("a.h = b.h and a.cls < b.cls") & (F.expr("least(a.rest, b.rest) + least(a.more, b.more) - 1") >= needed))
        .groupBy(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"), F.expr("least(a.more, b.more) as asked"))
        .count()
        .where("count >= asked")
        .select("a", "b")
    )
    # the smallest hashes go by the key, as keys name the pairs: a repeated key has those of all its classes
    low = F.flatten(F.collect_list("low").over(Window.partitionBy("key"))).alias("low")
    told = classes.select("cls", "key", "n", low, "bins")
    ours, theirs = (
        told.select(F.col("cls").alias(x), *[F.col(c).alias(c[0] + x) for c in ("key", "n", "low", "bins")]) for x in "ab"
    )
    # shingles of one set only are at least as many as the counts of the bins differ by
    apart = F.expr("aggregate(zip_with(ba, bb, (x, y) -> abs(x - y)), 0, (s, x) -> s + x)")
    near = (
        met.join(ours, "a")
        .join(theirs, "b")
        .where("ka <> kb and arrays_overlap(la, lb)")
        .where(apart <= F.lit((1 - threshold) / (1 + threshold)) * F.expr("na + nb") + 1e-9)
    )
    ends = [F.struct(F.col("ka").alias("key"), F.col("a").alias("cls")), F.struct(F.col("kb").alias("key"), F.col("b").alias("cls"))]
    pairs = staged(near.select(F.least(*ends).alias("l"), F.greatest(*ends).alias("r")), "class-pairs")

    wanted = staged(pairs.select("l.key").union(pairs.select("r.key")).distinct(), "wanted-keys")
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(PLACES))
    places = wanted.select(F.pmod(F.xxhash64("key"), F.lit(PLACES)).alias("_place")).distinct()
    held = (
        df.select(key, text, place.alias("_place"))
        .join(F.broadcast(places), "_place", "left_semi")
        .join(wanted.withColumnRenamed("key", key), key, "left_semi")
    )
    sets = (
        _hashed(_joined(held, key, text), kind, lambda s: (s.view(np.int64),), {"s": "array<bigint>"})
        .groupBy("cls")
        .agg(F.first("s").alias("s"))
    )
    both = F.size(F.array_intersect("ls", "rs"))
    value = both / (F.size("ls") + F.size("rs") - both)
    return (
        pairs.select(F.col("l.key").alias("left"), F.col("l.cls").alias("lc"), F.col("r.key").alias("right"), F.col("r.cls").alias("rc"))
        .join(sets.select(F.col("cls").alias("lc"), F.col("s").alias("ls")), "lc")
        .join(sets.select(F.col("cls").alias("rc"), F.col("s").alias("rs")), "rc")
        .select("left", "right", value.alias("jaccard"))
        .where(F.col("jaccard") >= threshold)
    )


def _joined(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, w)``: the words of each text, joined by blanks."""
    return df.select(F.col(key).alias("key"), F.array_join(T.tokens(F.col(text), T.PLAIN_TOKEN), " ").alias("w"))


def _shingles(words: str | None) -> np.ndarray:
    """The different hashes of the runs of five words, smallest first: the first eight bytes of SHA-256."""
    body = (words or "").encode()
    cuts = [-1, *np.flatnonzero(np.frombuffer(body, np.uint8) == 32).tolist(), len(body)]
    made = b"".join([hashlib.sha256(body[i + 1 : j]).digest() for i, j in zip(cuts, cuts[5:])])
    return np.unique(np.frombuffer(made, ">u8")[::4].astype(np.uint64))


def _hashed(words: DataFrame, kind: str, make: Callable[[np.ndarray], tuple], columns: dict[str, str]) -> DataFrame:
    """``(key, cls, *columns)`` of each text of five words or more: a hash of all its shingles and what is made of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            out = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(cls, pa.int64())]
            for kind, values in zip(columns.values(), zip(*rows)):
                if kind == "int":
                    out.append(pa.array(values, pa.int32()))
                else:
                    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
                    item = pa.int32() if kind == "array<int>" else pa.int64()
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), item)))
            return pa.RecordBatch.from_arrays(out, names=["key", "cls", *columns])

        for batch in batches:
            at, cls, rows, held = [], [], [], 0
            for k, text in enumerate(batch.column(1).to_pylist()):
                s = _shingles(text)
                if not len(s):
                    continue
                at.append(k)
                cls.append(int.from_bytes(hashlib.sha256(s.tobytes()).digest()[:8], "little", signed=True))
                rows.append(make(s))
                held += len(s)
                if held > FLUSH:
                    yield made()
                    at, cls, rows, held = [], [], [], 0
            if at:
                yield made()

    return words.mapInArrow(run, ", ".join([f"key {kind}", "cls bigint", *[f"{n} {t}" for n, t in columns.items()]]))


def _stock(words: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in ``STOCK`` or more of about ``SAMPLE`` texts, sorted, and in how many.

    They only order the shingles; any order gives the same pairs. As the texts of the
    sample are so many at most, so are the shingles, whatever the size of the table.
    """
    some = words.where(F.pmod(F.xxhash64("key"), F.lit(max(1, texts // SAMPLE))) == 0)
    kind = words.schema["key"].dataType.simpleString()
    sets = _hashed(some, kind, lambda s: (s.view(np.int64),), {"s": "array<bigint>"})
    often = sets.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= STOCK).toArrow()
    stock, counts = (often.column(c).to_numpy() for c in ("h", "n"))
    order = np.argsort(stock.view(np.uint64))
    return stock.view(np.uint64)[order], counts[order]


def overlap_members(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, class)``: every text of five words or more with the smallest key of its class,
    by which :func:`overlap_audit` tells it; texts of a class have similarity 1."""
    # staged with the shingles: pruned, their tokens would be made anew for every shingle
    classes = staged(shingle_classes(df, key, text), "shingle-classes").select("key", "cls")
    named = classes.groupBy("cls").agg(F.min("key").alias("class"))
    return classes.join(named, "cls").select("key", "class").distinct()


def shingle_classes(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, s, cls)``: sorted shingle hashes of each text and the hash of all of them."""
    words = df.select(F.col(key).alias("key"), T.tokens(F.col(text), T.PLAIN_TOKEN).alias("w")).where("size(w) >= 5")
    grams = words.select("key", T.ngrams(F.col("w"), 5).alias("g"))
    hashed = F.array_sort(F.array_distinct(F.transform("g", lambda x: F.substring(F.sha2(x, 256), 1, 16))))
    return grams.select("key", hashed.alias("s")).withColumn("cls", F.sha2(F.array_join("s", ""), 256))
