"""Texts cut off by field limits or in transfer.

For every source and kind of text, the hazard of a length is the share of the texts
still running at that length that end there. A field limit is a length whose hazard
stands out from that of all lengths up to ``REACH`` away, those where no text ends
included (by window functions): its count is tested against the count the neighbours'
hazard lets expect (a Poisson tail, bounded by Chernoff), and the lengths of a group are
screened with false-discovery control at ``FALSE_RATE`` (Benjamini-Hochberg). Stock
sentences also pile up at one length; so the texts that end at a limit must besides be
unfinished more often than those of the rest of the group, tested the same way.

At a limit every unfinished ending is a cut, those included that a writer may leave open
elsewhere (titles, list items, verse, links, code, bare answers, a quoted question or cry
whose sentence would go on); ``how`` tells ``limit``. Elsewhere the loss happened in
transfer, and only an ending that no writer leaves is flagged; ``how`` tells ``transfer``.

Defined results: null, empty and blank texts and placeholders are not cut; a repeated
record counts once; a text of only one line is judged as prose.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import staged

REACH = 12
FALSE_RATE = 0.001
LEAST = 4

WHOLE, OPEN, QUOTED, BROKEN, EMPTY = range(5)
"""Endings: a finished text, one a writer may leave open, a quoted question, a broken one."""

_BLANK = "​‌‍⁠﻿"
_PLACEHOLDER = re.compile(r"(?:[.…\-–—_*·•\s]*|n\s*/?\s*a\.?|none|null|nil|tbd|todo|empty|no (?:answer|content|output|response)|[\[(<](?:empty|blank|none|null|n/a|no \w+)[\])>])", re.I)
_CLOSERS = "\"'”’»“‘)]}*_`›"
_ITEM = re.compile(r"\s*(?:[-*•+]|\d{1,3}[.)])\s+\S")
_LABEL = re.compile(r"\s*(?:#{1,6}\s+\S|[^\W\d_][\w' ]{0,24}:\s+\S)")
_FILE = re.compile(r"[\w/.-]+\.\w{1,5}$")
_CODE = re.compile(r"(?:^|\s)(?:return|def|import|const|let|var|print)\b.*[(=:]|[;{}]\s*$|\w\(.*\)\s*[:=]|==|=>|->")
_BARE_ANSWER = re.compile(r"[^.!?,;:…]{0,40}\s[-+]?[$€£]?\d[\d.,]*\s?%?")
_LINK = re.compile(r"(?:https?://\S+|\[\[[^\[\]]+\]\]|\]\([^()\s]+\))$")


_UNSEEN = {ord(c): None for c in _BLANK}


def _visible(text: str) -> str:
    return text if text.isascii() else text.translate(_UNSEEN)


def is_blank(text: str | None) -> bool:
    """Nothing, only blanks, or a placeholder such as dots, a dash or N/A."""
    if text is None:
        return True
    if len(text) > 200 and text[:1].isalnum():
        return False  # a long text that begins with a letter or digit
    bare = _visible(text).strip()
    return not bare or (len(bare) <= 24 and _PLACEHOLDER.fullmatch(bare) is not None)


def ending(text: str | None) -> int:
    """How a text ends; see the constants."""
    if text is None or is_blank(text):
        return EMPTY
    body = _visible(text).rstrip()
    if body[0] in "{[" and (body[0] == "{" or not body.startswith("[[")):
        if body[-1] in "}]":
            try:
                json.loads(body)
                return WHOLE
            except ValueError:
                pass
        elif body[0] == "{" and re.match(r'\{\s*("|$)', body):
            return BROKEN
    if body[-1] == "�":
        return BROKEN
    core = body.rstrip(_CLOSERS + "   ")
    if not core:
        return WHOLE
    last = core[-1]
    if last in ".!?…。！？":
        closed = len(core) < len(body) and any(c in "\"”»“›" for c in body[len(core) :])
        return QUOTED if closed and last in "!?" else WHOLE
    if last in "—–" and len(core) < len(body):
        return WHOLE  # speech broken off by the writer
    lines = body.split("\n")
    line = lines[-1]
    if line.count("[[") > line.count("]]"):
        return BROKEN
    if _LINK.search(line):
        return OPEN
    if len(lines) > 1:
        if _ITEM.match(line) or _LABEL.match(line) and len(line) <= 80:
            return OPEN
        if len(line) <= 80 and _FILE.search(line):
            return OPEN
        before = lines[-2].rstrip()
        if before.endswith(",") and len(before) <= 60 and len(line) <= 60 and line.strip():
            return OPEN  # verse
    elif _BARE_ANSWER.fullmatch(body):
        return OPEN  # one clause that ends on a number
    if _CODE.search(line):
        return OPEN
    return BROKEN


def text_units(probes: DataFrame, reviews: DataFrame) -> DataFrame:
    """``(record_id, msg_pos, source, kind, text)`` of messages and outputs."""
    said = probes.select(
        F.col("id").alias("record_id"),
        F.col("provenance.source").alias("source"),
        F.posexplode("messages").alias("msg_pos", "m"),
    ).select("record_id", "msg_pos", "source", F.col("m.role").alias("kind"), F.col("m.content").alias("text"))
    given = reviews.select(
        F.col("review_id").alias("record_id"),
        F.lit(0).alias("msg_pos"),
        "source",
        F.lit("output").alias("kind"),
        F.col("packet.output").alias("text"),
    )
    return said.unionByName(given).where("text is not null and record_id is not null")


def with_endings(units: DataFrame) -> DataFrame:
    """``(record_id, msg_pos, source, kind, length, ending)``; the text is left behind."""
    schema = "record_id string, msg_pos int, source string, kind string, length int, ending int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("record_id", "msg_pos", "source", "kind")],
                    pa.array([len(t) for t in texts], pa.int32()),
                    pa.array([ending(t) for t in texts], pa.int32()),
                ],
                names=["record_id", "msg_pos", "source", "kind", "length", "ending"],
            )

    return units.select("record_id", "msg_pos", "source", "kind", "text").mapInArrow(run, schema)


def length_limits(lengths: DataFrame) -> DataFrame:
    """``(source, kind, length, hazard, expected)`` of the field limits.

    ``lengths`` has ``source, kind, length, ending``; a null source is a source of its own.
    The windows run over counts per length, at most the longest text's length for a group;
    lengths where no text ends get a row of their own if they are near one where some do.
    """
    group = ["source", "kind"]
    counted = (
        lengths.where((F.col("length") > 0) & (F.col("ending") != EMPTY))
        .groupBy(*group, "length")
        .agg(F.count("*").alias("n"), F.count_if(F.col("ending") != WHOLE).alias("unfinished"))
    )
    by_length = Window.partitionBy(*group).orderBy("length")
    whole = Window.partitionBy(*group)
    running = (
        counted.withColumn("at_risk", F.sum("n").over(by_length.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("before", F.coalesce(F.lag("length").over(by_length), F.lit(0)))
        .withColumn("others", F.sum("n").over(whole) - F.col("n"))
        .withColumn("others_unfinished", F.sum("unfinished").over(whole) - F.col("unfinished"))
    )
    # the lengths between two that occur, as far as they are near one of them
    gap = F.expr(
        f"if(length - before > 1, array_union(sequence(before + 1, least(before + {REACH}, length - 1)), "
        f"sequence(greatest(before + 1, length - {REACH}), length - 1)), cast(array() as array<int>))"
    )
    silent = running.select(
        *group, F.explode(gap).alias("length"), F.lit(0).cast("long").alias("n"), "at_risk",
        *[F.lit(0).cast("long").alias(c) for c in ("unfinished", "others", "others_unfinished")],
    )
    around = by_length.rangeBetween(-REACH, REACH)
    near = (
        running.drop("before")
        .unionByName(silent)
        .withColumn("near_n", F.sum("n").over(around) - F.col("n"))
        .withColumn("near_risk", F.sum("at_risk").over(around) - F.col("at_risk"))
        .where("n > 0")
        .withColumn("expected", F.col("at_risk") * (F.col("near_n") + 0.5) / (F.col("near_risk") + 1.0))
        .withColumn("expected_unfinished", F.col("n") * (F.col("others_unfinished") + 0.5) / (F.col("others") + 1.0))
    )
    ranked = (
        near.withColumn("log_p", _log_tail("n", "expected"))
        .withColumn("rank", F.row_number().over(whole.orderBy("log_p", "length")))
        .withColumn("tests", F.count("*").over(whole))
        .withColumn("passes", F.col("log_p") <= F.log(F.lit(FALSE_RATE) * F.col("rank") / F.col("tests")))
        .withColumn("last", F.max(F.when(F.col("passes"), F.col("rank"))).over(whole))
    )
    stands_out = (F.col("rank") <= F.col("last")) & (F.col("n") >= LEAST)
    unfinished = (F.col("unfinished") >= LEAST) & (_log_tail("unfinished", "expected_unfinished") <= math.log(FALSE_RATE))
    return ranked.where(stands_out & unfinished).select(
        *group, "length", (F.col("n") / F.col("at_risk")).alias("hazard"), "expected"
    )


def _log_tail(count: str, expected: str) -> Column:
    """Chernoff's bound of the logarithm of a Poisson tail, 0 where the count is not above it."""
    n, mean = F.col(count), F.col(expected)
    return F.when(n > mean, n - mean - n * F.log(n / mean)).otherwise(F.lit(0.0))


def cut_units(endings: DataFrame, limits: DataFrame) -> DataFrame:
    """The units with ``cut`` and ``how`` set; ``endings`` as from :func:`with_endings`."""
    mark = limits.select(
        F.col("source").alias("l_source"), F.col("kind").alias("l_kind"), F.col("length").alias("l_length")
    )
    met = F.col("source").eqNullSafe(F.col("l_source")) & F.col("kind").eqNullSafe(F.col("l_kind")) & (
        F.col("length") == F.col("l_length")
    )
    at_limit = F.col("l_length").isNotNull() & F.col("ending").isin(OPEN, QUOTED, BROKEN)
    how = F.when(at_limit, F.lit("limit")).when(F.col("ending") == BROKEN, F.lit("transfer"))
    marked = endings.join(mark, met, "left").withColumn("how", how).withColumn("cut", F.col("how").isNotNull())
    return marked.drop("l_source", "l_kind", "l_length")


def cut_texts(probes: DataFrame, reviews: DataFrame) -> DataFrame:
    """``(record_id, msg_pos)`` of the cut texts."""
    endings = staged(with_endings(text_units(probes, reviews)), "cuts")
    units = cut_units(endings, length_limits(endings))
    return units.where("cut").select("record_id", "msg_pos").distinct()


def cut_rates(probes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Texts that are not empty, cut ones among them, and their share, for each source."""
    endings = staged(with_endings(text_units(probes, reviews)).where(F.col("ending") != EMPTY).distinct(), "cuts")
    units = cut_units(endings, length_limits(endings))
    return units.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.count_if("cut").alias("cut"),
        F.count_if(F.col("how") == "limit").alias("at_limits"),
        (F.count_if("cut") / F.count("*")).alias("share"),
    )
