"""Native text expressions: folding, tokens, sentences, n-grams, hashes, path rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*"
PLAIN_TOKEN = r"[\p{L}\p{N}_]+"


def fold(text: Column) -> Column:
    """Case folding as far as it differs from lower-casing in the corpora: ß is ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """Folded words; null for null."""
    return F.regexp_extract_all(fold(text), F.lit(pattern), F.lit(0))


def spaced(text: Column) -> Column:
    """The pieces between runs of white space, without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Pieces that end with a full stop, question or exclamation mark and white space."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda x: x != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words, joined by blanks; empty when there are fewer."""
    if n == 1:
        return words
    last = F.size(words) - F.lit(n - 1)
    return F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def share(part: Column, whole: Column) -> Column:
    """A ratio; null when nothing is counted."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text as a JSON string."""
    inside = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.sha2(F.substring(inside, F.lit(2), F.length(inside) - 2), 256))


def canonical_hash(tag: str, value: Column) -> Column:
    """SHA-256 of a domain tag and a value; no two domains share a hash by accident."""
    return F.sha2(F.concat(F.lit(tag + "\x00"), value), 256)


def seed64(text: Column) -> Column:
    """The first eight bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def alias(text: Column) -> Column:
    """An answer as aliases are compared: folded, blanks collapsed, end marks off."""
    return F.regexp_replace(strip(F.regexp_replace(fold(text), r"(?U)\s+", " ")), r"^[.!?]+|[.!?]+$", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def safe_path(path: Column) -> Column:
    """A relative POSIX path without empty, dot or parent parts, backslashes or NUL."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return (F.length(path) > 0) & ~bad & ~path.contains("\\") & ~path.contains("\x00")


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2)
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif c == "[" and end > 0:
            inside = pattern[i + 1 : end]
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else inside).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append("\\" + c if c in r"\.^$+{}()|[]" else c)
        i += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of the shell patterns."""
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(p)) for p in patterns], F.lit(False))


# Residue of web pages; fixed values.
WEB_RESIDUE = (
    r"(copyright|all rights reserved|privacy policy|\bcookies?\b|subscribe|sign in|log in|share this|follow us|"
    r"contact us|terms of use|click here|read more|advertisement|sponsored|powered by)"
)


def clean_web(text: Column, min_words: int = 40) -> Column:
    """The lines of a page without navigation, credits and rules; null if little is left.

    A line goes if it is blank, has two bars or more, is a short residue line, or has no
    letters.
    """
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip)
    kept = F.filter(
        lines,
        lambda x: (x != "")
        & (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) < 2)
        & ~(x.rlike("(?i)" + WEB_RESIDUE) & (F.size(spaced(x)) < 12))
        & ~x.rlike(r"^[^\p{L}]+$"),
    )
    return F.when(F.size(spaced(F.array_join(kept, " "))) >= min_words, F.array_join(kept, "\n"))


def paragraphs(text: Column) -> Column:
    """The trimmed paragraphs of a text, which blank lines part."""
    return F.filter(F.transform(F.split(text, r"\n(?U:\s)*\n"), strip), lambda x: x != "")


def opening(text: Column, min_chars: int = 800, max_chars: int = 2200) -> Column:
    """The first prose paragraphs up to ``min_chars`` characters; null if there is none.

    Title pages, production credits, chapter heads and short lines are passed over; a
    result above ``max_chars`` ends at the last blank before.
    """
    letters = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    capitals = lambda x: F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    prose = F.filter(
        paragraphs(text),
        lambda x: ~x.rlike(r"(?i)^produced by\b")
        & ~((letters(x) > 0) & (capitals(x) > 0.8 * letters(x)) & (F.length(x) < 120))
        & ~(x.rlike(r"(?i)^(chapter|book|part|letter)\b") & (F.length(x) < 40))
        & ~((F.length(x) < 80) & (blanks(x) < 8)),
    )
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0).alias("size"))
    more = lambda s, x: F.struct(F.concat(s["taken"], F.array(x)).alias("taken"), (s["size"] + F.length(x)).alias("size"))
    body = F.aggregate(
        prose, start, lambda s, x: F.when(s["size"] < min_chars, more(s, x)).otherwise(s), lambda s: F.array_join(s["taken"], "\n\n")
    )
    cut = strip(F.regexp_replace(F.substring(body, 1, max_chars), r" [^ ]*$", ""))
    return F.when(F.length(body) > max_chars, cut).when(body != "", body)


def fence(text: Column) -> Column:
    """A run of backticks longer than any in the text, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def author_of(title: Column) -> Column:
    """What stands after the last " by " of a title; null without one."""
    return F.nullif(F.regexp_extract(title, r"(?s)^.* by (.*)$", 1), F.lit(""))


def strip_wrapper(text: Column) -> Column:
    """The text between START and END markers of an archive; null without a START."""
    begin = r"(?is)\*\*\*\s*START OF (?:THE|THIS)[^*]*\*\*\*"
    inside = F.split(text, begin, 2)
    body = F.get(inside, F.lit(1))
    return strip(F.get(F.split(body, r"(?is)\*\*\*\s*END OF (?:THE|THIS)[^*]*\*\*\*", 2), F.lit(0)))
