"""Queries over texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import lexical
from loomwright.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def lexical_by_lang(spark, sf_dir):
    """A10: mean lexical features for each language."""
    f = lexical.lexical_features(_docs(spark, sf_dir).select("lang", "text").where("text is not null"))
    names = ["word_count", "distinct_1", "distinct_2", "distinct_3", "repeated_trigram_rate"]
    return f.groupBy("lang").agg(
        F.count("*").alias("texts"), *[F.round(F.avg(n), 9).alias(n) for n in names]
    )


def sentence_shape(spark, sf_dir):
    """A10: sentences and paragraphs of each text and the rates of repeated ones."""
    f = lexical.lexical_features(_docs(spark, sf_dir).select("doc_id", "text").where("text is not null"))
    return f.select(
        "doc_id",
        F.size("sentence_lengths").alias("sentences"),
        F.size("paragraph_lengths").alias("paragraphs"),
        F.round("duplicate_paragraph_rate", 9).alias("duplicate_paragraph_rate"),
        F.round("repeated_opening_rate", 9).alias("repeated_opening_rate"),
    )


def distinct_macro_pooled(spark, sf_dir):
    """Distinct-2 for each kind, macro and pooled."""
    out = lexical.macro_and_pooled(_docs(spark, sf_dir).select("kind", "text").where("text is not null"), "kind", 2)
    return out.select("kind", F.round("macro", 9).alias("macro"), F.round("pooled", 9).alias("pooled"))


def ngram_l2_lang(spark, sf_dir):
    """Distance of the pooled unigrams of every two languages."""
    out = lexical.pooled_l2(_docs(spark, sf_dir).select("lang", "text"), "lang", 1)
    return out.select("left", "right", F.round("l2", 8).alias("l2"))


def overlap_with_heldout(spark, sf_dir):
    """Share of each document's trigrams that held-out items hold."""
    out = lexical.overlap_share(
        _docs(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "heldout_items").select("text"), 3
    )
    return out.select("doc_id", F.round("overlap", 9).alias("overlap"))


def duplicate_output_rate(spark, sf_dir):
    """Repeated texts for each source."""
    out = lexical.duplicate_rate(_docs(spark, sf_dir).select("source", "text"), "source")
    return out.select("source", "texts", F.round("duplicate_rate", 9).alias("duplicate_rate"))


def self_bleu_items(spark, sf_dir):
    """Self-BLEU of the held-out items of each language."""
    items = table(spark, sf_dir, "heldout_items").select("lang", F.col("item_id").alias("doc_id"), "text")
    out = lexical.self_bleu(items, "lang")
    return out.select("lang", "samples", F.round("self_bleu", 8).alias("self_bleu"))


def cross_jaccard_items(spark, sf_dir):
    """Mean trigram Jaccard over the pairs of items of a suite and language.

    Grams are joined by value; pairs that share none add nothing to the sum, and the
    number of pairs is known from the number of items.
    """
    items = table(spark, sf_dir, "heldout_items")
    words = items.select("suite", "lang", "item_id", T.tokens(F.col("text")).alias("w"))
    sets = words.select("suite", "lang", "item_id", F.array_distinct(T.ngrams(F.col("w"), 3)).alias("g")).where("size(g) > 0")
    grams = sets.select("suite", "lang", "item_id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    a, b = grams.alias("a"), grams.alias("b")
    shared = (
        a.join(b, F.expr("a.suite = b.suite and a.lang = b.lang and a.gram = b.gram and a.item_id < b.item_id"))
        .groupBy("a.suite", "a.lang", "a.item_id", F.col("b.item_id").alias("other"), F.col("a.n").alias("n"), F.col("b.n").alias("m"))
        .agg(F.count("*").alias("both"))
        .groupBy("suite", "lang")
        .agg(F.sum(F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("total"))
    )
    counts = sets.groupBy("suite", "lang").agg(F.count("*").alias("k"))
    return counts.join(shared, ["suite", "lang"], "left").where("k > 1").select(
        "suite", "lang", F.round(F.coalesce("total", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1) / 2), 9).alias("jaccard")
    )


def content_fingerprint(spark, sf_dir):
    """SHA-256 of every text as a JSON string."""
    return _docs(spark, sf_dir).select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


def exact_dup_first(spark, sf_dir):
    """The first document with the same text, for every later one."""
    hashed = _docs(spark, sf_dir).where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("duplicate_of"))
    return hashed.join(first, "h").where("doc_id > duplicate_of").select("doc_id", "duplicate_of")


def sample_power_source(spark, sf_dir):
    """Which measures a source has samples enough for."""
    groups = _docs(spark, sf_dir).groupBy("source", "kind", "lang").agg(F.count("*").cast("int").alias("samples"))
    return lexical.sample_power(groups, "samples")


def clean_web_lines(spark, sf_dir):
    """documents after line cleaning; rejected ones keep a null."""
    plain = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"\r\n?", "\n").alias("text"))
    return plain.select("doc_id", F.sha2(T.clean_web(F.col("text")), 256).alias("cleaned"))


def wrapper_strip(spark, sf_dir):
    """what stands between archive markers; a text without a START gives null."""
    wrapped = _docs(spark, sf_dir).select(
        "doc_id",
        F.when(
            F.col("doc_id") % 2 == 0,
            F.concat(
                F.lit("Produced by volunteers\n*** START OF THIS ARCHIVE TEXT ***\n"),
                "text",
                F.lit("\n*** END OF THIS ARCHIVE TEXT ***\nlicense"),
            ),
        )
        .otherwise(F.col("text"))
        .alias("text"),
    )
    return wrapped.select("doc_id", F.length(T.strip_wrapper(F.col("text"))).alias("length"))


def _parted(spark, sf_dir):
    """Documents whose scenes are parted by blank lines: every line end is doubled."""
    return _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"\r\n?|\n", "\n\n").alias("text"))


def opening_prose(spark, sf_dir):
    """the first prose paragraphs of each document."""
    return _parted(spark, sf_dir).select("doc_id", F.sha2(T.opening(F.col("text")), 256).alias("opening"))


def eligible_first3(spark, sf_dir):
    """The first three paragraphs of 100 to 300 words of each document."""
    listed = _parted(spark, sf_dir).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "p"))
    sized = listed.select("doc_id", "pos", F.size(T.spaced(F.col("p"))).alias("words"))
    first = Window.partitionBy("doc_id").orderBy("pos")
    return (
        sized.where("words between 100 and 300")
        .withColumn("k", F.row_number().over(first))
        .where("k <= 3")
        .select("doc_id", "pos", "words", "k")
    )


def fenced_items(spark, sf_dir):
    """The fence each item needs, and the author a title names."""
    items = table(spark, sf_dir, "heldout_items").select(
        "item_id", F.concat("text", F.repeat(F.lit("`"), (F.col("item_id") % 7).cast("int"))).alias("text"), F.concat("title", F.lit(" by "), "lang").alias("title")
    )
    return items.select("item_id", F.length(T.fence(F.col("text"))).alias("fence"), T.author_of(F.col("title")).alias("author"))


def alias_answers(spark, sf_dir):
    """Titles as aliases and slugs."""
    items = table(spark, sf_dir, "heldout_items")
    return items.select("item_id", T.alias(F.concat("title", F.lit("  ."))).alias("alias"), T.slug(F.col("title")).alias("slug"))


def seed_values(spark, sf_dir):
    """Derived seeds and domain hashes of item ids."""
    items = table(spark, sf_dir, "heldout_items")
    return items.select(
        "item_id",
        T.seed64(F.col("item_id").cast("string")).alias("seed"),
        T.canonical_hash("item", F.col("title")).alias("domain_hash"),
    )


def path_rules(spark, sf_dir):
    """Safe paths and allowed shell patterns over the probes' file maps."""
    files = table(spark, sf_dir, "sft_mask_probes").select("id", F.explode(F.map_keys("expected_files")).alias("path")).distinct()
    return files.select(
        "id",
        "path",
        T.safe_path(F.col("path")).alias("safe"),
        T.matches_any(F.col("path"), ["kb/*.md", "drafts/?*"]).alias("allowed"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        lexical_by_lang, sentence_shape, distinct_macro_pooled, ngram_l2_lang, overlap_with_heldout,
        duplicate_output_rate, self_bleu_items, cross_jaccard_items, content_fingerprint, exact_dup_first,
        sample_power_source, clean_web_lines, wrapper_strip, opening_prose, eligible_first3, alias_answers,
        seed_values, path_rules, fenced_items,
    )
}

_W = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+(?:[''’][\p{L}\p{N}_]+)*')"
_SENT = r"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""


def _grams(w: str, n: int) -> str:
    if n == 1:
        return w
    return f"list_transform(generate_series(1, len({w}) - {n - 1}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"


_BLANK = r"[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


_LINES = r"""(select doc_id, generate_subscripts(l, 1) - 1 as pos, """ + _strip("unnest(l)") + r""" as p
 from (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as l from documents where text is not null))"""

ORACLES = {
    "lexical_by_lang": f"""with w as (select lang, {_W} as w from documents where text is not null),
 f as (select lang, len(w) as word_count, {', '.join(f"len(list_distinct(g{n}))::double / nullif(len(g{n}), 0) as distinct_{n}" for n in (1, 2, 3))},
  (len(g3) - len(list_distinct(g3)))::double / nullif(len(g3), 0) as repeated_trigram_rate
  from (select lang, w, {', '.join(f"{_grams('w', n)} as g{n}" for n in (1, 2, 3))} from w))
 select lang, count(*) as texts, {', '.join(f"round(avg({c}), 9) as {c}" for c in ("word_count", "distinct_1", "distinct_2", "distinct_3", "repeated_trigram_rate"))} from f group by lang""",
    "sentence_shape": rf"""with t as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_BLANK}+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '') as s,
  list_filter(list_transform(string_split(regexp_replace(text, '\n{_BLANK}*\n', chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '') as p
  from documents where text is not null),
 o as (select *, list_transform(s, lambda x: array_to_string(list_filter(regexp_split_to_array(replace(lower(x), 'ß', 'ss'), '{_BLANK}+'), lambda y: y <> '')[1:3], ' ')) as o from t)
 select doc_id, len(s) as sentences, len(p) as paragraphs,
  round((len(p) - len(list_distinct(p)))::double / nullif(len(p), 0), 9) as duplicate_paragraph_rate,
  round((len(o) - len(list_distinct(o)))::double / nullif(len(o), 0), 9) as repeated_opening_rate from o""",
    "distinct_macro_pooled": f"""with g as (select kind, {_grams('w', 2)} as g from (select kind, {_W} as w from documents where text is not null)),
 m as (select kind, avg(len(list_distinct(g))::double / nullif(len(g), 0)) as macro from g group by kind),
 p as (select kind, count(*)::double / sum(c) as pooled from (select kind, x, count(*) as c from (select kind, unnest(g) as x from g) group by all) group by kind)
 select m.kind, round(macro, 9) as macro, round(pooled, 9) as pooled from m left join p on m.kind is not distinct from p.kind""",
    "ngram_l2_lang": f"""with c as (select lang, x, count(*) as c from (select lang, unnest({_W}) as x from documents where lang is not null) group by all),
 q as (select lang, x, c::double / sum(c) over (partition by lang) as p from c),
 l as (select distinct lang from q),
 k as (select a.lang as l, b.lang as r, x from l a join l b on a.lang < b.lang join (select distinct x from q) on true)
 select l as "left", r as "right", round(sqrt(sum(pow(coalesce(a.p, 0) - coalesce(b.p, 0), 2))), 8) as l2
 from k left join q a on a.lang = l and a.x = k.x left join q b on b.lang = r and b.x = k.x group by l, r""",
    "overlap_with_heldout": f"""with d as (select doc_id, unnest({_grams('w', 3)}) as x from (select doc_id, {_W} as w from documents)),
 h as (select distinct unnest({_grams('w', 3)}) as x from (select {_W} as w from heldout_items))
 select doc_id, round(avg(case when h.x is null then 0.0 else 1.0 end), 9) as overlap from d left join h using (x) group by doc_id""",
    "duplicate_output_rate": """select source, sum(c)::bigint as texts, round((sum(c) - count(*))::double / sum(c), 9) as duplicate_rate
 from (select source, text, count(*) as c from documents where text is not null group by all) group by source""",
    "self_bleu_items": f"""with s as (select lang, item_id as id, {_W} as w from heldout_items),
 g as (select lang, id, 1 as n, unnest({_grams('w', 1)}) as x from s {' '.join(f"union all select lang, id, {n}, unnest({_grams('w', n)}) from s" for n in (2, 3, 4))}),
 c as (select lang, id, n, x, count(*) as c from g group by all),
 m as (select a.lang, a.id, a.n, a.x, a.c, coalesce(max(b.c), 0) as most from c a left join c b on a.lang = b.lang and a.n = b.n and a.x = b.x and a.id <> b.id group by all),
 h as (select lang, id, n, sum(least(c, most)) as hits, sum(c) as total from m group by all),
 o as (select lang, id, len(w) as len, n from s, (select unnest([1, 2, 3, 4]) as n)),
 p as (select o.lang, o.id, o.len, avg(ln((coalesce(hits, 0) + 1.0) / (coalesce(total, 0) + 1.0))) as lp from o left join h using (lang, id, n) group by all),
 e as (select p.lang, p.id, p.len, lp, (select len(w) from s r where r.lang = p.lang and r.id <> p.id order by abs(len(w) - p.len), len(w) limit 1) as near from p)
 select lang, count(*) as samples, case when count(*) >= 2 then round(avg(exp(least(0.0, 1 - near::double / len)) * exp(lp)), 8) end as self_bleu from e group by lang""",
    "cross_jaccard_items": f"""with s as (select suite, lang, item_id, list_distinct({_grams('w', 3)}) as g from (select suite, lang, item_id, {_W} as w from heldout_items)),
 t as (select * from s where len(g) > 0)
 select a.suite, a.lang, round(avg(len(list_intersect(a.g, b.g))::double / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))), 9) as jaccard
 from t a join t b on a.suite = b.suite and a.lang = b.lang and a.item_id < b.item_id group by a.suite, a.lang""",
    "content_fingerprint": "select doc_id, sha256(to_json(text)::varchar) as fingerprint from documents",
    "exact_dup_first": """select doc_id, first as duplicate_of from (select doc_id, min(doc_id) over (partition by text) as first from documents where text is not null) where doc_id > first""",
    "sample_power_source": """with g as (select source, kind, lang, count(*)::integer as samples from documents group by all),
 f(metric, floor, enough) as (values ('D1', 2, 25), ('D2', 20, 50), ('D4', 8, 25), ('D6', 8, 25))
 select source, kind, lang, samples, metric, case when samples < floor then 'insufficient_samples' else 'ok' end as status,
  case when samples < floor then null when samples >= enough then 'ok' else 'low' end as power from g, f""",
    "clean_web_lines": rf"""with l as (select * from {_LINES} where not (p = '' or len(p) - len(replace(p, '|', '')) >= 2
   or (regexp_matches(p, '(?i){T.WEB_RESIDUE}') and len(list_filter(regexp_split_to_array(p, '{_BLANK}+'), lambda y: y <> '')) < 12)
   or regexp_full_match(p, '[^\p{{L}}]+'))),
 j as (select doc_id, string_agg(p, chr(10) order by pos) as t from l group by doc_id)
 select d.doc_id, case when len(list_filter(regexp_split_to_array(j.t, '{_BLANK}+'), lambda y: y <> '')) >= 40 then sha256(j.t) end as cleaned from documents d left join j using (doc_id)""",
    "wrapper_strip": f"""select doc_id, case when doc_id % 2 = 0 then len({_strip('text')}) end as length from documents""",
    "fenced_items": """select item_id, greatest(3, item_id % 7 + 1)::integer as fence, lang as author from heldout_items""",
    "opening_prose": rf"""with k as (select doc_id, row_number() over (partition by doc_id order by pos) as n, p from {_LINES} where p <> ''
   and not regexp_matches(p, '(?i)^produced by\b')
   and not (len(regexp_replace(p, '[^\p{{L}}]', '', 'g')) > 0 and len(regexp_replace(p, '[^\p{{Lu}}]', '', 'g')) > 0.8 * len(regexp_replace(p, '[^\p{{L}}]', '', 'g')) and len(p) < 120)
   and not (regexp_matches(p, '(?i)^(chapter|book|part|letter)\b') and len(p) < 40) and not (len(p) < 80 and len(p) - len(replace(p, ' ', '')) < 8)),
 s as (select *, coalesce(sum(len(p)) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as s from k),
 j as (select doc_id, string_agg(p, chr(10) || chr(10) order by n) as b from s where s < 800 group by doc_id)
 select distinct d.doc_id, sha256(case when len(b) > 2200 then {_strip("regexp_replace(substr(b, 1, 2200), ' [^ ]*$', '')")} else b end) as opening from documents d left join j using (doc_id)""",
    "eligible_first3": rf"""with w as (select doc_id, row_number() over (partition by doc_id order by pos) - 1 as pos, len(list_filter(regexp_split_to_array(p, '{_BLANK}+'), lambda y: y <> '')) as words from {_LINES} where p <> ''),
 k as (select *, row_number() over (partition by doc_id order by pos) as k from w where words between 100 and 300)
 select doc_id, cast(pos as integer) as pos, words, k from k where k <= 3""",
    "alias_answers": r"""select item_id, regexp_replace(trim(regexp_replace(replace(lower(title || '  .'), 'ß', 'ss'), '\s+', ' ', 'g')), '^[.!?]+|[.!?]+$', '', 'g') as alias,
 regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from heldout_items""",
    "seed_values": """select item_id, ('0x' || substr(sha256(item_id::varchar), 1, 16))::ubigint::decimal(20, 0) as seed, sha256('item' || chr(0) || title) as domain_hash from heldout_items""",
    "path_rules": r"""with f as (select distinct id, unnest(map_keys(expected_files)) as path from sft_mask_probes)
 select id, path, len(path) > 0 and len(list_filter(string_split(path, '/'), lambda x: x in ('', '.', '..'))) = 0 and not contains(path, chr(92)) and not contains(path, chr(0)) as safe,
 path like 'kb/%.md' or path like 'drafts/_%' as allowed from f""",
}
