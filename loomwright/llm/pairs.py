"""Broken prompt and response pairs, each with its defect.

A pair is a user message and the last assistant message without tool calls before the
next user message, or a brief and its output. In this order a reply is

* ``empty``: nothing, only blanks, or a placeholder;
* ``refusal``: a sentence outside quotation marks aligns with a refusal template (longest
  common subsequence of words), while the rest is courtesy or speaks of the request; other
  sentences may hold ``ASIDE`` words or a fifth of the reply, whatever its length;
* ``truncated``: cut as :mod:`loomwright.llm.cuts` finds it;
* ``copy``: the prompt stands in the reply. Shingle containment finds candidates; the
  longest common subsequence must then cover nearly all of the prompt, its instruction
  included, and leave little else in the reply. A prompt of under four words must be the
  whole reply. A passage handed back without the instruction that asked for it is no copy;
* ``other_language``: both languages are clear, they differ, and the prompt doesn't ask
  for the reply's language. Languages are told by function words; texts in letters of
  another script by their script.

Defined results: a user message without a reply makes no pair; a null prompt can only
have an empty, truncated or refused reply; null messages are passed over; a repeated
record counts once; a record without messages gives nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm import cuts
from loomwright.llm.textkit import words
from loomwright.session import staged

# Refusal templates, as word sequences; "_" stands for any words.
REFUSALS = """
i cannot write
i can't write
i can't help with
i cannot help with
i can't assist with
i cannot assist with
i can't do this
i cannot do this
can't do this sorry
i won't be able to
i am not able to produce
i'm not able to
i am unable to
i must decline
i must refuse
i have to decline
i have to pass on this
i don't have the ability to
i do not have the ability to
i will not draft that
i will not write this
i won't write this
i'd rather not write
i would rather not write
my guidelines do not allow me
goes against the policy
against my guidelines
it would not be appropriate for me to
your request was blocked
this service does not cover
this falls outside what i can do
i am only a text model
this assistant is limited to other topics
leaves requests _ unanswered
as a language model i
as an ai i cannot
i can't comply with
i cannot comply with
je ne suis pas en mesure
je dois refuser
je ne peux pas
je ne rédigerai pas
mes consignes m'interdisent
cette demande dépasse ce que je peux
es tut mir leid aber _ kann ich nicht
ich bin nicht in der lage
ich kann _ nicht schreiben
muss ich _ ablehnen
diese szene schreibe ich nicht
meine richtlinien erlauben keine
geht über das hinaus was ich leisten kann
dabei kann ich nicht helfen
no puedo ayudar
no me es posible
debo rechazar
mis normas no permiten
queda fuera de lo que puedo
no voy a redactar
no voy a escribir esa
off the table for me
not something i'm comfortable
not something i am comfortable
not something i can
i'm not comfortable
i am not comfortable
i don't feel comfortable
decline this request
decline your request
i refuse to
je refuse de
je ne suis pas à l'aise
je préfère ne pas
je ne peux pas vous aider
ich lehne _ ab
das kann ich nicht
ich möchte _ nicht schreiben
ich weigere mich
me niego a
prefiero no
no puedo cumplir
no puedo escribir
no estoy en condiciones
non posso aiutare
não posso ajudar
ik kan _ niet helpen
"""
# Further templates: a person, a denial, and a verb of the task.
DENIALS = "can't|cannot|can not|won't|will not|could not|couldn't|am not able to|am unable to|i'm unable to|i'm not able to|am not going to|i'm not going to|would rather not|i'd rather not|must decline to|have to refuse to"
TASKS = "help|assist|write|draft|produce|create|provide|generate|comply|fulfil|fulfill|complete this|continue with|answer this|engage|discuss this|share this|support this"
# Words of sentences that speak of the request.
ABOUT = frozenset(
    "request requests guidelines policy policies content topic assist help instead alternative alternatives rephrase apologize apologise apologies sorry understand appreciate "
    "demande consignes désolé désolée aider sujet anfrage richtlinien leider helfen thema solicitud normas siento ayudar tema".split()
)

# Courtesy around a refusal, as word sequences.
COURTESY = """
let me know if there is
i hope you find another way
i am happy to talk about
perhaps try another tool
thank you for
i read your note
regarding the
hello
hm
sorry
i'm sorry
unfortunately
"""

# Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the and of to in that was with for as his her it not had at on by is from be which while an who they were their into before after until whatever only under there how between yet no one nobody this so would could should",
    "fr": "le la les des du et une un qui dans pour sur avec au aux est pas ce cette était par son sa ses ne se plus puis depuis sans il elle que l d n qu tandis près chez rien ni personne avant après car pendant jamais on de",
    "de": "der die das und ein eine einen einem einer den dem des nicht mit von zu im auf für ist sich war als hatte wie aus bei nach ohne dann er sie am zum vor unter weder noch niemand während seit aber es hieß habe ich",
    "es": "el los las una un y que en por con del al no se su para lo como más sin era desde había luego muy porque cuando nadie ni si pues hacia hasta tras bajo junto mientras de nunca entendió decían",
}
# Languages asked about only where none of the above is clear.
FURTHER_WORDS = {
    "it": "che non di il della nel anche perché gli più questo sono è del alla dei ma quando lo con una per si le era come",
    "pt": "não uma os em com para é mais foi ao pela seu você também as do da dos na no que quando mas era como",
    "nl": "het een van niet dat zijn ook maar voor aan wordt hij de en ik op met was naar bij toen er zij",
}
# Scripts of letters by the first words of their Unicode names.
SCRIPTS = "CYRILLIC GREEK ARABIC HEBREW DEVANAGARI THAI HANGUL HIRAGANA KATAKANA CJK"
_TELLING = {
    word: [lang for lang, listed in FUNCTION_WORDS.items() if word in listed.split()]
    for listed in FUNCTION_WORDS.values()
    for word in listed.split()
}

_FURTHER = {
    word: [lang for lang, listed in FURTHER_WORDS.items() if word in listed.split()]
    for listed in FURTHER_WORDS.values()
    for word in listed.split()
}

# How a language is asked for.
LANGUAGE_NAMES = {
    "en": "english anglais englisch inglés",
    "fr": "french français französisch francés",
    "de": "german allemand deutsch alemán",
    "es": "spanish espagnol spanisch español castellano",
    "it": "italian italien italienisch italiano",
    "pt": "portuguese portugais portugiesisch portugués português",
    "nl": "dutch néerlandais niederländisch neerlandés holandés",
    "CYRILLIC": "russian russe russisch ruso ukrainian bulgarian serbian",
    "GREEK": "greek grec griechisch griego",
    "ARABIC": "arabic arabe arabisch árabe persian urdu",
    "HEBREW": "hebrew hébreu hebräisch hebreo",
    "DEVANAGARI": "hindi sanskrit marathi nepali",
    "THAI": "thai thaï tailandés",
    "HANGUL": "korean coréen koreanisch coreano",
    "CJK": "chinese chinois chinesisch chino mandarin japanese japonais japanisch japonés",
}
_ASKED = {name: lang for lang, listed in LANGUAGE_NAMES.items() for name in listed.split()}

ASIDE = 14
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“]*“|«[^»]*»")
_SENTENCE = re.compile(r"(?<=[.!?:;])\s+|\n+")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def _templates(listed: str) -> dict[str, list[tuple[list[str], frozenset[str], int]]]:
    """By first word: words without the blanks, the words as a set, and the room they may take."""
    out: dict[str, list] = {}
    for line in listed.strip().splitlines():
        told = line.split()
        wanted = [w for w in told if w != "_"]
        out.setdefault(wanted[0], []).append((wanted, frozenset(wanted), len(told) + (8 if "_" in told else 1)))
    return out


def _crossed() -> str:
    denials = [d if d.startswith("i'") else f"i {d}" for d in DENIALS.split("|")]
    return "\n".join(f"{d} {t}" for d in denials for t in TASKS.split("|"))


_TEMPLATES = _templates(REFUSALS + _crossed())
_POLITE = _templates(COURTESY)


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | (1 << i)
    row = (1 << len(a)) - 1
    full = row
    for word in b:  # bit-parallel: zeros of the row mark the subsequence
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def script(text: str) -> str | None:
    """The script of most letters if it is one of ``SCRIPTS``; kana count as CJK."""
    if text.isascii():
        return None
    counts: dict[str, int] = {}
    letters = 0
    for c in text:
        if c.isalpha():
            letters += 1
            if c > "\u036f":
                name = unicodedata.name(c, "").split(" ")[0].split("-")[0]
                if name in _SCRIPT_NAMES:
                    name = "CJK" if name in ("HIRAGANA", "KATAKANA") else name
                    counts[name] = counts.get(name, 0) + 1
    best = max(counts, key=counts.get, default=None)
    return best if best and 2 * counts[best] > letters else None


_SCRIPT_NAMES = frozenset(SCRIPTS.split())


def _counts(tokens: list[str], telling: dict[str, list[str]], langs: Iterable[str]) -> list[tuple[str, float]]:
    """Function words of each language, the most first; a word of several languages is shared out."""
    counts = dict.fromkeys(langs, 0.0)
    for t in tokens:
        of = telling.get(t)
        if of:
            for lang in of:
                counts[lang] += 1.0 / len(of)
    return sorted(counts.items(), key=lambda x: -x[1])


def language(tokens: list[str]) -> str | None:
    """The clear language of a text, by its function words; null if none is clear.

    A further language must also stand out from the likeliest of the first four.
    """
    ranked = _counts(tokens, _TELLING, FUNCTION_WORDS)
    (best, n), (_, second) = ranked[:2]
    if n >= 2 and n >= 1.6 * second and n >= 0.12 * len(tokens):
        return best
    (other, m), (_, next_best) = _counts(tokens, _FURTHER, FURTHER_WORDS)[:2]
    clear = m >= 2 and m >= 1.6 * max(next_best, n) and m >= 0.12 * len(tokens)
    return other if clear else None


def asked_languages(prompt: str) -> set[str]:
    return {_ASKED[w] for w in words(prompt) if w in _ASKED}


def _aligned(templates: dict[str, list[tuple[list[str], frozenset[str], int]]], sentence: list[str]) -> bool:
    """The words of some template stand in the sentence in order and close together."""
    held = set(sentence)
    for i, word in enumerate(sentence):
        for wanted, needed, room in templates.get(word, ()):
            if needed <= held and common_length(wanted, sentence[i : i + room]) == len(wanted):
                return True
    return False


def is_refusal(reply: str) -> bool:
    plain = reply.replace("’", "'")
    sentences = [_TOKEN.findall(x) for x in _SENTENCE.split(_QUOTED.sub(" ", plain.lower()))]
    room = max(ASIDE, 0.2 * sum(map(len, sentences)))
    refused, other = False, 0
    for tokens in sentences:
        if _aligned(_TEMPLATES, tokens):
            refused = True
        elif ABOUT.isdisjoint(tokens) and not _aligned(_POLITE, tokens):
            other += len(tokens)
            if other > room:
                return False
    return refused


def _head(prompt: str) -> list[str]:
    """The words of the instruction: up to a colon, else the first sentence."""
    colon = prompt.find(":")
    if 0 < colon <= 300:
        return words(prompt[:colon])[:40]
    stop = re.search(r"[.!?;](?:\s|$)", prompt[12:])
    return words(prompt[: 12 + stop.start()] if stop else prompt)[:40]


def is_copy(prompt: str, reply: str, asked: list[str], given: list[str]) -> bool:
    if len(asked) < 4:
        return len(asked) > 1 and asked == given
    if len(given) < 3:
        return False
    different = set(asked)
    if len(different.intersection(given)) < 0.6 * len(different):
        return False
    shingles = {tuple(asked[i : i + 3]) for i in range(len(asked) - 2)}
    held = {tuple(given[i : i + 3]) for i in range(len(given) - 2)}
    if len(shingles & held) < 0.55 * len(shingles):
        return False
    common = common_length(asked, given)
    if common < 0.85 * len(asked) or len(given) - common > max(14, 0.15 * len(given)):
        return False
    head = _head(prompt)
    return not head or common_length(head, given) >= 0.75 * len(head)


def reply_defect(prompt: str | None, reply: str | None) -> str | None:
    """The defect of a reply but for truncation."""
    if cuts.is_blank(reply):
        return "empty"
    if is_refusal(reply):
        return "refusal"
    if prompt is None or not prompt.strip():
        return None
    asked, given = words(prompt), words(reply)
    if is_copy(prompt, reply, asked, given):
        return "copy"
    of_reply = script(reply) or language(given)
    if of_reply is None:
        return None
    of_prompt = script(prompt) or language(asked)
    if of_prompt is None or of_prompt == of_reply or of_reply in asked_languages(prompt):
        return None
    return "other_language"


UNIT_SCHEMA = "record_id string, msg_pos int, source string, kind string, length int, ending int, reply boolean, defect string"


def judged_units(probes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every message and output with its ending; replies also with their own defect."""
    turns = probes.select(
        F.col("id").alias("record_id"),
        F.col("provenance.source").alias("source"),
        F.expr(
            "transform(messages, m -> struct(m.role as role, m.content as content, "
            "coalesce(size(m.tool_calls) > 0, false) as calls))"
        ).alias("turns"),
    )
    briefs = reviews.select(
        F.col("review_id").alias("record_id"),
        "source",
        F.expr(
            "array(struct('brief' as role, packet.brief as content, false as calls), "
            "struct('output' as role, packet.output as content, false as calls))"
        ).alias("turns"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for rid, source, turns in zip(*(c.to_pylist() for c in batch.columns)):
                rows.extend(_judge(rid, source, turns))
            if rows:
                kinds = (
                    pa.string(),
                    pa.int32(),
                    pa.string(),
                    pa.string(),
                    pa.int32(),
                    pa.int32(),
                    pa.bool_(),
                    pa.string(),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)],
                    names=["record_id", "msg_pos", "source", "kind", "length", "ending", "reply", "defect"],
                )

    both = turns.unionByName(briefs).where("turns is not null and record_id is not null")
    return both.mapInArrow(run, UNIT_SCHEMA)


def _judge(rid: str, source: str | None, turns: list) -> list[tuple]:
    rows: list[tuple] = []
    replies: dict[int, str | None] = {}
    prompt, last = None, -1

    def close() -> None:
        if prompt is not None and last >= 0:
            replies[last] = reply_defect(turns[prompt]["content"], turns[last]["content"])

    for i, turn in enumerate(turns):
        if turn is None:
            continue
        if turn["role"] in ("user", "brief"):
            close()
            prompt, last = i, -1
        elif turn["role"] == "output" or turn["role"] == "assistant" and not turn["calls"]:
            last = i
    close()
    review = any(t is not None and t["role"] == "output" for t in turns)
    for i, turn in enumerate(turns):
        if turn is None or turn["role"] == "brief":
            continue
        text = turn["content"]
        rows.append(
            (rid, 0 if review else i, source, turn["role"], len(text or ""), cuts.ending(text), i in replies, replies.get(i))
        )
    return rows


def defective_pairs(probes: DataFrame, reviews: DataFrame) -> DataFrame:
    """``(record_id, msg_pos, defect)``, one row for each defective pair."""
    units = staged(judged_units(probes, reviews), "pairs")
    marked = cuts.cut_units(units, cuts.length_limits(units))
    defect = (
        F.when(F.col("defect") == "empty", F.col("defect"))
        .when(F.col("defect") == "refusal", F.col("defect"))
        .when(F.col("cut"), F.lit("truncated"))
        .otherwise(F.col("defect"))
    )
    return (
        marked.where("reply")
        .select("record_id", "msg_pos", defect.alias("defect"))
        .where("defect is not null")
        .distinct()
    )


def defect_rates(probes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Defective pairs per defect."""
    return defective_pairs(probes, reviews).groupBy("defect").agg(F.count("*").alias("pairs"))
