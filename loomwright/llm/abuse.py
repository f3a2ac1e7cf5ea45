"""Abusive, hateful or sexual language, read through disguises.

Disguised words (digits and signs for letters, asterisks, repeated letters, letters set
apart, invisible characters) pass a noisy-channel decoder: the characters of a word become
a lattice of the letters they may stand for, each with a channel cost, and a Viterbi search
finds the likeliest reading under a character language model. The search is exact: it runs
over the lattice and the tree of the known words at once and keeps the cheapest path to
every node of the tree. Known are the common words of the corpus and the lexicon below,
which has no precedence. The model counts character n-grams (``ORDER``) over all words of
the corpus and over the lexicon; its size is bounded by the alphabet.

The restored text is scored sentence by sentence by a logistic model whose features are
cues, words and pairs of neighbouring words. A cue is a set of words that must stand
together in a sentence, some of them from word classes (insults, slurs against a people,
sexual acts, threats). Words that are insults only when aimed at somebody (pig, trash) need
a person right before them. Every cue starts with the prior weight ``CUE``, every word with
none; :func:`fit` moves them by the labels of at most ``FIT`` labelled documents, allowing
for wrong labels. A document's score is the highest probability of its sentences; it is
listed from ``THRESHOLD``.

Defined results: null, empty and blank texts score 0; repeated documents count once; a
document of several languages is scored in each of them; without labels the prior weights
stand; a document that reviewers disagree on evenly counts as toxic.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.textkit import kept
from loomwright.session import staged

ORDER, THRESHOLD = 4, 0.5
LISTED = 4.0
"""Weight of a word of the lexicon in the character model."""
FIT = 4000
"""The most labelled documents that the scores are fitted on."""
CUE, BIAS = 8.0, -4.0
CUE_SPREAD, WORD_SPREAD = 1.5, 0.3
"""Prior weights of a cue and of none, and how far the labels may move a cue and a word."""
WRONG_TOXIC, WRONG_CLEAN = 0.05, 0.05
"""Assumed shares of toxic labels on clean documents and of the other way round."""
LEADS, SUPPORT = 0.3, 4
"""Weight from which a learned word makes a sentence worth scoring; documents it must stand in."""
COMMON_SHARE = 0.0005
ALPHABET = "abcdefghijklmnopqrstuvwxyzàâäáçéèêëíîïñóôöúùûüßœæ"

# Word classes; fixed values.
INSULTS = {
    "en": "idiot idiots moron morons imbecile imbeciles cretin halfwit dimwit bastard bastards bitch bitches cunt cunts dickhead dickheads dumbass dumbasses asshole assholes arsehole wanker wankers whore whores slut sluts shithead shitheads twat twats scumbag scumbags retard",
    "fr": "connard connards connasse salope salopes salaud salauds enculé pute putes abruti crétin imbécile",
    "de": "hurensohn hurensöhne arschloch arschlöcher wichser wichsers fotze vollidiot idiot missgeburt drecksau dreckskerl",
    "es": "gilipollas cabrón cabrones puta putas imbécil idiota hijoputa desgraciado maricón",
}
# Insults only when aimed at somebody.
AIMED = {
    "en": "dick dicks prick pricks scum pig pigs maggot maggots filth loser losers fool failure cow trash garbage",
    "fr": "ordure ordures débile merde pourriture raclure porc con conne",
    "de": "schlampe schwein abschaum",
    "es": "zorra capullo mierda escoria basura",
}
SLURS = {
    "en": "nigger niggers kike kikes faggot faggots tranny trannies wetback wetbacks raghead ragheads paki pakis gook gooks",
    "fr": "bougnoule bougnoules youpin youpins tarlouze tarlouzes",
    "de": "kanake kanaken schwuchtel schwuchteln judensau",
    "es": "sudaca sudacas negrata negratas",
}
# What may stand between a person and an insult aimed at it.
BETWEEN = "are re r is a an the such so just but little fat old absolute complete utter total damn lazy lying miserable sind bist ist ein eine elender elende petit petite gros grosse pauvre espèce de d es êtes un une eres una tan maldito maldita pedazo"
SCORN = {
    "en": "worthless pathetic useless disgusting filthy ugly stupid dumb dumbest shitty goddamn stinking bloody fucking",
    "fr": "sale sales minable pathétique inutile dégoûtant",
    "de": "dreckiger dreckige dreckiges erbärmlicher wertloser dumme dummer",
    "es": "asqueroso asquerosa inútil patético sucio sucia",
}
VERMIN = {
    "en": "animals vermin subhumans subhuman savages parasites cockroaches lice rats maggots filth scum thieves liars pests beasts",
    "fr": "parasites vermine bêtes animaux cafards rats sous-hommes voleurs",
    "de": "ungeziefer untermenschen parasiten tiere ratten kakerlaken abschaum",
    "es": "parásitos infrahumanos animales ratas cucarachas alimañas bestias escoria",
}
SEXUAL = {
    "en": "fucked fuck fucking cock dick nipples thighs climaxed naked cunt pussy tits underwear moaned groaning breasts fingers thrust pounding",
    "fr": "baisait baiser suçait nue queue chatte gémissait bite",
    "de": "fickte ficken stöhnte nackt schwanz titten",
    "es": "follaba follar gemía desnuda polla coño tetas",
}
PERSON = {
    "en": "you your yours yourself you're u ur",
    "fr": "tu te toi ton ta tes vous espèce va",
    "de": "du dich dir dein deine euch ihr",
    "es": "tú te ti tu tus vete cállate eres usted",
}

# Cues: category, weight, and terms that must all stand in one sentence. "A|B" is either
# word, "@insult", "@slur", "@scorn", "@vermin", "@sexual" and
# "@person" a word of that class, "@aimed" one of AIMED right after a person.
CUES = """
insult 1 @person @insult
insult 1 @aimed
hate 1 @slur
hate 1 those|all|every|the @slur|@vermin must|should|deserve die|hang|burn|rot|go
insult 1 @person worthless|pathetic|useless|disgusting waste|failure|read|life|nothing|creature|excuse
insult 1 you are|re nothing
insult 1 you are dumbest|stupidest|ugliest|worst|disgusting @insult|read|met
insult 1 you waste of breath|space|oxygen|skin
insult 1 laughs|laugh at you behind
insult 1 even despises|hates|loathes you
insult 1 mother should drowned|aborted|strangled you
insult 1 nobody would cry if you choked|died
insult 1 drop dead you|favour|favor
insult 1 kill|hang|drown|shoot yourself
insult 1 go to hell take|you|and your
insult 1 go and|to rot|die listen|you|hell
insult 1 shut your mouth|trap|face|hole
insult 1 piece of shit
insult 1 you people dumb|stupid read|holes
insult 1 crawl back holes|hole
insult 1 is fat stinking|ugly|lazy|disgusting cow|pig|whore|slut
insult 1 her|his as ugly as she|he is
insult 1 @scorn @insult like|as you
insult 1 @scorn @insult should never
insult 1 what kind of @insult
insult 1 you @scorn @insult|creature|thing|little
insult 1 sale connard|salope|ordure|pute|con|conne|porc
insult 1 va|allez crever|chier|mourir
insult 1 personne ne t'aime|t
insult 1 ferme|fermez ta|ta|gueule gueule
insult 1 espèce de|d @insult
insult 1 tu ne vaux|vaux rien
insult 1 verreck|verrecke du|doch|@insult
insult 1 halt die fresse|schnauze|klappe
insult 1 du bist nichts|dreck|abschaum
insult 1 du dreckiger|dreckige|elender|@scorn @insult
insult 1 cállate la boca @insult|vales|idiota
insult 1 no vales nada|mierda
insult 1 vete a la mierda
insult 1 ojalá te mueras|pudras
insult 1 hijo de puta
threat 1 i will|ll cut|slit|slash your throat
threat 1 i|we will|ll find where you|your live|sleep|house
threat 1 smash|break|kick|bash your face|teeth|skull|head i|will|again
threat 1 i|we will|ll kill|murder|stab|strangle|burn|shoot you
threat 1 i know where|which you sleep|live
threat 1 come near again and i will|ll
threat 1 pray that i don|t|never bring|come
threat 1 je te casse|casserai|crève|tue|tuerai|dents|gueule|égorge si|vais|te|les
threat 1 si je te croise|trouve|revois casse|crève|tue
threat 1 wenn|falls ich dich erwische|finde|sehe schlage|bringe|breche|mache
threat 1 schlage ich dir zähne|fresse|schädel
threat 1 si te encuentro|pillo|veo rompo|mato|parto
threat 1 te rompo|voy los|la|matar|a dientes|cara|matar
hate 1 breed like|as @vermin|flies|rabbits
hate 1 throw|drown every|all last|of one|them into|in sea|river
hate 1 should|ought have|be gassed|exterminated|wiped|lynched
hate 1 hang|kill|burn|shoot their children|women too
hate 1 @vermin before those|they|the|these take|overrun|swarm|ruin @vermin|hang
hate 1 are savages|vermin|subhumans|animals|parasites|cockroaches|lice|rats|pigs|filth|maggots all|every|them|they|town|should|throw|burn|out
hate 1 this town|city|country should burn|drive|throw|hunt them
hate 1 born thieves|liars|criminals|cheats|beggars
hate 1 never trust one of|from they|are|all
hate 1 do|does not|n't deserve to breathe|live|exist same|air|decent|among
hate 1 only good for breeding|scrubbing
hate 1 brains|minds of savages|animals|apes
hate 1 morals of worse|animals|savages
hate 1 spit first|on ask|them|see
hate 1 beat|chase|whip them until they leave
hate 1 if you see one of spit|kick|hit|beat|shoot
hate 1 sont des parasites|vermines|animaux|rats|cafards|sous|bêtes|voleurs qu|tous|jette|devrait|mer
hate 1 on devrait|faudrait chasser|pendre|brûler|noyer|gazer coups|tous|les|sous
hate 1 ce|sont des sous hommes
hate 1 sind ungeziefer|untermenschen|parasiten|tiere|abschaum man|sollte|alle|sie
hate 1 man sollte alle|sie ersäufen|vergasen|verbrennen|erschlagen|vertreiben|aufhängen
hate 1 prügelt|jagt|schlagt|werft aus|hinaus|raus stadt|untermenschen|land|sie
hate 1 son parásitos|infrahumanos|animales|ratas|escoria|alimañas habría|todos|que|mar|son
hate 1 habría|hay que echar|tirar|ahogar|quemar|gasear palos|mar|todos|los
sexual 1 she|he|they|her|him|his fucked|fuck|fucking|fucks against|until|hard|senseless|her|him sweating|groaning|climaxed|came|wall|moaned|hard|her|him|senseless
sexual 1 @person nudes|touch yourself|nudes|naked
sexual 1 send me nudes
sexual 1 hard cock|dick inside|her|mouth|him
sexual 1 her|his knees cock|dick mouth
sexual 1 licked|sucked|kissed bare|her|his breasts|nipples|cock|dick|pussy|thighs
sexual 1 fingers deep|slid|inside between|her legs|thighs|pussy
sexual 1 spread her|his thighs|legs rode|came|naked|him|her
sexual 1 rode him|her until came|climaxed|both
sexual 1 nipples stiffened|hardened|hard
sexual 1 thrust|thrusting into her|him behind|moaned|until|hard
sexual 1 pounding|pounded into her|him
sexual 1 swallowed every drop
sexual 1 pulled|tore off underwear|panties|knickers
sexual 1 face|mouth|tongue between|into her|his thighs|legs
sexual 1 hand|fingers up|under her|his skirt rubbed|gasped|came|wet
sexual 1 rubbed her|him until came|she|he
sexual 1 bend|bent|screw|screwed that|her|him|over senseless|screw|hard
sexual 1 take it all @insult
sexual 1 gémissait|gémit nue|nu baisait|contre|pendant
sexual 1 la|le|se baisait|suçait|baisaient contre|mur|nue|queue|bite
sexual 1 stöhnte|stöhnten nackt fickte|fickten|während|wand
sexual 1 fickte|fickten|gefickt sie|ihn gegen|wand|hart|nackt|stöhnte
sexual 1 gemía|gemían desnuda|desnudo follaba|mientras|contra
sexual 1 la|lo|se follaba|follaban contra|pared|desnuda
"""

_LEET = {
    "1": "il", "3": "e", "0": "o", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "€": "e", "+": "t", "(": "c", "£": "l",
}
_HIDDEN = re.compile("[­​‌‍⁠﻿]")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”»“']*\s+|[\r\n]+")
_EDGE = ".,;:?\"'`´’‘“”„«»‹›()[]{}…-–—_<>/\\~#=&%^"
_PARTS = re.compile(r"[^\W\d_]+")
_STRANGE = re.compile(r"[^\W\d_][*@$!|€+(0-9]|[*@$!|€+0-9][^\W\d_]|([^\W\d_])\1\1", re.I)
_CLASSES = {"insult": INSULTS, "aimed": AIMED, "slur": SLURS, "scorn": SCORN, "vermin": VERMIN, "sexual": SEXUAL, "person": PERSON}


def _class(name: str) -> frozenset[str]:
    return frozenset(w for listed in _CLASSES[name].values() for w in listed.split())


def _read_cues() -> list[tuple[str, float, list[frozenset[str]]]]:
    out = []
    for line in CUES.strip().splitlines():
        category, weight, *terms = line.split()
        sets = []
        for term in terms:
            one: set[str] = set()
            for word in term.split("|"):
                if word == "@insult" and len(terms) > 2:
                    one |= _class("aimed")  # the other words aim it
                one |= _class(word[1:]) if word.startswith("@") else set(_PARTS.findall(word))
            sets.append(frozenset(one))
        out.append((category, float(weight), sets))
    return out


_CUES = _read_cues()
TERMS = frozenset(w for name in ("insult", "aimed", "slur", "scorn", "vermin", "sexual") for w in _class(name) if len(w) > 2)
LEXICON = TERMS | frozenset(w for _, _, sets in _CUES for s in sets for w in s if len(w) > 3)
_LEAD = [min(sets, key=len) for _, _, sets in _CUES]
_AIMED = _class("aimed")
_FILLERS = _class("scorn") | frozenset(BETWEEN.split())


def is_aimed(told: list[str]) -> bool:
    """A word of ``AIMED`` follows a person, or stands before "like you"."""
    person = _class_of_person
    for i, word in enumerate(told):
        if word in _AIMED:
            back = i - 1
            while back >= 0 and i - back <= 5 and told[back] in _FILLERS and told[back] not in person:
                back -= 1
            if back >= 0 and told[back] in person or told[i + 1 : i + 3] in (["like", "you"], ["as", "you"]):
                return True
    return False


_class_of_person = _class("person")


class CharModel:
    """Character n-grams with interpolated back-off to shorter contexts."""

    def __init__(self, grams: dict[str, float]) -> None:
        self.grams = grams
        self.kept: dict[tuple[str, str], float] = {}

    def cost(self, context: str, letter: str) -> float:
        """Negative log probability of a letter after at most ``ORDER - 1`` characters."""
        key = (context, letter)
        if key not in self.kept:
            p = 1.0 / (len(ALPHABET) + 2)
            for n in range(len(context) + 1):
                before = context[len(context) - n :]
                total = self.grams.get(before + "\t", 0.0)
                if total:
                    share = total / (total + 5.0)
                    p = (1 - share) * p + share * self.grams.get(before + letter, 0.0) / total
            self.kept[key] = -math.log(p)
        return self.kept[key]


def word_grams(word: str, weight: float) -> Iterator[tuple[str, float]]:
    """The n-grams of a word between ``^`` and ``$``, and the totals of their contexts."""
    told = "^" * (ORDER - 1) + word + "$"
    for i in range(ORDER - 1, len(told)):
        for n in range(ORDER):
            before = told[i - n : i]
            yield before + told[i], weight
            yield before + "\t", weight


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place the letters a reading may have there, with their channel costs."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        run = i
        while run < len(token) and token[run] == c:
            run += 1
        length = run - i
        if c == "*":
            edge = i == 0 or run == len(token)
            out.append([("", 2.0)] * edge + [(a, 1.5) for a in ALPHABET])
        elif c in _LEET and not c.isalpha():
            for _ in range(min(length, 2)):
                out.append([(a, 0.5) for a in _LEET[c]])
        elif c.isalpha():
            if length >= 3:
                out.append([(c, 0.3), (c + c, 0.3)])
            else:
                out.extend([[(c, 0.0)]] * length)
        i = run
    return out


class Known:
    """The known words and their beginnings, the nodes of the tree that a reading walks."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = frozenset(words)
        self.nodes = frozenset(w[:n] for w in self.words for n in range(len(w) + 1))

    def __contains__(self, word: str) -> bool:
        return word in self.words


def decode(token: str, model: CharModel, known: Known) -> str | None:
    """The likeliest known reading of a disguised word, or null if no known word fits."""
    best: dict[str, float] = {"": 0.0}
    for options in lattice(token):
        grown: dict[str, float] = {}
        for text, cost in best.items():
            for letters, extra in options:
                now, total = text, cost + extra
                for a in letters:
                    total += model.cost(("^" * (ORDER - 1) + now)[-(ORDER - 1) :], a)
                    now += a
                if now in known.nodes and total < grown.get(now, math.inf):
                    grown[now] = total
        best = grown
    ended = [
        (cost + model.cost(("^" * (ORDER - 1) + t)[-(ORDER - 1) :], "$"), t)
        for t, cost in best.items()
        if t and t in known
    ]
    return min(ended)[1] if ended else None


class Weights:
    """Bias and weights of the features; cues that are not listed have their prior weight."""

    def __init__(self, bias: float = BIAS, learned: dict[str, float] | None = None) -> None:
        self.bias, self.learned = bias, learned or {}
        self.cues = [CUE * weight + self.learned.get(f"cue {n}", 0.0) for n, (_, weight, _) in enumerate(_CUES)]
        self.leads = _LEAD_WORDS | {f for f, w in self.learned.items() if " " not in f and w >= LEADS}


class Reader:
    """Restores and scores texts; readings of tokens are kept for later texts."""

    def __init__(self, model: CharModel, known: Known, weights: Weights | None = None) -> None:
        self.model, self.known, self.weights = model, known, weights or Weights()
        self.kept: dict[str, tuple[tuple[str, ...], bool]] = {}

    def read(self, token: str) -> tuple[tuple[str, ...], bool]:
        """The words of a raw token, and whether one of them makes a sentence worth scoring."""
        got = self.kept.get(token)
        if got is None:
            if len(self.kept) > 400_000:
                self.kept.clear()
            got = self.kept[token] = self._read(token)
        return got

    def _read(self, token: str) -> tuple[tuple[str, ...], bool]:
        bare = _HIDDEN.sub("", token).lower()
        core = bare.strip(_EDGE)
        if "!" in core[-1:]:
            core = core.rstrip("!")
        words: tuple[str, ...] = tuple(_PARTS.findall(core))
        if core not in self.known and len(core) > 2 and _STRANGE.search(core):
            if core.strip("*").isalpha() and core.count("*") in (2, 4) and core[0] == core[-1] == "*":
                words = (core.strip("*"),)  # emphasis
            else:
                found = decode(core, self.model, self.known)
                if found is not None:
                    words = (found,)
        return words, any(w in self.weights.leads for w in words)

    def words(self, sentence: str) -> list[str]:
        """The restored words of a sentence; letters set apart are joined."""
        out: list[str] = []
        single: list[str] = []

        def join() -> None:
            whole = "".join(single)
            if len(single) >= 4 or len(single) == 3 and whole in TERMS:
                found = decode(whole, self.model, self.known) if not whole.isalpha() else whole
                out.append(found or whole)
            else:
                out.extend(x for x in single if x.isalpha())
            single.clear()

        for token in sentence.split():
            core = _HIDDEN.sub("", token).strip(_EDGE).lower()
            if len(core) == 1 and (core.isalpha() or core in _LEET or core == "*"):
                single.append(core)
                if token[-1:] in ".,;:!?":
                    join()
                continue
            if single:
                join()
            pieces = re.split(r"[.\-_·•]", core) if len(core) >= 7 and re.fullmatch(r"(?:\w[.\-_·•]){3,}\w", core) else None
            if pieces:
                out.append("".join(pieces))
            else:
                out.extend(self.read(token)[0])
        if single:
            join()
        return out

    def sentences(self, text: str) -> Iterator[list[str]]:
        """The restored words of each sentence."""
        if "&" in text:
            text = html.unescape(text)
        for sentence in _SENTENCE.split(text):
            yield self.words(sentence)

    def judge(self, text: str) -> tuple[dict[str, float], float]:
        """Probabilities by category of the sentences that reach ``THRESHOLD``, and the highest of all."""
        if "&" in text:
            text = html.unescape(text)
        lead, apart = False, 0
        for token in set(text.split()):
            if self.read(token)[1]:
                lead = True
                break
            apart += len(token) == 1 and token.isalpha()
        out: dict[str, float] = {}
        most = 0.0
        if _NO_ENTRY.search(text):
            most = out["hate"] = 1.0 / (1.0 + math.exp(-self.weights.bias - CUE))
        if not lead and apart < 3:
            return out, most
        weights = self.weights
        for sentence in _SENTENCE.split(text):
            told = self.words(sentence)
            held = set(told)
            if held.isdisjoint(weights.leads):
                continue
            cues = matched_cues(told, held)
            z = weights.bias + sum(weights.cues[n] for n in cues)
            if weights.learned:
                z += sum(weights.learned.get(f, 0.0) for f in word_features(told, held))
            p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))
            most = max(most, p)
            if p >= THRESHOLD:
                for name in {_CUES[n][0] for n in cues} or {"other"}:
                    out[name] = max(out.get(name, 0.0), p)
        return out, most

    def score(self, text: str) -> dict[str, float]:
        """Probabilities by category of the sentences that reach ``THRESHOLD``."""
        return self.judge(text)[0]


def matched_cues(told: list[str], held: set[str]) -> list[int]:
    """The cues that a sentence fulfils."""
    out = []
    for n, first in enumerate(_LEAD):
        if held.isdisjoint(first) or any(held.isdisjoint(s) for s in _CUES[n][2]):
            continue
        if n != _AIMED_CUE or is_aimed(told):
            out.append(n)
    return out


def word_features(told: list[str], held: set[str]) -> set[str]:
    """The words of a sentence and the pairs of neighbours."""
    return held.union(f"{a} {b}" for a, b in zip(told, told[1:]))


_AIMED_CUE = next(n for n, (_, _, sets) in enumerate(_CUES) if sets == [_AIMED])
_LEAD_WORDS = frozenset(w for s in _LEAD for w in s)
# a people shut out: "No <name> in our <place>"
_NO_ENTRY = re.compile(r"\b(?:No|NO) [A-Z][\w'’]+(?: people)? (?:in|IN) (?:our|OUR) \w[\w-]*[!.]")


def language_model(documents: DataFrame) -> tuple[dict[str, float], list[str]]:
    """Character n-grams over the words of all texts and the lexicon, and common words.

    The n-grams are summed in the cluster; their number is bounded by the alphabet. Common
    words stand in more than ``COMMON_SHARE`` of all texts, which bounds their number.
    """
    words = documents.where("text is not null").select(
        F.explode(F.array_union(F.split(F.lower("text"), r"[^\p{L}]+"), F.array(F.lit("")))).alias("word")
    )
    counts = staged(words.groupBy("word").agg(F.count("*").alias("n")), "abuse-words")
    total = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0
    common = counts.where((F.col("n") > COMMON_SHARE * total) & (F.length("word") > 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, float] = {}
        letters = set(ALPHABET)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word and letters.issuperset(word) and len(word) <= 30:
                    for gram, w in word_grams(word, math.log1p(n)):
                        grams[gram] = grams.get(gram, 0.0) + w
        if grams:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(grams)), pa.array(list(grams.values()), pa.float64())], names=["gram", "n"]
            )

    summed = counts.select("word", "n").mapInArrow(count, "gram string, n double").groupBy("gram").agg(F.sum("n").alias("n"))
    grams = {row[0]: row[1] for row in summed.where("n > 1").collect()}
    for word in LEXICON:
        for gram, w in word_grams(word, LISTED):
            grams[gram] = grams.get(gram, 0.0) + w
    return grams, [row[0] for row in common.select("word").collect()]


CATEGORIES = ("insult", "threat", "hate", "sexual", "other")


def fit(reader: Reader, texts: list[str], toxic: list[bool], rounds: int = 400) -> Weights:
    """Weights at the mode of their posterior, by gradient steps.

    The prior of a cue is normal around ``CUE``, that of a word around 0; words and pairs
    must stand in ``SUPPORT`` documents. A document is as toxic as its likeliest sentence;
    its label teaches the sentences in proportion to their odds.
    """
    rows: list[set[str]] = []
    owner: list[int] = []
    support: dict[str, int] = {}
    for i, text in enumerate(texts):
        seen: set[str] = set()
        for told in reader.sentences(text):
            held = set(told)
            if held:
                found = word_features(told, held)
                seen |= found
                rows.append(found | {f"cue {n}" for n in matched_cues(told, held)})
                owner.append(i)
        for f in seen:
            support[f] = support.get(f, 0) + 1
    names = [f"cue {n}" for n in range(len(_CUES))] + sorted(f for f, n in support.items() if n >= SUPPORT and not f.startswith("cue "))
    place = {f: n for n, f in enumerate(names)}
    lists = [[place[f] for f in row if f in place] for row in rows]
    if not lists or not any(toxic):
        return Weights()
    sizes = np.array([len(x) for x in lists])
    flat = np.array([f for x in lists for f in x], dtype=np.int64)
    of = np.repeat(np.arange(len(lists)), sizes)
    own = np.array(owner)
    starts = np.nonzero(np.diff(own, prepend=-1))[0]
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(lists))))
    label = np.array(toxic)[own[starts]]
    mean = np.array([CUE * _CUES[n][1] if n < len(_CUES) else 0.0 for n in range(len(names))])
    spread = np.where(np.arange(len(names)) < len(_CUES), CUE_SPREAD, WORD_SPREAD)
    w, bias = mean.copy(), BIAS
    rate, moment = 0.05, np.zeros(len(names) + 1)
    square = np.zeros(len(names) + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(of, weights=w[flat], minlength=len(lists))
        top = np.maximum.reduceat(z, starts)
        share = np.exp(z - top[group])
        share /= np.bincount(group, weights=share)[group]
        p = 1.0 / (1.0 + np.exp(-np.clip(top, -30, 30)))
        slope = 1.0 - WRONG_TOXIC - WRONG_CLEAN
        says = WRONG_TOXIC + slope * p
        pull = slope * p * (1 - p) * np.where(label, -1.0 / says, 1.0 / (1.0 - says))
        by_row = pull[group] * share
        gradient = np.append(
            np.bincount(flat, weights=by_row[of], minlength=len(names)) + (w - mean) / spread**2, pull.sum() + (bias - BIAS)
        )
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6) * (1 - step / (rounds + 1))
        w, bias = w - move[:-1], bias - move[-1]
    learned = {
        f: float(x - m if n < len(_CUES) else x) for n, (f, x, m) in enumerate(zip(names, w, mean)) if abs(x - m) >= 0.05
    }
    return Weights(float(bias), learned)


def fitted_weights(documents: DataFrame, labels: DataFrame, shared) -> Weights:
    """The weights from the labels of at most ``FIT`` documents, drawn by a hash of their ids.

    The fit is one task over these documents; only the weights reach the driver.
    """
    voted = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("toxic") >= 0.5).alias("is_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(FIT)
    )
    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = (
        texts.join(F.broadcast(voted), "doc_id").groupBy("doc_id").agg(F.first("text").alias("text"), F.first("is_toxic").alias("is_toxic"))
    )

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("doc_id", "text", "is_toxic"))))
        reader = Reader(CharModel(shared.value[0]), Known(shared.value[1]))
        made = fit(reader, [r[1] for r in rows], [r[2] for r in rows])
        told = {"": made.bias, **made.learned}
        return pa.table({"feature": pa.array(list(told)), "weight": pa.array(list(told.values()), pa.float64())})

    whole = known.withColumn("whole", F.col("doc_id") * 0)
    got = {r[0]: r[1] for r in whole.groupBy("whole").applyInArrow(run, "feature string, weight double").collect()}
    return Weights(got.pop("", BIAS), got)


def score_documents(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(doc_id, source, insult, threat, hate, sexual, other, score)`` of every document."""
    grams, common = language_model(documents)
    context = documents.sparkSession.sparkContext
    base = context.broadcast((grams, frozenset(common) | LEXICON))
    weights = Weights() if labels is None else fitted_weights(documents, labels, base)
    shared = context.broadcast((base.value[0], base.value[1], weights))
    schema = "doc_id long, source string, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = kept(shared, lambda made: Reader(CharModel(made[0]), Known(made[1]), made[2]))
        for batch in batches:
            found = [reader.judge(t) if t else ({}, 0.0) for t in batch.column(2).to_pylist()]
            parts = [pa.array([f.get(c, 0.0) for f, _ in found], pa.float64()) for c in CATEGORIES]
            whole = pa.array([p for _, p in found], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *parts, whole],
                names=["doc_id", "source", *CATEGORIES, "score"],
            )

    picked = documents.where("doc_id is not null").select(F.col("doc_id").cast("long"), "source", "text")
    return picked.mapInArrow(run, schema)


def abusive_documents(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``(doc_id)`` of the documents whose score reaches ``THRESHOLD``."""
    return score_documents(documents, labels).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def abuse_rates(documents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Documents, abusive ones and their share for each source."""
    scored = score_documents(documents, labels)
    return scored.groupBy("source").agg(
        F.count_distinct("doc_id").alias("documents"),
        F.count_distinct(F.when(F.col("score") >= THRESHOLD, F.col("doc_id"))).alias("abusive"),
        (
            F.count_distinct(F.when(F.col("score") >= THRESHOLD, F.col("doc_id"))) / F.count_distinct("doc_id")
        ).alias("share"),
    )


def model_of(texts: Iterable[str]) -> tuple[CharModel, Known]:
    """The model of a few texts, for tests and single machines."""
    counts: dict[str, int] = {}
    for text in texts:
        for word in set(_PARTS.findall(text.lower())):
            counts[word] = counts.get(word, 0) + 1
    grams: dict[str, float] = {}
    for word, weight in [*((w, math.log1p(n)) for w, n in counts.items()), *((w, LISTED) for w in LEXICON)]:
        for gram, w in word_grams(word, weight):
            grams[gram] = grams.get(gram, 0.0) + w
    return CharModel(grams), Known(frozenset(w for w, n in counts.items() if n >= 5) | LEXICON)
