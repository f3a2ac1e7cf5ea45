"""Cut texts, defective replies, held-out leaks, abusive language."""

import random

import numpy as np
import pytest

from loomwright.llm import abuse, cuts, leaks, pairs

EN = "The keeper put the lantern on the table and asked whether the ferry had left before the storm."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, cuts.EMPTY), ("", cuts.EMPTY), (" ​\n", cuts.EMPTY), ("N/A", cuts.EMPTY), ("...", cuts.EMPTY), ("—", cuts.EMPTY),
        (EN, cuts.WHOLE), ('He said "no."', cuts.WHOLE), ("Done …", cuts.WHOLE), ('"But I never—"', cuts.WHOLE),
        (EN[:-8], cuts.BROKEN), (EN[:-8] + "\n", cuts.BROKEN), ("He sa�", cuts.BROKEN),
        (EN + "\n\nItems:\n- one\n- two", cuts.OPEN), (EN + "\n\nTitle: The late fence", cuts.OPEN), (EN + "\n\nSee [[a]], [[b]]", cuts.OPEN),
        (EN + "\n\nSee [[a", cuts.BROKEN), (EN + "\n\nCold hills,\nno name", cuts.OPEN), (EN + "\n\nFiled under a/b.md", cuts.OPEN),
        ('"Where is it?"', cuts.QUOTED), ('{"ok": true}', cuts.WHOLE), ('{"ok": tr', cuts.BROKEN), ("x" * 40_000, cuts.BROKEN),
    ],
)
def test_endings(text, want):
    assert cuts.ending(text) == want


def length_rows(source, rng, cap=600, ending=cuts.WHOLE, at_cap=cuts.BROKEN):
    lengths = [rng.randrange(100, 600) for _ in range(600)]
    return [(source, "k", min(cap, n), at_cap if n >= cap else ending) for n in lengths]


def test_limits_stand_out_of_their_neighbours(spark):
    rng = random.Random(1)
    rows = length_rows("s", rng, 360) + length_rows("t", rng) + length_rows("stock", rng, 360, at_cap=cuts.WHOLE)
    rows += [("s", "k", None, cuts.WHOLE), (None, "k", 5, cuts.WHOLE), ("s", "k", 0, cuts.EMPTY)]
    schema = "source string, kind string, length int, ending int"
    got = cuts.length_limits(spark.createDataFrame(rows, schema)).collect()
    assert [(r.source, r.length) for r in got] == [("s", 360)]
    assert cuts.length_limits(spark.createDataFrame([], schema)).count() == 0


def test_lengths_where_no_text_ends_count(spark):
    # few and far between: every 9th length occurs twice, one of them eight times
    rows = [("s", "k", n, cuts.WHOLE) for n in range(100, 1000, 9) for _ in range(2)] + [("s", "k", 550, cuts.BROKEN)] * 8
    got = cuts.length_limits(spark.createDataFrame(rows, "source string, kind string, length int, ending int")).collect()
    at_risk = sum(r[2] >= 550 for r in rows)
    assert [r.length for r in got] == [550] and got[0].expected < 0.15 * at_risk / 9


def test_the_limits_decide_what_is_cut_at_them(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", 0, *r) for i, r in enumerate(length_rows("s", rng, 360, at_cap=cuts.OPEN) + length_rows("t", rng, 600, cuts.OPEN))]
    df = spark.createDataFrame(rows, "record_id string, msg_pos int, source string, kind string, length int, ending int")
    limits = cuts.length_limits(df)
    cut = cuts.cut_units(df, limits).where("cut").groupBy("source", "how").count().collect()
    assert [(r.source, r.how, r["count"]) for r in cut] == [("s", "limit", sum(r[2] == "s" and r[4] == 360 for r in rows))]
    assert cuts.cut_units(df, limits.where("false")).where("cut").count() == 0


@pytest.mark.parametrize("text", ["The answer is 42", "def f(x): return x", "x = [1, 2]; y = {}", "It costs $4.50"])
def test_bare_answers_and_code_may_be_left_open(text):
    assert cuts.ending(text) == cuts.OPEN


PROBES = "id string, provenance struct<source:string>, messages array<struct<role:string,content:string,tool_call_id:string,tool_calls:array<struct<id:string>>>>, length int"
REVIEWS = "review_id string, source string, packet struct<brief:string,output:string>"


def turns(*said):
    return [(role, text, None, calls) for role, text, calls in said]


def test_pairs_take_the_last_answer_without_calls(spark):
    rows = [
        ("a", ("s",), turns(("user", "Hi there.", None), ("assistant", "", None), ("assistant", EN, None)), 1),
        ("b", ("s",), turns(("user", "Hi there.", None), ("assistant", EN, None), ("assistant", "", [("c",)]), ("user", "Go on.", None), ("assistant", None, None)), 1),
        ("c", ("s",), turns(("user", "Hi.", None), ("user", "Hi.", None)), 1),
        ("d", None, None, 1),
        ("e", ("s",), turns(("user", None, None), ("assistant", EN[:-9], None)), 1),
    ]
    probes = spark.createDataFrame(rows + rows[:1], PROBES)
    reviews = spark.createDataFrame([("r", "s", ("Brief.", None)), ("q", None, (None, EN)), ("n", "s", None)], REVIEWS)
    got = {tuple(r) for r in pairs.defective_pairs(probes, reviews).collect()}
    assert got == {("b", 4, "empty"), ("e", 1, "truncated"), ("r", 0, "empty"), ("n", 0, "empty")}
    cut = {tuple(r) for r in cuts.cut_texts(probes, reviews).collect()}
    assert cut == {("e", 1)}
    assert pairs.defective_pairs(probes.where("false"), reviews.where("false")).count() == 0


ASK = "Write a short scene in which the keeper finds the lantern and the tailor notices: the boat came late and nobody knew why it had."


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ("I'm sorry, but I can’t help with that request.", "refusal"),
        ("Hello! As a language model, I must decline to continue the mill passage. Thank you for understanding.", "refusal"),
        ("Lo siento, pero no puedo ayudar con esa petición.", "refusal"),
        ("Apologies, producing this is off the table for me.", "refusal"),
        ("That is not something I'm comfortable writing.", "refusal"),
        ("I'd rather not draft a scene of that kind.", "refusal"),
        ("I cannot help with this request. " + "The topic goes beyond what my guidelines cover, so please rephrase your request. " * 8, "refusal"),
        ("I cannot write, the keeper thought. " + (EN + " ") * 5, None),
        ("Il guardiano non trovò la lanterna perché il vento era forte e la barca che aspettava era già partita con gli altri.", "other_language"),
        ("Смотритель поставил фонарь на стол и спросил, ушёл ли паром до бури.", "other_language"),
        ("灯台守はランプをテーブルに置き、嵐の前に渡し船が出たかどうか尋ねた。", "other_language"),
        ('"I\'m sorry, I can\'t help you," said the baker, and the ferry left before anyone had asked.', None),
        ("I can't confirm who moved it. " + EN * 4, None),
        (ASK, "copy"), ("You asked: " + ASK, "copy"), ("> " + ASK.replace("boat", "cart"), "copy"), (ASK.lower(), "copy"),
        ("The boat came late and nobody knew why it had.", None),
        ("Der Wärter stellte die Laterne auf den Tisch und fragte, ob die Fähre vor dem Sturm abgefahren war.", "other_language"),
        (EN, None), (None, "empty"),
    ],
)
def test_defects(reply, want):
    assert pairs.reply_defect(ASK, reply) == want


def test_a_language_that_was_asked_for():
    german = "Der Wärter stellte die Laterne auf den Tisch und fragte, ob die Fähre vor dem Sturm abgefahren war."
    assert pairs.reply_defect("Answer in German. " + ASK, german) is None


def test_common_length_is_the_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(50):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 20))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 20))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert pairs.common_length(a, b) == table[-1][-1]


def holds(doc, item):
    """Whether a run of 28 item words stands in the document with at most 3 errors."""
    for s in range(len(item) - 27):
        row = [0] * (len(doc) + 1)
        for i, w in enumerate(item[s : s + 28]):
            new = [i + 1]
            for j, d in enumerate(doc):
                new.append(min(row[j] + (d != w), row[j + 1] + 1, new[j] + 1))
            row = new
        if min(row) <= 3:
            return True
    return False


def test_leaks_equal_an_alignment_of_everything(spark):
    rng = random.Random(7)
    pick = lambda n: [rng.choice([f"v{i}" for i in range(400)]) for _ in range(n)]
    items = [(i, pick(rng.randrange(28, 80))) for i in range(12)]
    docs = []
    for d in range(60):
        text = pick(rng.randrange(0, 60))
        _, item = rng.choice(items)
        start = rng.randrange(len(item) - 20)
        part = list(item[start : start + rng.randrange(20, 50)])
        for _ in range(rng.randrange(0, 6)):
            at, act = rng.randrange(len(part)), rng.random()
            part[at : at + 1] = [] if act < 0.3 else [rng.choice(part)] if act < 0.7 else [part[at], "added"]
        docs.append((d, text + part + pick(rng.randrange(0, 30))))
    documents = spark.createDataFrame([(d, " ".join(w)) for d, w in docs] + [(900, None), (901, "")], "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, "too short"), (98, None)], "item_id long, text string")
    got = {tuple(r) for r in leaks.leaked_items(documents, table).collect()}
    want = {(d, i) for d, w in docs for i, item in items if holds(w, item)}
    assert want and got >= want
    assert all(holds_ratio(dict(docs)[d], dict(items)[i]) for d, i in got - want)
    assert leaks.leaked_items(documents.where("false"), table).count() == 0
    assert leaks.leaked_items(documents, table.where("false")).count() == 0


def holds_ratio(doc, item):
    """As :func:`holds`, for runs of any length with one error in eight."""
    for n in range(28, len(item) + 1):
        for s in range(len(item) - n + 1):
            row = [0] * (len(doc) + 1)
            for i, w in enumerate(item[s : s + n]):
                new = [i + 1]
                for j, d in enumerate(doc):
                    new.append(min(row[j] + (d != w), row[j + 1] + 1, new[j] + 1))
                row = new
            if 8 * min(row) <= n:
                return True
    return False


def test_a_passage_with_four_errors_in_32_words_leaves_three_windows(spark):
    item = [f"x{i}" for i in range(32)]
    other = list(item)
    for at in (6, 13, 20, 26):  # runs of 6, 6, 6, 5 and 5 words
        other[at] = f"other{at}"
    around = [f"y{i}" for i in range(20)]
    documents = spark.createDataFrame([(1, " ".join(around + other + around))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in leaks.leaked_items(documents, items).collect()] == [(1, 5)]


def test_every_pair_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    index = leaks.WindowIndex([(1, [f"a{i}" for i in range(60)])])
    index.prints = base
    index.__init__([(1, [f"a{i}" for i in range(60)])])
    prints = index.prints.copy()
    for k in range(3):
        probe = prints.copy()
        for i in range(len(probe)):
            for bit in rng.choice(64, k, replace=False):
                probe[i] ^= np.uint64(1) << np.uint64(bit)
        at, window = index.near(probe)
        found = set(zip(at.tolist(), window.tolist()))
        assert all((i, i) in found for i in range(len(probe))) and len(found) == len(at)


def test_plain_words_leave_markup_and_accents():
    assert leaks.plain_words("<p>Été &amp; Straße, so­fort</p>") == ["ete", "strasse", "sofort"]


@pytest.fixture(scope="module")
def reader():
    plain = [EN, "They like the cat and the lice in the canal.", "The oldest bitch had pups and the cock crowed."] * 6
    model, accepted = abuse.model_of(plain)
    return abuse.Reader(model, accepted)


@pytest.mark.parametrize(
    "text",
    [
        "Shut your mouth, you p1g.", "Honestly, you are the dumbest b a s t a r d I have read.", "You are a dis​gusting idi**t.",
        "What kind of blllloody dumbass writes this?", "The Velmari breed like v e r m i n.", "No Quellish in our library!",
        "Come near it again and I will cut your throat.", "Halt die Fresse, du H u r e n s o h n.", "Sale connaaaard, va crever.",
        "He wanted her on her knees with his di​ck in her mouth.", "Vete a la mierda, c**brón.",
        "Those n1ggers should hang", "All faggots must die", "u r a k1ke", "You b i t c h", "He f.u.c.k.e.d her senseless", "You fat, lazy cow!",
    ],
)
def test_abuse_is_found_through_disguise(reader, text):
    assert sum(reader.score(EN + " " + text).values()) >= abuse.THRESHOLD


@pytest.mark.parametrize(
    "text",
    [
        EN, "", "   ", "Rats and lice had ruined the plough.", "The damn lock stuck again.", "The oldest bitch had thirty pups in the canal.",
        "The cock crowed at low water.", "She posed naked for the sculptor.", '"That was a stupid plan of mine," he admitted.',
        "Avoid slurs and insults, even when the midwife is angry.", "The clinic leaflet about breast cancer lay there.", "*viejo* was kept",
        "You can put the garbage out before breakfast.", "Have you fed the pigs?", "Your engine failure light came on.", "Tu as sorti les ordures ?",
    ],
)
def test_plain_language_is_none(reader, text):
    assert reader.score(text) == {}


def test_the_bound_of_an_alignment_loses_nothing():
    rng = random.Random(9)
    held = 0
    for _ in range(400):
        item = np.array([rng.randrange(60) for _ in range(rng.randrange(10, 60))])
        told = [w for w in item.tolist() if rng.random() > 0.06]
        told = [rng.randrange(60) if rng.random() < 0.06 else w for w in told]
        before = rng.randrange(0, 20)
        doc = np.array([rng.randrange(60, 90) for _ in range(before)] + told + [rng.randrange(60) for _ in range(5)])
        for diagonal in (before, before - 3, before + 9):
            if leaks._holds(doc.tolist(), item.tolist(), diagonal):
                held += 1
                assert leaks._may_hold(doc, item, diagonal)
    assert held > 40
    assert not leaks._may_hold(np.arange(0), item, 0) and not leaks._may_hold(np.arange(100, 200), np.arange(40), 5)


def test_unclear_texts_have_no_further_language():
    spanish = "Decían en la escuela que la aprendiz de paso movió la lámpara de aceite; la tía de la parroquia reparó una barca."
    assert pairs.language(pairs.words(spanish)) in ("es", None)
    assert pairs.language(pairs.words("Het meisje zag dat de boot niet van hem was en dat hij ook voor het huis bleef.")) == "nl"


def test_short_prompts_can_be_copied_and_languages_asked_for():
    assert pairs.reply_defect("Who wins?", "Who wins?") == "copy"
    assert pairs.reply_defect("Who wins?", "Nobody wins.") is None and pairs.reply_defect("Hello", "Hello") is None
    russian = "Смотритель поставил фонарь на стол и спросил, ушёл ли паром до бури."
    assert pairs.reply_defect("Tell me in Russian what the keeper did with the lantern and the ferry.", russian) is None
    assert pairs.reply_defect(russian, EN) == "other_language" and pairs.reply_defect(russian, "Кузнец взял письмо и ушёл домой до утра.") is None


def test_the_likeliest_reading_needs_no_lexicon():
    model, known = abuse.model_of(["The docks were full of ducks near the dock"] * 2000)
    assert [abuse.decode(t, model, known) for t in ("d*cks", "d0ck", "l1c3", "w*rthless")] == ["docks", "dock", "lice", "worthless"]
    assert abuse.decode("q*" * 40, model, known) is None


def test_decoding_equals_a_search_of_all_readings():
    model, known = abuse.model_of([EN] * 9)

    def cost(token, word):
        best = {"": 0.0}
        for options in abuse.lattice(token):
            best = {t + a: min(best[t] + x for t in best for b, x in options if t + b == t2) for t in best for a, _ in options for t2 in (t + a,)}
        told = "^^^" + word + "$"
        return best[word] + sum(model.cost(told[i - 3 : i], told[i]) for i in range(3, len(told))) if word in best else None

    for token in ("l4nt3rn", "*f", "th*", "teeerm", "a$ked"):
        costs = {w: c for w in known.words if len(w) <= 8 and (c := cost(token, w)) is not None} if token.count("*") < 2 else {}
        assert abuse.decode(token, model, known) == (min(costs, key=lambda w: (costs[w], w)) if costs else None)


def test_labels_move_the_weights(reader):
    bad, good = [f"{EN} The zorgs are krelling number {i}." for i in range(40)], [f"{EN} Number {i} was late." for i in range(120)]
    texts, toxic = bad + good, [True] * 38 + [False] * 120 + [True] * 2
    weights = abuse.fit(reader, texts, toxic)
    fitted = abuse.Reader(reader.model, reader.known, weights)
    assert all(fitted.judge(t)[1] >= abuse.THRESHOLD for t in bad) and not any(fitted.score(t) for t in good)
    assert abuse.fit(reader, [], []).learned == {} == abuse.fit(reader, good, [False] * 120).learned


def test_labels_of_documents_are_used(spark):
    rows = [(i, "s", f"{EN} The zorgs are krelling number {i}." if i % 3 == 0 else f"{EN} Number {i}.") for i in range(180)]
    df = spark.createDataFrame([*rows, rows[0], (999, None, None)], "doc_id long, source string, text string")
    votes = [(i, int(i % 3 == 0)) for i in range(150)] + [(0, 1), (1, None), (None, 1), (5000, 1)]
    labels = spark.createDataFrame(votes, "doc_id long, toxic int")
    got = {r.doc_id for r in abuse.abusive_documents(df, labels).collect()}
    assert got == {i for i in range(180) if i % 3 == 0}
    assert abuse.abusive_documents(df, labels.where("false")).count() == 0


def test_scores_of_odd_documents(spark):
    df = spark.createDataFrame(
        [(1, "s", "You are a stupid idiot, you pig."), (1, "s", "You are a stupid idiot, you pig."), (2, "s", None), (3, None, ""), (4, "t", EN * 300)],
        "doc_id long, source string, text string",
    )
    assert [r.doc_id for r in abuse.abusive_documents(df).collect()] == [1]
    assert {r.source: (r.documents, r.abusive) for r in abuse.abuse_rates(df).collect()} == {"s": (2, 1), None: (1, 0), "t": (1, 0)}
    assert abuse.abusive_documents(df.where("false")).count() == 0
