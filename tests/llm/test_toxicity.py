import pytest

from tidegauge.llm import toxicity as t


@pytest.mark.parametrize(
    "text, score",
    [
        ("you are an idiot", 1.5), ("what an IDIOT!", 1.0), ("he is not an idiot", 0), ("isn't he stupid", 0.5 * 0), ("pathetic loser", 2.0),
        ('she said "you idiot"', 0.375 * 2), ("They called him a moron.", 0.25 + 0.5), ("I will kill you", 1.25), ("we must beat inflation", 0.75), ("kill the lights", 0),
        ("not here, you moron", 1.5), ("idiots-in-charge", 1.0), ("idiotsyncratic mass moronity", 0), ("", 0), (None, 0), ("... !!! ???", 0), ("you scum! you scum", 3.0),
    ],
)
def test_scores(text, score):
    assert t.score_text(text)[0] == pytest.approx(score)


def test_composition_equals_the_cascade():
    """The compiled machine against the five transducers run one after the other, on random tags."""
    import random

    rng, rows = random.Random(1), t.compiled()
    steps = [t._insult, t._threat, t._target, t._negation, t._reported]
    for _ in range(300):
        states, state = [0] * 5, 0
        for _ in range(30):
            label = tag = rng.randrange(11)
            total = 0.0
            for k, step in enumerate(steps):
                states[k], label, w = step(states[k], label)
                total += w
            state, kind, w = rows[state][tag]
            assert w == pytest.approx(total)
            assert kind == (2 if label == t.HIT_T else 1 if label in (t.HIT_A, t.HIT_N) else 0)


def test_only_trigger_sentences_are_needed():
    text = "Fine here.\nYou idiot, go!  All good? " * 3 + "x" * 100_000 + " moron"
    whole = sum(c[2] for s in t._END.split(text) for c in t.clauses(s))
    assert t.score_text(text)[0] == pytest.approx(whole) == 1.5 * 3 + 1


def test_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in t.toxicity(docs).collect()}
    marked = labels.collect()
    assert all(r.toxic for r in marked if got[r.doc_id].toxic)
    kept = {r.doc_id for r in t.drop_toxic(docs).collect()}
    assert kept == {i for i, r in got.items() if not r.toxic}
    for r in got.values():
        assert r.score == pytest.approx(sum(c.weight for c in r.clauses))


def test_odd_rows(spark):
    rows = [(1, None, 0.1), (2, "", 0.1), (3, "idiot", 0.1), (3, "idiot", 0.1), (None, "fine", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    got = sorted((r.doc_id or 0, r.score, r.toxic, len(r.clauses)) for r in t.toxicity(docs).collect())
    assert got == [(0, 0.0, False, 0), (1, 0.0, False, 0), (2, 0.0, False, 0), (3, 1.0, True, 1), (3, 1.0, True, 1)]
    assert sorted(r.doc_id or 0 for r in t.drop_toxic(docs).collect()) == [0, 1, 2] and t.drop_toxic(docs).columns == docs.columns
    assert t.toxicity(docs.limit(0)).count() == 0


def test_lexemes():
    lexemes = t.Lexemes(("vex",), frozenset(["vexa"]))
    score = lambda text: t.score_text(text, lexemes)[0]
    assert score("Un vexo. VEXI!") == 1.0 and score("l'vexo d’vexi") == 1.0 and score("vexo vexa") == 0.75
    assert score("vexo vexo VEXO") == 0.5 and score("vex vex. convexo, vex!") == 0 and score("idiot vexo") == 1.5
    copies = {"": (50, 500)} | {f"seldom{'x' * n}word": (20, 0) for n in range(2)} | {f"sto{c}": (9, 1) for c in "abcde"} | {"stoz": (1, 3), "sto": (1, 90)}
    assert t.choose_lexemes(copies) == t.Lexemes(("sto",), frozenset(["sto", "stoz"]))
    assert t.choose_lexemes({}) == t.NO_LEXEMES


def test_recall_by_language_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    lexemes = t.fit_lexemes(docs, labels)
    rest = labels.filter(t.held_out(t.F.col("doc_id"))).select("doc_id", t.F.col("toxic").alias("marked"))
    rows = t.toxicity(docs, lexemes=lexemes).join(docs.select("doc_id", "lang"), "doc_id").join(rest, "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        bad, good = ([r.toxic for r in rows if r.lang == lang and r.marked == m] for m in (1, 0))
        print(lang, sum(bad), len(bad), sum(good), len(good))
        assert sum(bad) >= 0.8 * len(bad) > 8 and sum(good) <= 0.015 * len(good), lang
    assert t.fit_lexemes(docs, labels.limit(0)) == t.NO_LEXEMES


def by_hand(text, lexemes=t.NO_LEXEMES):
    """The rules of the module's docstring as one loop over words, without transducers, tables or an automaton."""
    import re

    score, seen, nouns, adjectives = 0.0, set(), set(t.INSULT_NOUNS), set(t.INSULT_ADJECTIVES)
    for sentence in re.split(r"[.!?\n\r]", text or ""):
        reported, quoted, paid, hit = False, False, 0.0, False
        intent = negated = person = waiting = bonus = None

        def clause_ends():
            nonlocal score, paid, hit, intent, negated, person, waiting, bonus
            score += max(0.0, paid) if hit else 0.0
            paid, hit, intent, negated, person, waiting, bonus = 0.0, False, 0, 0, False, False, False

        clause_ends()
        for token in re.findall(r"[^\W_]+(?:['’][^\W_]+)*|[,;:()\"“”«»]", sentence):
            if token in ",;:()" or token.lower() in ("but", "because", "although", "while"):
                clause_ends()
                continue
            low = token.lower().replace("’", "'")
            parts = low.split("'")
            forms = [p for p in parts if lexemes.stems and any(p.startswith(s) and p != s for s in lexemes.stems)] if low not in t._TAGS else []
            if forms:
                words = [("form", p) for p in forms]
            elif "'" in low and low.replace("'", "", low.count("'")) not in t._TAGS:
                head, tail = "'".join(parts[:-1]), parts[-1]
                words = [("word", w) for w in (head, tail) if w in t._TAGS] or [("word", "")]
            else:
                words = [("word", low.replace("'", ""))]
            for kind, w in words:
                reporting = reported or quoted
                if kind == "form":
                    if w not in seen:
                        paid, hit = paid + (0.25 if w in lexemes.weak else 0.5), True
                    seen.add(w)
                elif token in '"“”«»':
                    quoted, reported = not quoted, reported and quoted and False
                elif w in nouns or w in adjectives or w in t.HARM_VERBS and intent > 0:
                    value = 0.75 if w in t.HARM_VERBS else 1.0
                    if w in t.HARM_VERBS:
                        waiting, bonus, person, intent = True, False, False, 0
                    elif person and not bonus and not waiting:
                        paid, bonus = paid + 0.5, True
                    elif not bonus:
                        waiting = True
                    if negated <= 0:
                        paid += value - (0.75 * value if reporting else 0)
                        hit = True
                    if w not in t.HARM_VERBS:
                        intent -= 1
                    continue
                intent, negated = intent - 1, negated - 1
                if kind == "word":
                    if w in t.INTENT or w == "going":
                        intent = 3
                    elif w in t.NEGATIONS:
                        negated = 3
                    elif w in t.REPORTING:
                        reported = True
                    elif w in t.TARGETS or w in t.STRONG_TARGETS:
                        if waiting and not bonus:
                            paid, bonus = paid + 0.5, True
                        person = True
        clause_ends()
    return round(score, 6)


def test_against_a_scorer_by_hand(spark):
    """Every row of two tables, with and without lexemes, against the rules written down anew."""
    for folder in ("sf0.001", "sf0.01"):
        docs, labels = (spark.read.parquet(f"/root/testdata/{folder}/{n}.parquet") for n in ("documents", "labels"))
        texts = {r.doc_id: r.text for r in docs.collect()}
        for lexemes in (t.NO_LEXEMES, t.fit_lexemes(docs, labels), t.Lexemes(("ent", "pre", "con"), frozenset(["contre"]))):
            got = {r.doc_id: r.score for r in t.toxicity(docs, lexemes=lexemes).collect()}
            wrong = {i: (got[i], by_hand(text, lexemes)) for i, text in texts.items() if got[i] != pytest.approx(by_hand(text, lexemes))}
            assert not wrong and sum(s > 0 for s in got.values()) > 5


def test_random_sentences_against_a_scorer_by_hand():
    import random

    rng = random.Random(7)
    words = ["idiot", "stupid", "kill", "beat", "will", "going", "you", "they", "not", "isn't", "you're", "said", '"', ",", "but", ".", "the", "cat", "I'll", "l'vexo", "vexi", "vexa", "can’t", "!"]
    lexemes = t.Lexemes(("vex",), frozenset(["vexa"]))
    for _ in range(20_000):
        text = " ".join(rng.choices(words, k=rng.randint(1, 14)))
        assert t.score_text(text, lexemes)[0] == pytest.approx(by_hand(text, lexemes)), text
