"""Toxicity by a weighted finite-state pattern grammar.

Five transducers over the tags of a clause's words are composed into one machine
(weights add, as in the tropical semiring):

    lexicon insult -> threat -> target -> negation -> reported speech

* the insult transducer turns insult words into hits and pays their weight; a second insult
  word in one clause ("pathetic loser") stays a hit of its own;
* the threat transducer recognises intent ("will", "going to") followed by a verb of harm
  and turns the verb into a threat hit;
* the target transducer pays a bonus where a person is addressed before or after a hit of
  the clause ("you ... idiot", "idiot ... you");
* the negation transducer takes a hit's weight back within NEGATION_SPAN words after a
  negation ("not an idiot");
* the reported-speech transducer takes most of a hit's weight back after a verb of saying
  or a quotation mark in the same sentence ('she said "you idiot"').

The score of a document is the sum over its matched clauses, whole text, never a prefix.

The words above are English. For every other language the table's own labels give lexemes
(fit_lexemes): stems whose inflected forms stand in toxic rows and hardly in clean ones. They
are arcs of the insult transducer too, but a single one is weak: two different forms of full
weight, or four that clean rows use as well, reach REJECT_FROM. The other transducers, which
know English grammar only, let them pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSULT_NOUNS = """idiot idiots moron morons scum loser losers clown clowns trash imbecile imbeciles
bastard bastards asshole assholes bitch bitches vermin parasite parasites cretin cretins dumbass
jackass scumbag scumbags dimwit halfwit retard retards dipshit freak freaks subhuman subhumans""".split()
INSULT_ADJECTIVES = """stupid pathetic disgusting worthless idiotic moronic braindead brainless
despicable repulsive filthy""".split()
HARM_VERBS = """kill killing murder hurt destroy shoot stab strangle slaughter burn beat smash
punch hang behead rape""".split()
INTENT = "will ll gonna shall must should".split()
TARGETS = "you your yours yourself youre u ur they them he she him her people".split()
STRONG_TARGETS = "you your yours yourself youre u ur".split()
NEGATIONS = "not no never isnt arent wasnt werent dont doesnt didnt wont cannot cant nobody none without".split()
REPORTING = "said says say saying called calls calling wrote writes quoted quotes reported claimed told tells".split()

#: Weight of a noun, an adjective, a threat; bonus of a target; share of a hit that reported speech takes back.
NOUN, ADJECTIVE, THREAT, TARGET_BONUS, REPORTED_BACK = 1.0, 1.0, 0.75, 0.5, 0.75
NEGATION_SPAN = 3
THREAT_SPAN = 3
#: A document is rejected from this score: one insult that is neither negated nor reported, or a threat at a person.
REJECT_FROM = 1.0

#: Weight of a fitted lexeme, and of a form of one that clean rows use as well.
LEXEME, WEAK_LEXEME = 0.5, 0.25
#: Labelled rows, about, that lexemes are fitted on; all of them from one half of the ids, the other half is held out.
SAMPLE = 10_000
#: Letters of a stem, forms of it marked toxic that it needs, and how much likelier toxic rows must hold it (and each such form).
STEM_LETTERS, MIN_FORMS, MIN_RATIO = range(3, 13), 5, 6.0
LONGEST_WORD = 40

OTHER, NOUN_T, ADJ_T, HARM_T, INTENT_T, YOU_T, PERSON_T, NEG_T, SAY_T, QUOTE_T, CLAUSE_T, LEXEME_T, WEAK_T = range(13)
_TAGS: dict[str, int] = {}
for _words, _tag in (
    (TARGETS, PERSON_T), (STRONG_TARGETS, YOU_T), (INTENT, INTENT_T), (NEGATIONS, NEG_T), (REPORTING, SAY_T),
    (HARM_VERBS, HARM_T), (INSULT_ADJECTIVES, ADJ_T), (INSULT_NOUNS, NOUN_T),
):
    _TAGS.update(dict.fromkeys(_words, _tag))

# Labels passed between the transducers, besides the tags.
HIT_N, HIT_A, HIT_T, HIT_L, VOID = "hit_n", "hit_a", "hit_t", "hit_l", "void"
HITS = (HIT_N, HIT_A, HIT_T)
_PAID = {HIT_N: NOUN, HIT_A: ADJECTIVE, HIT_T: THREAT}


class Transducer:
    """Deterministic weighted transducer: step(state, label) -> (state, label out, weight)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def compose(self, other: "Transducer") -> "Transducer":
        def step(state, label):
            p, middle, w = self.step(state[0], label)
            q, out, v = other.step(state[1], middle)
            return (p, q), out, w + v

        return Transducer((self.start, other.start), step)


def _insult(state, label):
    if label == NOUN_T:
        return state, HIT_N, NOUN
    if label == ADJ_T:
        return state, HIT_A, ADJECTIVE
    if label in (LEXEME_T, WEAK_T):
        return state, HIT_L, LEXEME if label == LEXEME_T else WEAK_LEXEME
    return state, label, 0.0


def _threat(state, label):
    # state: words left in which a verb of harm completes the threat
    if label in (INTENT_T,):
        return THREAT_SPAN, label, 0.0
    if label == CLAUSE_T:
        return 0, label, 0.0
    if label == HARM_T:
        return (0, HIT_T, THREAT) if state else (0, OTHER, 0.0)
    return max(0, state - 1), label, 0.0


def _target(state, label):
    # state: 0 nothing yet, 1 target seen, 2 hit waiting for a target, 3 bonus paid
    if label == CLAUSE_T:
        return 0, label, 0.0
    if label in (YOU_T, PERSON_T):
        return {0: 1, 1: 1, 2: 3, 3: 3}[state], label, TARGET_BONUS if state == 2 else 0.0
    if label == HIT_T:  # the person before a verb of harm is its subject, so only one after it counts
        return 2, label, 0.0
    if label in HITS:
        return {0: 2, 1: 3, 2: 2, 3: 3}[state], label, TARGET_BONUS if state == 1 else 0.0
    return state, label, 0.0


def _negation(state, label):
    # state: words left in the scope of a negation
    if label == CLAUSE_T:
        return 0, label, 0.0
    if label == NEG_T:
        return NEGATION_SPAN, label, 0.0
    if label in HITS and state:
        return state, VOID, -_PAID[label]
    return max(0, state - 1), label, 0.0


def _reported(state, label):
    # state: 0 own words, 1 after a verb of saying (to the end of the sentence), 2 inside quotation marks
    if label == QUOTE_T:
        return 0 if state == 2 else 2, label, 0.0
    if label == SAY_T:
        return max(state, 1), label, 0.0
    if label in HITS and state:
        return state, label, -REPORTED_BACK * _PAID[label]
    return state, label, 0.0


def grammar() -> Transducer:
    machine = Transducer(0, _insult)
    for start, step in ((0, _threat), (0, _target), (0, _negation), (0, _reported)):
        machine = machine.compose(Transducer(start, step))
    return machine


def compiled() -> list[list[tuple[int, int, float]]]:
    """The composed machine as a table: [state][tag] -> (next state, 1 noun or adjective / 2 threat / 0, weight)."""
    machine = grammar()
    number, rows, queue = {machine.start: 0}, [], [machine.start]
    while queue:
        state, row = queue.pop(0), []
        for tag in range(13):
            nxt, out, w = machine.step(state, tag)
            if nxt not in number:
                number[nxt] = len(number)
                queue.append(nxt)
            row.append((number[nxt], 2 if out == HIT_T else 1 if out in (HIT_N, HIT_A, HIT_L) else 0, w))
        rows.append(row)
    return rows


_MACHINE: list[list[tuple[int, int, float]]] = []


class Lexemes(NamedTuple):
    """Fitted stems, and the forms of them that are weak. The bare stem is none of its forms."""

    stems: tuple[str, ...] = ()
    weak: frozenset[str] = frozenset()

    def tag(self, word: str) -> int | None:
        if not word.startswith(self.stems) or word in self.stems:
            return None
        return WEAK_T if word in self.weak else LEXEME_T


NO_LEXEMES = Lexemes()


@lru_cache(8)
def _triggers(stems: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds the English words, with their lengths, and the stems, with theirs below zero."""
    automaton = ahocorasick.Automaton()
    for stem in stems:
        automaton.add_word(stem, -len(stem))
    for word in {*INSULT_NOUNS, *INSULT_ADJECTIVES, *HARM_VERBS}:
        automaton.add_word(word, len(word))
    automaton.make_automaton()
    return automaton


_END = re.compile(r"[.!?\n\r]")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[,;:()\"“”«»]")
_QUOTES = frozenset("\"“”«»")
_CONJUNCTIONS = frozenset(("but", "because", "although", "while"))


def _tag(word: str, lexemes: Lexemes = NO_LEXEMES, seen: set[str] | None = None) -> tuple[int, ...]:
    if word in _QUOTES:
        return (QUOTE_T,)
    if len(word) == 1 and not word.isalnum():
        return (CLAUSE_T,)
    low = word.lower()
    tag = _TAGS.get(low)
    if tag is not None:
        return (tag,)
    if low in _CONJUNCTIONS:
        return (CLAUSE_T,)
    if lexemes.stems:
        fitted = [(part, tag) for part in low.replace("’", "'").split("'") if (tag := lexemes.tag(part)) is not None]
        if fitted:
            tags = []
            for part, tag in fitted:  # a form that is repeated counts once in a text
                tags.append(OTHER if seen is not None and part in seen else tag)
                if seen is not None:
                    seen.add(part)
            return tuple(tags)
    if "'" in low or "’" in low:
        head, _, tail = low.replace("’", "'").rpartition("'")
        joined = _TAGS.get(head + tail)
        if joined is not None:
            return (joined,)
        return tuple(t for t in (_TAGS.get(head), _TAGS.get(tail)) if t is not None) or (OTHER,)
    if low == "going":
        return (INTENT_T,)
    return (OTHER,)


def _lower(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def sentences_with_triggers(text: str, stems: tuple[str, ...] = ()) -> Iterator[tuple[int, int]]:
    """Spans of the sentences that hold an insult, a verb of harm or a form of a stem; no other can score."""
    low, at = _lower(text), 0
    for last, length in _triggers(stems).iter(low):
        first, stop = last - abs(length) + 1, last + 1
        if first < at or first and low[first - 1].isalnum() or (stop < len(low) and low[stop].isalnum()) != (length < 0):
            continue
        begin = max(text.rfind(c, at, first) for c in ".!?\n\r") + 1 or at
        m = _END.search(text, stop)
        at = m.start() if m else len(text)
        yield begin, at


def clauses(sentence: str, lexemes: Lexemes = NO_LEXEMES, seen: set[str] | None = None) -> list[tuple[int, int, float, bool]]:
    """Matched clauses of one sentence: (start, end, weight, has a threat). seen: the forms of lexemes so far in its text."""
    if not _MACHINE:
        _MACHINE.extend(compiled())
    found, state, weight, hit, threat, start, last = [], 0, 0.0, False, False, None, 0
    for m in _TOKEN.finditer(sentence):
        for tag in _tag(m.group(), lexemes, seen):
            state, kind, w = _MACHINE[state][tag]
            if tag == CLAUSE_T:
                if hit and weight > 0:
                    found.append((start, last, weight, threat))
                weight, hit, threat, start = 0.0, False, False, None
                continue
            weight += w
            hit = hit or kind > 0
            threat = threat or kind == 2
        if m.group()[0].isalnum():
            start = m.start() if start is None else start
            last = m.end()
    if hit and weight > 0:
        found.append((start, last, weight, threat))
    return found


def score_text(text: str | None, lexemes: Lexemes = NO_LEXEMES) -> tuple[float, list[tuple[int, int, float, bool]]]:
    """Score and matched clauses (start, end, weight, threat) of a whole text; null scores 0."""
    if not text:
        return 0.0, []
    out, seen = [], set()
    for begin, end in sentences_with_triggers(text, lexemes.stems):
        out += [(begin + s, begin + e, w, t) for s, e, w, t in clauses(text[begin:end], lexemes, seen)]
    return round(sum(c[2] for c in out), 6), out


_CLAUSES = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("weight", pa.float64()), ("threat", pa.bool_()), ("text", pa.string())]))
_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("clauses", _CLAUSES)])


def _score_batches(lexemes: Lexemes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, found = [], []
            for text in b.column(1):
                text = text.as_py()
                score, spans = score_text(text, lexemes)
                scores.append(score)
                found.append([{"start": s, "length": e - s, "weight": w, "threat": t, "text": text[s:e]} for s, e, w, t in spans])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(found, _CLAUSES)], schema=_SCORED)

    return run


def held_out(doc_id: Column) -> Column:
    """Whether an id is of the half that lexemes are never fitted on."""
    return F.pmod(F.xxhash64(doc_id.cast("bigint")), F.lit(2)) == 1


_WORD = re.compile(r"[^\W_]+")


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word, how many toxic and how many clean rows hold it; under the empty word, how many rows there are."""
    counts = (Counter(), Counter())
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts[not toxic].update({"", *(w for w in _WORD.findall((text or "").lower()) if len(w) <= LONGEST_WORD and w not in _TAGS)})
    words = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], ["word", "toxic", "clean"])


def choose_lexemes(counts: dict[str, tuple[int, int]]) -> Lexemes:
    """The lexemes of word -> (toxic rows, clean rows); the empty word has the number of rows.

    A stem needs MIN_FORMS forms that each are in two toxic rows and MIN_RATIO times likelier there
    (copies of one toxic row repeat its words, but don't inflect them), and the ratio over all its forms.
    """
    n_toxic, n_clean = counts.get("", (0, 0))
    ratio = lambda toxic, clean: toxic / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1))
    stems_of = lambda w: [w[:n] for n in STEM_LETTERS if n < len(w)]
    forms = Counter(p for w, (toxic, clean) in counts.items() if w and toxic >= 2 and ratio(toxic, clean) >= MIN_RATIO for p in stems_of(w))
    sums = {p: [0, 0] for p, n in forms.items() if n >= MIN_FORMS}
    for w, (toxic, clean) in counts.items():
        for p in stems_of(w):
            if p in sums:
                sums[p][0] += toxic
                sums[p][1] += clean
    stems: list[str] = []
    for p in sorted((p for p, x in sums.items() if ratio(*x) >= MIN_RATIO), key=lambda p: (-forms[p], -len(p), p)):
        if not any(p.startswith(q) or q.startswith(p) for q in stems):
            stems.append(p)
    found = tuple(sorted(stems))
    return Lexemes(found, frozenset(w for w, (toxic, clean) in counts.items() if found and clean >= 2 and w.startswith(found) and ratio(toxic, clean) < MIN_RATIO))


def fit_lexemes(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexemes:
    """Lexemes of docs(doc_id, text) under labels(doc_id, toxic), from about `sample` labelled rows at most.

    Only ids that aren't held_out are read. A row is toxic if one of its labels says so; null labels
    don't count. Too few labelled rows give no lexemes."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("of"), (F.col("toxic") == 1).alias("toxic")).filter(~held_out(F.col("of")) & F.col("toxic").isNotNull())
    marked = marked.groupBy("of").agg(F.bool_or("toxic").alias("toxic"))
    n = marked.count()
    if not n:
        return NO_LEXEMES
    marked = marked.filter(F.pmod(F.xxhash64("of", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * min(1, sample / n)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(F.broadcast(marked), F.col("id") == F.col("of")).select("text", "toxic")
    words = rows.mapInArrow(_count_words, "word string, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    got = words.toArrow()
    return choose_lexemes({w: (t, c) for w, t, c in zip(*(got.column(k).to_pylist() for k in ("word", "toxic", "clean")))})


def toxicity(docs: DataFrame, reject_from: float = REJECT_FROM, lexemes: Lexemes = NO_LEXEMES) -> DataFrame:
    """doc_id, score, toxic, clauses of every row of docs(doc_id, text).

    Null, empty or word-less text: score 0, no clauses. Repeated rows are scored each. A text is
    scored whole, however long.
    A null doc_id stays null. Columns besides doc_id and text are not read. An empty table gives none.
    """
    scored = docs.select("doc_id", "text").mapInArrow(
        _score_batches(lexemes), "doc_id bigint, score double, clauses array<struct<start:int,length:int,weight:double,threat:boolean,text:string>>"
    )
    return scored.select("doc_id", "score", (F.col("score") >= reject_from).alias("toxic"), "clauses")


def drop_toxic(docs: DataFrame, reject_from: float = REJECT_FROM, lexemes: Lexemes = NO_LEXEMES) -> DataFrame:
    """The rows of docs whose text scores below reject_from, all columns as they are.

    Null, empty and word-less texts score 0 and stay; repeated rows are kept or dropped alike;
    long texts are scored whole; columns of any other name are carried along; an empty table gives none."""

    @F.arrow_udf(T.DoubleType())
    def toxicity_score(texts: pa.Array) -> pa.Array:
        return pa.array([score_text(t.as_py(), lexemes)[0] for t in texts], pa.float64())

    return docs.filter(toxicity_score(F.col("text")) < reject_from)
