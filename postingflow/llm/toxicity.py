"""Toxic clauses by a composed weighted finite-state grammar.

Words become classes (insult, loose insult, threat verb, target, copula, negation, reported speech, other); four transducers
rewrite the classes of a clause - reported speech marks what follows it, negation marks the next few words, threats need a
verb and a target after it or an object before or in it, an insult is aimed if it is said of a target ("he is an ...") or to
one ("you ...") - and a weighted acceptor adds up what is left. The transitions of the composed machine are tabulated as they
are met, so a clause costs one lookup a word.

A text scores as its highest clause, never by the sum of its clauses. One insult that is aimed at nobody stays below the
threshold (two in one clause reach it), and a loose one (trash, stupid: said of things as well) counts nothing unless labels show it to be an insult in
this corpus. What several clauses hold in common counts by density: unaimed insults make a text toxic if two clauses or more
hold them and they come to DENSITY of all its clauses, so that a long text isn't toxic for its length.

The lexicon is a hand-written seed and the words that set toxic labelled documents apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import of_row, packed, quoted, table, unpacked

THRESHOLD = 1.0
SAMPLE = 20_000  # labelled documents that the lexicon is learned from, at most
ROWS = 256  # documents whose words are held at a time
MIN_CONTEXTS = 3  # different contexts in toxic documents that a learned word needs
MIN_PRECISION = 0.95
STEM = range(4, 8)  # letters of a learned stem
STEM_WORDS, STEM_BOUND = 5, 0.9  # words that a stem needs, and the lower bound of its precision

DENSITY = 0.025  # weight of unaimed insults for each clause of a text that makes it toxic
ENOUGH = 0.95  # weight of unaimed insults in the whole text that density needs

INSULTS = """idiot idiots moron morons imbecile imbeciles loser losers scum coward cowards halfwit dimwit scumbag retard bastard bitch asshole
idiota idiotas imbécil escoria cabrón
abruti connard crétin imbécile salaud
trottel dummkopf arschloch abschaum versager dreckskerl schwachkopf idioten""".split()
# said of things as well: insults only of or to a target
LOOSE_INSULTS = """clown clowns trash garbage worthless pathetic disgusting stupid dumb vermin parasite parasites filth
estúpido estúpida tonto tonta basura payaso patético ordure débile minable raclure""".split()
THREATS = """kill murder hurt strangle stab shoot burn hang destroy beat slaughter
matar mataré golpear tuer tuerai égorger frapper töten umbringen erwürgen abstechen""".split()
TARGETS = """your yourself he she him her them their people everyone ustedes ellos ellas toi ils elles leur er ihn""".split()
YOUS = """you u ya these those du tú usted vosotros tu""".split()  # may be said to somebody: "you ..."
COPULAS = """is are am was were be been being seem seems looks like such
ist sind bist seid war waren est es sont êtes sommes était étaient eres son sois somos era eran""".split()
YOU_ARES = "you're youre he's she's they're t'es c'est".split()  # target and copula in one
PREPOSITIONS = "in on at with of for from to by into under near about im auf mit von für aus zu dans sur avec pour en con por".split()  # what follows is not said of the target
# Objects before a threat verb: these may stand some words before it, and are targets anywhere
OBJECTS = "dich euch ihn te os".split()
FORMAL = "vous sie ihr they".split()  # may be subjects: objects right before the verb only, and targets anywhere
ARTICLES = "le la les lo los las".split()  # objects right before the verb, and else nothing
ENCLITIC = [v + o for v in ("matar", "golpear") for o in "te os lo la le los las les".split()] + ["t'égorger", "l'égorger"]  # verb and target in one
NOT_ARES = "isn't aren't wasn't weren't ain't".split()  # negation and copula in one
NEGATIONS = "not no never don't doesn't didn't nicht kein keine nie pas jamais nunca jamás ningún".split()
REPORTS = """said says say told wrote claimed quoted reported called alleged " “ ” « » sagte sagt behauptete schrieb
dit écrit déclaré dijo dice escribió""".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, OBJECT, CLITIC, ARTICLE, AIMED, LOOSE, YOU, COPULA, YOU_ARE, PREPOSITION, NOT_ARE = range(16)
_WORDS = [(PREPOSITION, PREPOSITIONS), (COPULA, COPULAS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS), (LOOSE, LOOSE_INSULTS), (OBJECT, OBJECTS), (CLITIC, FORMAL), (ARTICLE, ARTICLES), (AIMED, ENCLITIC), (YOU, YOUS), (YOU_ARE, YOU_ARES), (NOT_ARE, NOT_ARES)]
CLASSES = {w: c for c, ws in _WORDS for w in ws}
HITS = (INSULT, LOOSE, THREAT, AIMED)
NEAR = 4  # words that a negation, a threat or a copula reaches
VOCATIVE = 2  # words that a "you" reaches
TOKEN = re.compile(r"[\w']+|[\"“”«»]")
BREAK = re.compile(r"[.!?;\n]")


def tokens(low: str) -> list[str]:
    """Words of a lower-cased text without quotes around them, and signs of quotation."""
    return [t for w in TOKEN.findall(low) if (t := w.strip("'"))]


class Transducer:
    """A deterministic transducer: ``step(state, symbol) -> (state, symbol)`` from state ``start``."""

    def __init__(self, start, step: Callable) -> None:
        self.start, self.step = start, step

    def __matmul__(self, then: Transducer) -> Transducer:
        """Composition: this one's output is the other's input."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = then.step(state[1], out)
            return (a, b), out

        return Transducer((self.start, then.start), step)


class Tabulated:
    """A transducer over single classes with its states by number; what a state does with a class is worked out once."""

    def __init__(self, machine: Transducer) -> None:
        self.machine = machine
        self.states, self.number, self.moves = [machine.start], {machine.start: 0}, {}

    def __call__(self, state: int, kind: int):
        found = self.moves.get((state, kind))
        if found is None:
            to, out = self.machine.step(self.states[state], (kind, ()))
            if to not in self.number:
                self.number[to] = len(self.states)
                self.states.append(to)
            found = self.moves[state, kind] = self.number[to], out
        return found


# A symbol is (class, marks); marks is a sorted tuple of what the machines before have said about it.
def _reported(state, symbol):
    kind, marks = symbol
    if kind == REPORT:
        return 1, (OTHER, marks)
    return state, (kind, marks + ("reported",) if state and kind in HITS else marks)


def _negated(state, symbol):
    kind, marks = symbol
    if kind in (NEGATION, NOT_ARE):
        return NEAR, (COPULA if kind == NOT_ARE else OTHER, marks)
    return max(0, state - 1), (kind, marks + ("negated",) if state and kind in HITS else marks)


def _threat(state, symbol):
    """A threat verb with a target among the next words leaves a threat at the target; one after an object, or that
    holds its object, leaves it at the verb."""
    kind, marks = symbol
    left, held, reach = state
    if kind == AIMED or kind == THREAT and reach:
        return (0, (), 0), (THREAT, marks)
    if kind == THREAT:
        return (NEAR, marks, 0), (OTHER, ())
    if left and kind in (TARGET, OBJECT, CLITIC, YOU):
        return (0, (), 0), (THREAT, held)
    reach = {OBJECT: NEAR, CLITIC: max(1, reach - 1), ARTICLE: max(1, reach - 1)}.get(kind, max(0, reach - 1))
    out = {OBJECT: TARGET, CLITIC: TARGET, ARTICLE: OTHER}.get(kind, kind)
    return ((left - 1, held, reach) if left > 1 else (0, (), reach)), (out, marks)


def _target(state, symbol):
    """An insult is aimed right behind a "you", or behind a copula that follows a target, before any preposition.

    The state: words left for an insult after "you", for a copula after a target, for an insult after both.
    """
    kind, marks = symbol
    voc, cop, pred = (max(0, x - 1) for x in state)
    if kind in (INSULT, LOOSE):
        return (voc, cop, pred), (kind, marks + ("aimed",) if state[0] or state[2] else marks)
    if kind == YOU:
        return (VOCATIVE, NEAR, pred), symbol
    if kind in (TARGET, THREAT):
        return (0, NEAR, pred), symbol
    if kind == YOU_ARE:
        return (0, NEAR, NEAR), symbol
    if kind == COPULA:
        return (0, cop, NEAR if state[1] else pred), symbol
    return ((0, cop, 0) if kind == PREPOSITION else (voc, cop, pred)), symbol


FACTORS = {"reported": 0.5, "negated": 0.3}
UNAIMED, AIMED_AT, THREATENED = 0.53, 1.5, 2.0  # it takes two unaimed insults in one clause


def _score(state, symbol):
    """The weighted acceptor: weight of a symbol and the name of what matched."""
    kind, marks = symbol
    aimed = "aimed" in marks
    weight = THREATENED if kind == THREAT else AIMED_AT if aimed and kind in (INSULT, LOOSE) else UNAIMED if kind == INSULT else 0.0
    for m in marks:
        weight *= FACTORS.get(m, 1.0)
    return state, (weight, "+".join((("threat" if kind == THREAT else "insult"), *marks)) if weight else "")


PARTS = [Transducer(0, _reported), Transducer(0, _negated), Transducer((0, (), 0), _threat), Transducer((0, 0, 0), _target), Transducer(0, _score)]
GRAMMAR = Tabulated(PARTS[0] @ PARTS[1] @ PARTS[2] @ PARTS[3] @ PARTS[4])


def clause_score(classes: Iterable[int], weights: Sequence[float] | None = None) -> tuple[float, float, list[str]]:
    """Score of one clause, the weight of its plain unaimed insults, and the names of its matches; ``weights`` scales what its words add."""
    state, total, loose, names = 0, 0.0, 0.0, []
    for k, c in enumerate(classes):
        state, (weight, name) = GRAMMAR(state, c)
        if weight:
            w = weights[k] if weights is not None else 1.0
            total += weight * w
            loose += w if name == "insult" else 0.0
            names.append(name)
    return total, loose, names


class Scorer:
    """Scores texts; finds the clauses that hold a possible match by one Aho-Corasick pass.

    ``words`` and ``stems`` are learned insults with their weights; a stem stands for all words that begin with it.
    """

    def __init__(self, words: dict[str, float] | None = None, stems: dict[str, float] | None = None) -> None:
        # what labels show to be an insult is one, even if the seed has it as loose
        self.lexicon = {w: (c, 1.0) for w, c in CLASSES.items()} | {w: (INSULT, x) for w, x in (words or {}).items() if CLASSES.get(w, LOOSE) == LOOSE}
        self.stems = {w: (INSULT, x) for w, x in (stems or {}).items()}
        self.seek = ahocorasick.Automaton()
        for w in [*(w for w, (c, _) in self.lexicon.items() if c in HITS), *self.stems]:
            self.seek.add_word(w, len(w))
        self.seek.make_automaton()

    def classify(self, word: str) -> tuple[int, float]:
        if found := self.lexicon.get(word):
            return found
        if self.stems:
            for n in STEM:
                if found := self.stems.get(word[:n]):
                    return found
        return OTHER, 1.0

    def __call__(self, text: str | None) -> tuple[float, int, str]:
        """Score, matched clauses, and kinds of match; (0, 0, "") for null and empty texts."""
        if not text:
            return 0.0, 0, ""
        low = text.lower().replace("’", "'")
        done, best, loose, holding, clauses, kinds = -1, 0.0, 0.0, 0, 0, set()
        for at, n in self.seek.iter(low):
            a = at - n + 1
            if at <= done or (a and (low[a - 1].isalnum() or low[a - 1] == "_")):
                continue
            if at + 1 < len(low) and (low[at + 1].isalnum() or low[at + 1] == "_") and low[a : at + 1] not in self.stems:
                continue
            begin = max(low.rfind(x, done + 1, a) for x in ".!?;\n") + 1
            begin = max(begin, done + 1)
            end = m.start() if (m := BREAK.search(low, at)) else len(low)
            known = [self.classify(w) for w in tokens(low[begin:end])]
            score, plain, names = clause_score([c for c, _ in known], [x for _, x in known])
            done = end
            if score:
                clauses += 1
                best = max(best, score)
                loose += plain
                holding += plain > 0
                kinds.update(names)
        if holding > 1:
            whole = sum(bool(c.strip()) for c in BREAK.split(low))
            best = max(best, loose / ENOUGH * min(1.0, loose / (DENSITY * whole)))
        return round(best, 6), clauses, " ".join(sorted(kinds))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, context, toxic) of each labelled document's different words; the context is of the word's first place."""
    for b in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
        words, contexts, toxic = [], [], []
        for text, t in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            ws = tokens((text or "").lower().replace("’", "'"))
            first: dict[str, int] = {}
            for k, w in enumerate(ws):
                first.setdefault(w, k)
            for w, k in first.items():
                words.append(w)
                contexts.append(f"{ws[k - 1] if k else ''} {ws[k + 1] if k + 1 < len(ws) else ''}")
            toxic += [t] * len(first)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(contexts, pa.string()), pa.array(toxic, pa.int32())], ["word", "context", "toxic"])


def _bound(t: int, c: int) -> float:
    """Wilson's lower bound (95 %) of t of t + c."""
    n, z = t + c, 1.96
    return (t / n + z * z / (2 * n) - z * ((t / n * c / n + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)


def _weight(t: int, c: int) -> float:
    """1 for words that are surely toxic; of rarer ones it takes two to reach the threshold."""
    return round(min(1.0, max(0.5, 2.2 * (_bound(t, c) - 0.5))), 3)


def learned_words(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings that appear, in different contexts, nearly only in documents labelled toxic.

    At most ``sample`` labelled documents are read for it, those whose ids have the smallest hashes, so that the list of
    ids is small enough to broadcast and the words small enough to collect. A word's context in a document is that of its
    first place; contexts count instead of documents, so that copies of one text count once.
    """
    some = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = some.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(quoted(id_col).alias("__id"), quoted(text_col).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(some), "__id").select("text", "toxic")
    seen = texts.mapInArrow(_contexts, "word string, context string, toxic int")
    by_context = seen.groupBy("word", "context").agg(F.max("toxic").alias("t"), F.min("toxic").alias("c"))
    by_word = by_context.groupBy("word").agg(F.sum("t").alias("t"), F.sum(1 - F.col("c")).alias("c"))
    parts = F.array(F.lit(0), *[F.when(F.length("word") >= n, F.lit(n)) for n in STEM])
    by_part = (
        by_word.select(F.explode(F.array_compact(parts)).alias("n"), "word", "t", "c")
        .groupBy(F.when(F.col("n") == 0, F.col("word")).otherwise(F.expr("left(word, n)")).alias("word"), (F.col("n") > 0).alias("stem"))
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum((F.col("t") > 0).cast("int")).alias("words"))
        .where((F.col("t") >= MIN_CONTEXTS) & (F.col("t") / (F.col("t") + F.col("c")) >= MIN_PRECISION) & (F.length("word") > 1))
    )
    words, stems = {}, {}
    for r in sorted(by_part.collect(), key=lambda r: (len(r.word), r.word)):
        if not r.stem:
            words[r.word] = _weight(r.t, r.c)
        elif r.words >= STEM_WORDS and _bound(r.t, r.c) >= STEM_BOUND and not any(r.word[:n] in stems for n in STEM):
            stems[r.word] = _weight(r.t, r.c)
    return words, stems


def toxicity(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``tox_score``, ``tox_clauses``, ``tox_kinds`` and ``toxic`` (they replace columns so named).

    The score is that of the text's highest clause, or what the density of unaimed insults comes to if that is more;
    ``toxic`` is score >= threshold. Null and empty texts score 0; a text of any length is scored whole, in proportion to
    its length. Columns of any name stay as they are.
    Rows are scored one by one: ties, repeated rows and null ids change nothing. Labels without id or label are ignored,
    repeated ones count once; without labels the seed lexicon is used alone. Empty tables give empty tables.
    """
    words, stems = learned_words(docs, labels, id_col=id_col, text_col=text_col, sample=sample) if labels is not None else ({}, {})
    held: list[Scorer] = []

    def score(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(words, stems))
        rows = [held[0](t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["score", "clauses", "kinds"])

    udf = F.arrow_udf(score, "score double, clauses int, kinds string").asNondeterministic()  # so that a filter doesn't run it twice
    scored = packed(docs).select("row", udf(of_row(text_col)).alias("tox"))
    new = {"tox_score": F.col("tox.score"), "tox_clauses": F.col("tox.clauses"), "tox_kinds": F.col("tox.kinds"), "toxic": F.col("tox.score") >= threshold}
    return unpacked(scored, docs.columns, new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).drop("text")
