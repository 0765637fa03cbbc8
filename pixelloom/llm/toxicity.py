"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols (insult, threat verb, addressee, other target, copula, modal, negator, report verb).  Five
transducers read the symbols of a clause, each what the one before has written:

    negation     marks insults and threats within reach of a negator
    report       marks those after a report verb, until the clause ends
    target       marks insults that are said of somebody
    insult       counts insults, and those that somebody is called after the word
    threat       tells announced threats from talk of violence, and to whom they are said

They are composed into one machine before use.  Arcs carry weights, which add up along the path of a clause: the same
word weighs little alone, much when it is said of somebody, and next to nothing when it is negated or reported.  A
quotation that a report verb follows is reported too.  A document's features are how often each weighted arc is taken;
a logistic model, whose prior weights are those of the grammar, is fitted on a bounded sample of labelled rows.
Besides the written word list, words that occur in labelled toxic documents and hardly elsewhere, by a lower bound of
that share, join the insults; there is no cap on them.

Learning and scoring read the same plain form of a text: lower case, typographic quotation marks, apostrophes, dashes
and sentence marks as their ASCII forms, other signs as spaces.  Words are the runs of what is left, of any length.

Scoring is map-only.  Null, empty and wordless texts take no arcs and have the base score.  Repeated rows are scored
each, rows with a null doc_id too; of a doc_id with several texts, the smallest is learned from.  Other columns,
whatever their names, are never read for the score and pass through :func:`reject_toxic` unchanged.  Texts of any
length are read whole; an empty table gives no rows, and without labels the grammar's own weights are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import logistic
from pixelloom.llm import text as T

#: Labelled rows that the weights and the learned words are fitted on, at most.
TRAIN_ROWS = 20_000
#: A word is learned as an insult when the share of toxic documents among those that hold it is so high: a lower bound, at so many deviations.
LEARN_PRECISION, LEARN_Z = 0.75, 2.0
#: Words between two symbols beyond which they no longer belong together.
NEAR = 3

# The word lists of the grammar.
LEXICON = {
    "insult": "idiot idiots moron morons stupid dumb loser losers scum trash garbage clown clowns worthless pathetic disgusting imbecile imbeciles cretin dimwit halfwit nitwit fool fools scumbag scumbags dirtbag lowlife vermin filth filthy pig pigs parasite parasites subhuman degenerate degenerates freak freaks creep creeps jerk jerks bastard bastards bitch bitches whore whores slut sluts asshole assholes dickhead shithead moronic idiotic retard retarded brainless spineless gutless repulsive vile despicable contemptible hypocrite liar liars coward cowards blockhead dunce dullard simpleton numbskull bonehead knucklehead airhead nobody's-fool wretch wretches rat rats snake snakes leech leeches maggot maggots cockroach cockroaches swine weasel weasels sleazebag scoundrel crook crooks traitor traitors thug thugs monster monsters pervert perverts psycho lunatic nutjob crackpot quack fraud frauds phony charlatan sissy wimp pussy cunt cunts twat prick pricks dick wanker tosser arsehole shit shitty crap crappy bollocks idiota estúpido estúpida imbécil pendejo cabrón gilipollas idiote imbécile connard connasse salaud abruti crétin débile dummkopf idioten arschloch abschaum dreckskerl miststück trottel vollidiot",
    "threat": "kill murder hurt beat stab shoot strangle punch destroy crush slaughter hang burn rape torture smash hunt drown poison behead cripple maim choke gut skin bash bury",
    "you": "you you're youre u ya yourself yourselves du ihr dich euch tu vous toi tú vosotros usted",
    "target": "he she they them him her his their he's she's they're people guys ones everyone",
    "copula": "are is was were be being am re sind ist est son es bist sei seid êtes eres",
    "first": "i we someone somebody ich wir je nous yo",
    "announcer": "i'll we'll i'm-going ill",
    "modal": "will shall should gonna must can could ought would want wants going werde werden vais voy",
    "negator": "not never no isn't aren't wasn't weren't don't doesn't didn't won't can't cannot wouldn't ain't nobody neither nor without nicht kein keine pas nunca jamais",
    "report": "said says say saying call called calls calling wrote writes quoted quotes claimed claims alleged reported testified shouted yelled sagte dit dijo",
}
SYMBOLS = ("other", *LEXICON)
#: Weighted arcs and their log-odds before any label is seen; the last weight is the intercept.
ARCS = ("insult", "aimed", "negated", "reported", "violence", "threat", "to someone")
PRIOR = np.array([1.6, 3.0, -3.5, -3.0, 0.6, 3.2, 1.5, -3.0])


@dataclass
class Transducer:
    """arcs: (state, input) -> (next state, output, weight's name or None).

    An input without an arc is passed on as it is; it keeps the state if it is in ``keeps``, else returns to the start.
    Marks follow a symbol after dots; ``keeps`` holds bare symbols.
    """

    arcs: dict[tuple[str, str], tuple[str, str, str | None]]
    start: str = "0"
    keeps: frozenset[str] = field(default_factory=frozenset)

    def step(self, state: str, symbol: str) -> tuple[str, str, str | None]:
        if arc := self.arcs.get((state, symbol)):
            return arc
        return (state if symbol.split(".")[0] in self.keeps else self.start), symbol, None


def _marked(symbol: str, marks: Sequence[str]) -> list[str]:
    """The symbol with every combination of the marks that machines before may have set, in their order."""
    out = [symbol]
    for mark in marks:
        out += [f"{x}.{mark}" for x in out]
    return out


def _negation() -> Transducer:
    arcs = {(state, "negator"): ("negated", "negator", None) for state in ("0", "negated")}
    arcs |= {("negated", x): ("negated", f"{x}.negated", "negated") for x in ("insult", "threat")}
    return Transducer(arcs, keeps=frozenset({"copula", "modal", "first", "target", "you", "announcer"}))


def _report() -> Transducer:
    arcs: dict = {("0", "report"): ("reported", "report", None)}
    for symbol in (*SYMBOLS, "gap"):  # the clause stays reported to its end
        for x in _marked(symbol, ["negated"]) if symbol in ("insult", "threat") else [symbol]:
            arcs["reported", x] = ("reported", f"{x}.reported", "reported") if symbol in ("insult", "threat") else ("reported", x, None)
    return Transducer(arcs)


def _target() -> Transducer:
    arcs: dict = {}
    for state in ("0", "you", "other", "is"):
        arcs[state, "you"] = ("you", "you", None)
        arcs[state, "target"] = ("other", "target", None)
    for state in ("you", "other", "is"):
        arcs[state, "copula"] = ("is", "copula", None)
    for state in ("you", "is"):
        arcs |= {(state, x): (state, f"{x}.aimed", "aimed") for x in _marked("insult", ["negated", "reported"])}
    return Transducer(arcs, keeps=frozenset({"modal", "negator", "insult"}))


def _insult() -> Transducer:
    arcs: dict = {}
    for x in _marked("insult", ["negated", "reported", "aimed"]):
        arcs["0", x] = arcs["called", x] = ("called" if x == "insult" else "0", x, "insult")
    arcs["called", "you"] = ("0", "you", "aimed")
    return Transducer(arcs)


def _threat() -> Transducer:
    arcs: dict = {}
    for state in ("0", "first", "will", "said"):
        arcs[state, "first"] = ("first", "first", None)
        arcs[state, "announcer"] = ("will", "announcer", None)
        for x in _marked("threat", ["negated", "reported"]):
            announced = state == "will" and x == "threat"
            arcs[state, x] = ("said" if announced else "0", x, "threat" if announced else "violence")
    arcs["first", "modal"] = arcs["will", "modal"] = ("will", "modal", None)
    arcs["said", "you"], arcs["said", "target"] = ("0", "you", "to someone"), ("0", "target", "to someone")
    return Transducer(arcs, keeps=frozenset({"copula", "negator"}))


def cascade() -> list[Transducer]:
    return [_negation(), _report(), _target(), _insult(), _threat()]


def compose(machines: list[Transducer], alphabet: Sequence[str]) -> dict[tuple, dict[str, tuple[tuple, tuple[str, ...]]]]:
    """One machine of the cascade: state -> input -> (next state, weighted arcs taken)."""
    table: dict = {}
    todo = [tuple(m.start for m in machines)]
    while todo:
        if (states := todo.pop()) in table:
            continue
        table[states] = {}
        for symbol in alphabet:
            after, taken, x = [], [], symbol
            for machine, state in zip(machines, states, strict=True):
                state, x, weight = machine.step(state, x)
                after.append(state)
                taken += [weight] if weight else []
            table[states][symbol] = (tuple(after), tuple(taken))
            todo.append(tuple(after))
    return table


class Grammar:
    """Counts weighted arcs that the words of a slice take."""

    def __init__(self, learned: Sequence[str] = ()):
        codes: dict[int, int] = {}
        for code, name in enumerate(SYMBOLS):
            for word in LEXICON.get(name, "").split():
                for form in {word, word.replace("'", "\u2019")}:
                    codes.setdefault(T.hash_word(form), code)
        for word in learned:
            codes.setdefault(T.hash_word(word), SYMBOLS.index("insult"))
        order = sorted(codes)
        self.hashes, self.codes = np.array(order, np.uint64), np.array([codes[h] for h in order], np.int8)
        self.bits = np.zeros(1 << 16, bool)
        self.bits[self.hashes >> np.uint64(48)] = True
        self.machine = compose(cascade(), [*SYMBOLS, "gap"])
        self.start = tuple(m.start for m in cascade())

    def symbols(self, w: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions and codes of the words that have a symbol."""
        at = np.flatnonzero(self.bits[w.hash >> np.uint64(48)])
        found = np.minimum(np.searchsorted(self.hashes, w.hash[at]), len(self.hashes) - 1)
        hit = self.hashes[found] == w.hash[at]
        return at[hit], self.codes[found[hit]]

    def arcs(self, w: T.Words, raw: np.ndarray, n_docs: int) -> np.ndarray:
        """Counts by document and weighted arc."""
        out = np.zeros((n_docs, len(ARCS)), np.int32)
        at, code = self.symbols(w)
        wanted = (code == _INSULT) | (code == _THREAT)
        if not wanted.any():
            return out
        ends, quotes = (np.cumsum(kind[raw], dtype=np.int64)[w.start[at]] for kind in (_ENDS_CLAUSE, _QUOTES))
        doc = np.searchsorted(w.first, at, "right") - 1
        clause = ends * np.int64(n_docs + 1) + doc
        live = np.isin(clause, clause[wanted]) | (code == _REPORT)
        last, state, before, said, said_at, said_quotes = None, self.start, 0, 0, -NEAR, 0
        for p, c, k, d, q in zip(*(x[live].tolist() for x in (at, code, clause, doc, quotes)), strict=True):
            if k != last:
                last, state = k, self.start
                # a report verb soon after the closing quotation mark
                if c == _REPORT and said and p - said_at <= NEAR and q > said_quotes and q % 2 == 0:
                    out[d, _ARC["reported"]] += said
                said = 0
            elif p - before > NEAR:
                state = self.machine[state]["gap"][0]
            before = p
            state, taken = self.machine[state][SYMBOLS[c]]
            for name in taken:
                out[d, _ARC[name]] += 1
            if (c == _INSULT or c == _THREAT) and "reported" not in taken and "negated" not in taken:
                said, said_at, said_quotes = said + 1, p, q
        return out


_ARC = {name: i for i, name in enumerate(ARCS)}
_INSULT, _THREAT, _REPORT = (SYMBOLS.index(x) for x in ("insult", "threat", "report"))
_ENDS_CLAUSE, _QUOTES = np.zeros(256, bool), np.zeros(256, bool)
_ENDS_CLAUSE[list(b".!?;:,()\"\n\r|")] = True
_QUOTES[ord('"')] = True


#: Signs and their ASCII forms, by regular expression; the last takes all that is neither letter, mark nor digit.
_PLAIN = (("[“”„‟«»〝〞「」『』]", '"'), ("[‘’‚‛‹›]", "'"), ("[‐‑‒–—―]", "-"), ("…", "..."), ("[。！？；：؟]", "."), (r"[^\x00-\x7F\p{L}\p{M}\p{N}]", " "))
_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+(?:'[0-9a-z\x{80}-\x{10FFFF}]+)*"


def plain(column: pa.Array) -> pa.Array:
    column = pc.utf8_lower(column)
    for signs, ascii_form in _PLAIN:
        column = pc.replace_substring_regex(column, signs, ascii_form)
    return column


def batch_features(grammar: Grammar, column: pa.Array) -> np.ndarray:
    """log2(1 + count) by row and weighted arc."""
    out = np.zeros((len(column), len(ARCS)))
    for row, end, offsets, raw in T.slices(plain(column)):
        w = T.words(offsets, raw, T.ALNUM, fold_latin=True, apostrophes=True)
        out[row:end] = np.log2(1 + grammar.arcs(w, raw, end - row))
    return out


@dataclass
class Model:
    learned: list[str]
    weights: np.ndarray

    def scorer(self) -> Callable[[pa.Array], np.ndarray]:
        grammar = Grammar(self.learned)
        return lambda column: logistic.predict(batch_features(grammar, column), self.weights)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Fit on labelled (doc_id, toxic) rows; pass only those that may be learned from."""
    ids = logistic.sample_ids(labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")), limit)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def as_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([plain(batch.column("text")), batch.column("toxic")], ["text", "toxic"])

    plain_rows = rows.select("text", "toxic").mapInArrow(as_plain, "text string, toxic int")
    bag = plain_rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))).alias("word"))
    counted = bag.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    mean = (F.col("t") + 0.5) / (F.col("n") + 1)
    low = mean - LEARN_Z * F.sqrt(mean * (1 - mean) / (F.col("n") + 2))
    learned = sorted(r["word"] for r in counted.where(low >= LEARN_PRECISION).select("word").collect())  # at most the words of the sample's toxic texts
    grammar = Grammar(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(batch_features(grammar, batch.column("text"))), pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    found = rows.mapInArrow(run, "x array<double>, toxic int").toArrow()
    x = np.array(found["x"].to_pylist()).reshape(-1, len(ARCS))
    return Model(learned, logistic.fit(x, found["toxic"].to_numpy().astype(float), PRIOR))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer(batch.column("text")))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column("text").cast(pa.string())) < threshold))

    return docs.mapInArrow(run, docs.schema)
