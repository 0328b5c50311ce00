"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, verb of reporting, other. Five transducers are composed, each reading what
the one before it writes: negation marks insults and threats in its reach, reported speech those after its verb,
a target the insults after it, threat turns a verb and its target into one symbol, and insult gives
insults and threats their weights, by the marks on them. The composition is built once as one table, (state, symbol) to
(state, weight), and clauses run through it side by side as arrays. What a clause comes to is kept by what it does with its insults: it aims them at
somebody, leaves them bare, or denies or reports them. A text's score is a logistic function of these sums over its matched clauses, so
what each mark is worth is fitted on labelled rows. Insult words beyond the listed ones are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Word lists for English, German, French and Spanish; an insult's number is its weight.
INSULTS = dict.fromkeys("idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns imbecile dumb vermin filth dummkopf abschaum connard imbécile ordure estúpido imbécil basura".split(), 3.0)
THREATS = set("kill hurt destroy beat burn hang shoot attack crush töten umbringen vernichten schlagen tuer détruire frapper matar destruir golpear".split())
TARGETS = set("you your yours they them their these those he she him her du dich dir dein ihr euch sie tu toi te vous ton ils elles tú ti usted ustedes vosotros ellos ellas".split())
NEGATIONS = set("not never no isn't aren't don't doesn't cannot nicht kein keine nie niemals pas jamais aucun nunca jamás ningún tampoco".split())
REPORTS = set("said says wrote called calls quoted reported claimed alleged sagte schrieb nannte berichtete dit écrit rapporté appelé dijo escribió llamó informó".split())

CLAUSE = re.compile(r"[.!?;:\n]+")
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Words over which a negation reaches; a target reaches twice as far, which is the longest memory but that of reported speech.
REACH = 3
KINDS = "-ITGNR"  # other, insult, threat, target, negation, report
ROLES = {**dict.fromkeys(REPORTS, 5), **dict.fromkeys(NEGATIONS, 4), **dict.fromkeys(TARGETS, 3), **dict.fromkeys(THREATS, 2)}
#: Weights of marks (n negated, r reported, a aimed at a target) and of a threat with its target.
WEIGHTS = {"n": 0.3, "r": 0.5, "a": 1.5, "H": 4.0}

# -- transducers: (state, symbol) -> (next state, symbol); a symbol is a kind and the marks on it -----


def negation(left: int, symbol: str) -> tuple[int, str]:
    """State: words left over which a negation still reaches."""
    if symbol == "N":
        return REACH, symbol
    return max(0, left - 1), symbol + "n" if left and symbol[0] in "IT" else symbol


def reported(told: int, symbol: str) -> tuple[int, str]:
    """State: whether the clause has had a verb of reporting."""
    return int(told or symbol == "R"), symbol + "r" if told and symbol[0] in "IT" else symbol


def target(left: int, symbol: str) -> tuple[int, str]:
    """State: words left in which an insult is aimed at the last target."""
    if symbol == "G":
        return 2 * REACH, symbol
    return max(0, left - 1), symbol + "a" if left and symbol[0] == "I" else symbol


def threat(state: tuple[int, str], symbol: str) -> tuple[tuple[int, str], str]:
    """State: words left in which a threat's target may come, and the marks on the threat, which the whole keeps."""
    left, marks = state
    if symbol[0] == "T":
        return (REACH + 1, symbol[1:]), "-"
    if symbol == "G" and left:
        return (0, ""), "H" + marks
    return (left - 1, marks) if left > 1 else (0, ""), symbol


def insult(_: None, symbol: str) -> tuple[None, float]:
    """No state. The weight of an insult (a factor of the word's own) or of a threat."""
    return None, math.prod(WEIGHTS[m] for m in symbol[1:]) * WEIGHTS.get(symbol[0], 1.0) if symbol[0] in "IH" else 0.0


CASCADE = ((negation, 0), (reported, 0), (target, 0), (threat, (0, "")), (insult, None))


def composed(cascade=CASCADE) -> tuple[np.ndarray, np.ndarray]:
    """The composition as two tables over (state, kind): the next state and the weight. State 0 is the start."""
    states = {tuple(start for _, start in cascade): 0}
    following, weights = [], []
    for state in (queue := list(states)):
        row, weight = [], []
        for kind in KINDS:
            new, symbol = [], kind
            for (step, _), part in zip(cascade, state, strict=True):
                part, symbol = step(part, symbol)
                new.append(part)
            if (key := tuple(new)) not in states:
                states[key] = len(states)
                queue.append(key)
            row.append(states[key])
            weight.append(symbol)
        following.append(row)
        weights.append(weight)
    return np.array(following, np.int32), np.array(weights, float)


@dataclass
class Lexicon:
    """Insult words and stems (a stem stands for all words that begin with it), with weights. Words of a role keep it, whatever was learned."""

    words: dict[str, float] = field(default_factory=lambda: dict(INSULTS))
    stems: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        if not found and self.stems:
            found = max((self.stems.get(word[:k], 0.0) for k in sorted({len(x) for x in self.stems})), default=0.0)
        return found

    def automaton(self):
        """Finds where words that may matter begin; clauses without any aren't split into words."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for x in {*self.words, *self.stems, *THREATS}:
            found.add_word(x, len(x))
        found.make_automaton()
        return found


FEATURES = ("log aimed insults", "log bare insults", "log denied or reported insults", "log threats", "log strongest clause", "log matched clauses", "share of clauses matched")


class Scorer:
    """Runs the grammar over texts."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, lexicon.automaton()
        self.following, self.factors = composed()
        self.known: dict[str, tuple[int, float]] = {w: (k, 1.0) for w, k in ROLES.items()}

    def _symbol(self, word: str) -> tuple[int, float]:
        found = self.known.get(word)
        if found is None:
            weight = self.lexicon.weight(word)
            found = (1, weight) if weight else (0, 0.0)
            if len(self.known) < 1 << 18:
                self.known[word] = found
        return found

    def symbols(self, words: Iterable[str]) -> tuple[list[int], list[float]]:
        """Kind and weight of each word. Of a run of other words as many as the longest memory say as much as all of them."""
        kinds, weights, others = [], [], 0
        for word in words:
            kind, weight = self._symbol(word)
            others = 0 if kind else others + 1
            if others <= 2 * REACH:
                kinds.append(kind)
                weights.append(weight)
        return kinds, weights

    def run(self, clauses: list[tuple[list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each clause the weight of its aimed insults, of its bare ones, of those negated or reported, and of its threats."""
        sizes = np.array([len(k) for k, _ in clauses], np.int64)
        order = np.argsort(-sizes, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(sizes)])[:-1][order]
        kinds = np.array([k for c, _ in clauses for k in c], np.int32)
        weights = np.array([w for _, c in clauses for w in c], float)
        state, out = np.zeros(len(clauses), np.int32), np.zeros((4, len(clauses)))
        longest_first = sizes[order]
        for t in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-longest_first, -t, "left"))  # clauses that have a word t
            at = offsets[:n] + t
            kind, got = kinds[at], self.factors[state[:n], kinds[at]]
            insults = kind == 1
            weighed, aimed, bare = got * weights[at], insults & (got == WEIGHTS["a"]), insults & (got == 1.0)
            for k, which in enumerate((aimed, bare, insults & ~aimed & ~bare)):
                out[k, order[:n]] += np.where(which, weighed, 0.0)
            out[3, order[:n]] += np.where(insults, 0.0, got)
            state[:n] = self.following[state[:n], kind]
        return out

    def features(self, texts: list[str], at_once: int = 256) -> np.ndarray:
        """What the score is made of, a row a text; zeros for a text without a matched clause."""
        found = np.zeros((len(texts), len(FEATURES)))
        for k in range(0, len(texts), at_once):
            self._fill(texts[k : k + at_once], found[k : k + at_once])
        return found

    def _fill(self, texts: list[str], found: np.ndarray) -> None:
        clauses, owner, n_clauses = [], [], np.ones(len(texts))
        for i, text in enumerate(texts):
            low = text.lower()
            starts = [s for end, n in self.automaton.iter(low) if not (s := end - n + 1) or not low[s - 1].isalpha()]
            if not starts:
                continue
            edges = [0, *(m.end() for m in CLAUSE.finditer(low)), len(low)]
            n_clauses[i] = len(edges) - 1
            for k in np.unique(np.searchsorted(edges, starts, "right")).tolist():
                clauses.append(self.symbols(m.group() for m in LETTERS.finditer(low, edges[k - 1], edges[min(k, len(edges) - 1)])))
                owner.append(i)
        if not clauses:
            return
        owner = np.array(owner)
        weights = self.run(clauses)
        total, n = weights.sum(0), len(texts)
        strongest = np.zeros(n)
        np.maximum.at(strongest, owner, total)
        matched = np.bincount(owner[total > 0], minlength=n)
        columns = (*(np.bincount(owner, w, n) for w in weights), strongest, matched)
        found[:, :-1] = np.log1p(np.column_stack(columns))
        found[:, -1] = matched / n_clauses


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(text, toxic) of at most `most` labelled doc_ids, not held out, those that hash lowest; so rows are bounded too.

    Rows without doc_id or label are left out; of several labels of one doc_id the highest counts, of several texts that whose
    hash is least. Null texts are empty.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    rows = rows.groupBy(F.col(doc_id).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return written(own.select("text", "toxic"), "labelled")


def learned_lexicon(
    sample: DataFrame, least: int = 6, different: int = 3, odds: float = 3.0, stem_odds: float = 4.0, stem_letters: tuple[int, int] = (4, 7)
) -> Lexicon:
    """Listed words, and words and stems of stem_letters letters that toxic texts of the sample have far more often than others.

    Either must be in `least` toxic texts, a stem also stand for `different` words; odds and stem_odds are least logarithms of how much
    more often. Copies count once, as toxic if any is. What comes to the driver is bounded by the sample alone.
    """
    shortest, longest = stem_letters
    sample = written(sample.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("w", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))), "words")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    lexicon = Lexicon()
    if not bad or not good:
        return lexicon
    words = sample.withColumn("doc", F.monotonically_increasing_id()).select("doc", "toxic", F.explode("w").alias("word"))
    docs = [F.count(F.when(F.col("toxic") == k, 1)).alias(c) for k, c in ((1, "pos"), (0, "neg"))]
    weight = F.log((F.col("pos") + 0.5) / (bad + 1)) - F.log((F.col("neg") + 0.5) / (good + 1))

    def strong(counts: DataFrame, odds: float) -> dict:
        found = counts.withColumn("weight", weight).where((F.col("pos") >= least) & (F.col("weight") >= odds))
        return {r["x"]: r for r in found.orderBy(F.desc("pos"), "x").collect()}

    # a word stands once in a document's list; a stem may come from several words of one document
    by_word = written(words.groupBy(F.col("word").alias("x")).agg(*docs), "word_counts")
    prefixes = F.explode(F.transform(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length("word"))), lambda k: F.substring(F.col("word"), F.lit(1), k))).alias("x")
    several = by_word.withColumnRenamed("x", "word").where(F.length("word") >= shortest).select(prefixes, "pos").groupBy("x").agg(F.count("*").alias("words"), F.sum("pos").alias("all")).where((F.col("words") >= different) & (F.col("all") >= least)).select("x")
    stems = words.where(F.length("word") >= shortest).select("doc", "toxic", prefixes).distinct().join(several, "x", "left_semi").groupBy("x").agg(*docs)
    pure = strong(stems, stem_odds)
    # the longest stem that still stands for nearly all of what its shorter ones stand for
    kept = {x: r for x, r in pure.items() if not any(y[:-1] == x and q["pos"] >= 0.9 * r["pos"] for y, q in pure.items() if len(y) == len(x) + 1)}
    lexicon.stems = {x: float(r["weight"]) for x, r in kept.items() if not any(x[:k] in kept for k in range(shortest, len(x)))}
    lexicon.words |= {x: float(r["weight"]) for x, r in strong(by_word.where(F.length("x") >= 3), odds).items()}
    return lexicon


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 50) -> np.ndarray:
    """Logistic weights (the last is the constant) by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        move = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Learns stems and score weights from at most `most` labelled documents that are not held out (see labelled_sample for
    nulls and ties). Without labels of both kinds, or without documents, the listed words decide."""
    sample = labelled_sample(docs, labels, most, text, doc_id)
    lexicon = learned_lexicon(sample)
    rows = sample.mapInArrow(_features(lexicon), "toxic int, " + ", ".join(f"f{k} double" for k in range(len(FEATURES)))).toPandas()
    y = rows["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        return Model(lexicon, np.array([1.5, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, -1.5]))
    return Model(lexicon, fitted(rows.drop(columns="toxic").to_numpy(float), y))


def _features(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            found = scorer.features(batch.column(0).to_pylist())
            yield pa.record_batch([batch.column(1), *(pa.array(c) for c in found.T)], ["toxic", *(f"f{k}" for k in range(len(FEATURES)))])

    return run


def toxicity(docs: DataFrame, model: Model, score: str = "score", text: str = "text") -> DataFrame:
    """The rows of docs with the score added (0 to 1; a column of that name is replaced, all others stay). Null and empty
    texts are scored as texts without a match, each row of repeated ones for itself; an empty table gives no rows."""
    lexicon, weights = model.lexicon, model.weights

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(lexicon)
        for part in texts:
            x = scorer.features([t or "" for t in part])
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))

    return docs.withColumn(score, F.pandas_udf(run, "double")(F.coalesce(F.col(text), F.lit(""))))
