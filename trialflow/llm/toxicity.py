"""Toxicity: a learned lexicon, matched with spelling errors, and scores of each hit's context."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialflow.llm import text as tx
from trialflow.session import stage

#: Labelled documents that the lexicon and the weights are fitted on at most, those with the smallest hash.
MAX_TRAINING_ROWS = 20_000
#: A term is in so many toxic training documents at least, however many there are ...
MIN_TOXIC = 3
#: ... and its odds among toxic documents are so many times those among the others. Both must also
#: be more than the most that as many words would show by chance (see ``_told_apart``).
MIN_ODDS = 20.0
#: Odds from which a word near a hit counts, and hits that it is near at least.
MIN_CONTEXT_ODDS, MIN_CONTEXT = 2.0, 5
#: Letters of a term from which one and two spelling errors are allowed.
ONE_ERROR, TWO_ERRORS = 5, 9
#: Words before and after a hit that make up its context.
CONTEXT = 6
#: Words that a task remembers the outcome of at once.
_REMEMBERED = 200_000
_QUOTES = "\"'“”„«»‘’‹›`"
_OPEN, _CLOSE = "\"“„«‘‹`'", "\"”“»’›`'"
_EDGES = ".,;:!?()[]{}<>*#$%&@~^_=+|/\\-" + _QUOTES
FEATURES = ("exact", "near", "quoted", "context", "any", "two", "density", "terms", "strength")


class TermAutomaton:
    """The Levenshtein automata of all terms, run along the lexicon's trie as one deterministic automaton.

    A state is a set of (trie node, errors so far); transitions are worked out when first taken.
    Characters that no term has share one transition, so the automaton is finite and small.
    """

    def __init__(self, terms: list[str]) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]
        for term in terms:
            allowed = (len(term) >= ONE_ERROR) + (len(term) >= TWO_ERRORS)
            at = 0
            self.most[0] = max(self.most[0], allowed)
            for ch in term:
                if ch not in self.child[at]:
                    self.child[at][ch] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                    self.most.append(0)
                at = self.child[at][ch]
                self.most[at] = max(self.most[at], allowed)
            self.term[at] = term
        self.letters = frozenset("".join(terms))
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.states: list[dict[int, int]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.start = self._state({0: 0})

    def _state(self, found: dict[int, int]) -> int:
        """The state's number; -1 if no term can follow. Letters left out of the word cost no step."""
        todo = list(found.items())
        while todo:
            node, errors = todo.pop()
            if errors > found.get(node, 99):
                continue
            for below in self.child[node].values():
                if errors + 1 <= self.most[below] and errors + 1 < found.get(below, 99):
                    found[below] = errors + 1
                    todo.append((below, errors + 1))
        key = frozenset(found.items())
        if not found:
            return -1
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(found)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in found.items() if self.term[n] and e <= (len(self.term[n]) >= ONE_ERROR) + (len(self.term[n]) >= TWO_ERRORS)]
            self.accepts.append(min(ends, default=None))
        return self.number[key]

    def _move(self, state: int, ch: str) -> int:
        found: dict[int, int] = {}

        def put(node: int, errors: int) -> None:
            if errors <= self.most[node] and errors < found.get(node, 99):
                found[node] = errors

        for node, errors in self.states[state].items():
            put(node, errors + 1)
            for letter, below in self.child[node].items():
                put(below, errors + (letter != ch))
        to = self.moves[state][ch] = self._state(found)
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """(errors, term) of the term nearest to ``word`` within the errors that it allows."""
        state, letters = self.start, self.letters
        for ch in word:
            if state < 0:
                return None
            ch = ch if ch in letters else ""
            to = self.moves[state].get(ch)
            state = self._move(state, ch) if to is None else to
        return self.accepts[state] if state >= 0 else None


@dataclass(frozen=True)
class Lexicon:
    """Terms with their log odds of standing in toxic documents, and words with theirs of standing near a hit there."""

    terms: dict[str, float]
    context: dict[str, float]


class Remembered(dict):
    """Outcome of each word as written: None, or (errors, term)."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon
        self.automaton = TermAutomaton(list(lexicon.terms))

    def __missing__(self, word: str) -> tuple[int, str] | None:
        out = self[word] = self.automaton.match(word.strip(_EDGES))
        return out

    def hits(self, words: list[str]) -> list[tuple[int, tuple[int, str]]]:
        if len(self) > _REMEMBERED:
            self.clear()
        return [(i, h) for i, h in enumerate(map(self.__getitem__, words)) if h]


_LAST: dict[tuple, Remembered] = {}


def remembered(lexicon: Lexicon) -> Remembered:
    """The outcomes for a lexicon; a Python worker keeps those of the last one from task to task."""
    name = (tuple(lexicon.terms.items()), tuple(lexicon.context.items()))
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Remembered(lexicon)
    return _LAST[name]


def _is_quoted(words: list[str], at: int) -> bool:
    """Whether the word stands in quotation marks."""
    own = words[at]
    if own[0] in _OPEN and own.rstrip(".,;:!?")[-1] in _CLOSE and len(own) > 1:
        return True
    before, after = words[max(0, at - CONTEXT) : at], words[at + 1 : at + 1 + CONTEXT]
    opened = own[0] in _OPEN or any(w[0] in _OPEN and not w.rstrip(".,;:!?")[-1:] in tuple(_CLOSE) for w in before)
    closed = own.rstrip(".,;:!?")[-1:] in tuple(_CLOSE) or any(w.rstrip(".,;:!?")[-1:] in tuple(_CLOSE) for w in after)
    return opened and closed


def _around(words: list[str], at: int) -> set[str]:
    """The words around a hit, those before it marked apart from those after it."""
    before, after = words[max(0, at - CONTEXT) : at], words[at + 1 : at + 1 + CONTEXT]
    return {"<" + w.strip(_EDGES) for w in before} | {">" + w.strip(_EDGES) for w in after}


def features(text: str | None, memory: Remembered) -> list[float]:
    """FEATURES of a whole text: hits as written and misspelled, quoted, in what context, how dense and how telling."""
    words = (text or "").lower().split()
    hits = memory.hits(words)
    if not hits:
        return [0.0] * len(FEATURES)
    exact = near = quoted = 0
    context, strength, known = [], 0.0, memory.lexicon
    for i, (errors, term) in hits:
        if _is_quoted(words, i):
            quoted += 1
        else:
            exact, near = exact + (not errors), near + bool(errors)
            strength = max(strength, known.terms[term] / (1 + errors))
        if known.context:
            context.append(sum(known.context.get(w, 0.0) for w in _around(words, i)))
    log = np.log1p
    return [
        float(log(exact)), float(log(near)), float(log(quoted)), float(np.clip(np.mean(context), -6, 6)) if context else 0.0, float(exact + near > 0),
        float(exact >= 2), float(log(1000 * (exact + near) / len(words))), float(log(len({t for _, (e, t) in hits if not e}))), strength,
    ]


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        x = np.c_[(rows - self.mean) / self.scale, np.ones(len(rows))]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit_weights(rows: np.ndarray, toxic: np.ndarray, lexicon: Lexicon, ridge: float = 1.0) -> ToxicityModel:
    """Logistic regression by Newton steps; without rows every score is one half of an unknown."""
    if len(rows) == 0:
        rows, toxic = np.zeros((2, len(FEATURES))), np.array([0.0, 1.0])
    mean, scale = rows.mean(0), rows.std(0)
    scale[scale == 0] = 1
    x = np.c_[(rows - mean) / scale, np.ones(len(rows))]
    w, penalty = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (toxic - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(lexicon, mean, scale, w)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled documents outside the held-out fold, as a written table.

    Of rows that repeat an id one is taken, so that the bound holds.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).dropna()
        .filter(F.crc32(F.col("__id").cast("string")) % 5 != 0).dropDuplicates(["__id"])
        .orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    )
    own = docs.select(F.col("doc_id").alias("__doc"), F.col("text").alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    once = own.groupBy("__id").agg(F.min(F.struct("text", "toxic")).alias("row"))
    return stage(once.select("row.text", "row.toxic"), "toxicity-training")


def _told_apart(counted: DataFrame, bad: int, good: int, min_odds: float) -> DataFrame:
    """(word, log_odds) of (word, t, c): words of ``bad`` toxic and ``good`` other texts that tell one from the other.

    The evidence is twice the log ratio of likelihoods with and without a difference. Of n words without
    any, the largest is about 2 ln n; a word needs more.
    """
    t, c = F.col("t"), F.col("c")
    min_evidence = 2 * np.log(max(counted.count(), 1))
    odds = ((t + 0.5) / (bad - t + 0.5)) / ((c + 0.5) / (good - c + 0.5))
    every = bad + good

    def part(seen, of):
        """Seen documents times the log of how many times the expected number that is."""
        return F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)

    def likelihood(seen, size):
        share = (t + c) / every
        return part(seen, size * share) + part(size - seen, size * (1 - share))

    evidence = 2 * (likelihood(t, F.lit(float(bad))) + likelihood(c, F.lit(float(good))))
    told = counted.withColumns({"log_odds": F.log(odds), "evidence": evidence})
    return told.filter((F.abs("log_odds") >= np.log(min_odds)) & (F.col("evidence") >= min_evidence)).select("word", "log_odds", "t", "c")


def _counted_words(training: DataFrame, words_of) -> DataFrame:
    """(word, t, c): how often ``words_of`` finds a word in toxic and in other documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = words_of()
        for batch in batches:
            for piece, _, _ in tx.pieces(batch):
                n = (Counter(), Counter())
                for text, toxic in zip(piece.column("text").to_pylist(), piece.column("toxic").to_pylist()):
                    n[toxic == 1].update(found((text or "").lower().split()))
                for toxic in (0, 1):
                    yield pa.RecordBatch.from_arrays([pa.array(list(n[toxic]), pa.string()), pa.array(list(n[toxic].values()), pa.int64()), pa.array([toxic] * len(n[toxic]), pa.int32())], ["word", "n", "toxic"])

    by_word = training.mapInArrow(count, "word string, n long, toxic int").groupBy("word")
    of = lambda kind: F.sum(F.when(F.col("toxic") == kind, F.col("n")).otherwise(0))
    return by_word.agg(of(1).alias("t"), of(0).alias("c"))


def learn_lexicon(training: DataFrame) -> Lexicon:
    """The words whose presence tells toxic documents from others, and the words whose presence near a hit does.

    Support and evidence are absolute: a language or a term that few documents have is told by as
    many documents in a large sample as in a small one. The sample bounds both lists.
    """
    sizes = {r["toxic"] == 1: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        return Lexicon({}, {})
    words = _counted_words(training, lambda: lambda words: {s for w in words if len(s := w.strip(_EDGES)) >= 3})
    words = stage(words.filter(F.col("t") >= MIN_TOXIC), "toxicity-words")
    telling = _told_apart(words, bad, good, MIN_ODDS).filter("log_odds > 0")
    terms = {r["word"]: r["log_odds"] for r in telling.orderBy("word").collect()}

    def near_hits():
        memory = remembered(Lexicon(terms, {}))
        # A hit is a word of its own here, so that hits are counted too.
        return lambda words: [w for i, _ in memory.hits(words) for w in {"", *_around(words, i)}]

    near = stage(_counted_words(training, near_hits), "toxicity-context")
    hit = near.filter("word = ''").first()
    if hit is None or not hit["t"] or not hit["c"]:
        return Lexicon(terms, {})
    around = near.filter("length(word) > 1").filter(F.col("t") + F.col("c") >= MIN_CONTEXT)
    told = _told_apart(around, hit["t"], hit["c"], MIN_CONTEXT_ODDS)
    return Lexicon(terms, {r["word"]: float(np.clip(r["log_odds"], -3, 3)) for r in told.orderBy("word").collect()})


def _features_of(piece: pa.RecordBatch, memory: Remembered, text_col: str) -> np.ndarray:
    return np.array([features(t, memory) for t in piece.column(text_col).to_pylist()]).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> ToxicityModel:
    """Lexicon and weights from ``labels`` (doc_id, toxic), never from the fold crc32(doc_id) mod 5 = 0.

    Only texts enter a score. Labels that are NULL or whose document is missing are not used; without
    labels the lexicon is empty and every score is the same.
    """
    training = training_rows(docs, labels, max_rows)
    lexicon = learn_lexicon(training)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = remembered(lexicon)
        for batch in batches:
            for piece, _, _ in tx.pieces(batch):
                yield pa.RecordBatch.from_arrays([pa.array(_features_of(piece, memory, "text").tolist(), pa.list_(pa.float64())), piece.column("toxic")], ["x", "toxic"])

    rows = training.mapInArrow(extract, "x array<double>, toxic int").collect()
    return fit_weights(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([float(r["toxic"] == 1) for r in rows]), lexicon)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), hits (exact, misspelled, quoted: logs of counts).

    NULL and empty texts have the score of a text without hits; repeated rows repeat; a text of any
    length is scored whole; columns other than the named are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = remembered(model.lexicon)
        for batch in batches:
            for piece, _, _ in tx.pieces(batch):
                x = _features_of(piece, memory, "text")
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(model.scores(x)), *[pa.array(x[:, k]) for k in range(3)]], ["doc_id", "score", "exact", "near", "quoted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(rate, f"doc_id {kind}, score double, exact double, near double, quoted double")


def not_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is under ``limit``, all columns kept; nothing is shuffled."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = remembered(model.lexicon)
        for batch in batches:
            for piece, _, _ in tx.pieces(batch, text_col):
                yield piece.filter(pa.array(model.scores(_features_of(piece, memory, text_col)) < limit))

    return docs.mapInArrow(keep, docs.schema)
