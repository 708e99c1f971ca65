"""Operator 10: toxicity by a lexicon trie under Levenshtein automata, with context windows that tell quotation from abuse."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, read, release, ship

#: Labelled rows that the lexicon and the weights are learned from, at most (those of the least hashes of their id).
SAMPLE_ROWS = 8000
#: Labelled rows that a task takes.
TASK_ROWS = 400
#: Log odds below which a match counts for nothing: in a long text many weak ones would add up.
LEAST_WEIGHT = 2.0
#: Lengths of stems; a stem matches words that begin with it. Whole words, of any length, have END behind them.
STEMS = (4, 10)
END = "$"
#: Words on either side of a match that its context is read from.
WINDOW = 6
#: Words that report speech rather than use it (fixed values).
REPORTING = frozenset("said says saying called calls quote quoted quotes term word words phrase sagte sagt nannte wort dit mot dijo palabra".split())
#: Coefficients before anything is learned: none, of plain evidence, of quoted evidence.
PRIOR = (-3.0, 2.0, 0.5)
#: States and words that a worker remembers, at most; beyond that it starts afresh, with the same results.
REMEMBERED = 100_000

WORD = re.compile(r"[^\W_]+")
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›"}


def edits_allowed(term: str) -> int:
    """Misspellings of short terms are other words too often."""
    n = len(term.removesuffix(END))
    return 0 if n < 5 else 1 if n < 9 else 2


class LexiconAutomaton:
    """The trie of the terms, intersected with the Levenshtein automata of a word, made deterministic as far as words need it.

    A state is a set of (trie node, edits so far) and the best stem met so far. best(word) is (term number, edits) of
    the term with fewest edits, then the longest, then the first; None if there is none.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.most = [0]
        self.stem: list[int | None] = [None]
        self.word: list[int | None] = [None]
        for i, term in enumerate(terms):
            node, k = 0, edits_allowed(term)
            self.most[0] = max(self.most[0], k)
            for c in term.removesuffix(END):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                    self.stem.append(None)
                    self.word.append(None)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], k)
            if term.endswith(END):
                self.word[node] = i
            else:
                self.stem[node] = i
        self._reset()

    def _reset(self) -> None:
        self.states: dict = {}
        self.sets: list = []
        self.steps: list[dict[str, int]] = []
        self.ends: list = []
        self.start = self._state({0: 0}, None)

    def _better(self, a, b):
        if a is None or b is None:
            return a or b
        rank = lambda x: (x[1], -len(self.terms[x[0]]), x[0])
        return min(a, b, key=rank)

    def _state(self, edits: dict[int, int], best) -> int:
        # A letter of the term may be missing from the word: go down without reading.
        todo = list(edits.items())
        while todo:
            node, e = todo.pop()
            if edits.get(node, 9) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < edits.get(child, 9):
                    edits[child] = e + 1
                    todo.append((child, e + 1))
        for node, e in edits.items():
            i = self.stem[node]
            if i is not None and e <= edits_allowed(self.terms[i]):
                best = self._better(best, (i, e))
        key = (frozenset(edits.items()), best)
        if key not in self.states:
            end = best
            for node, e in edits.items():
                i = self.word[node]
                if i is not None and e <= edits_allowed(self.terms[i]):
                    end = self._better(end, (i, e))
            self.states[key] = len(self.sets)
            self.sets.append((dict(edits), best))
            self.steps.append({})
            self.ends.append(end)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        edits, best = self.sets[state]
        after: dict[int, int] = {}
        for node, e in edits.items():
            for x, child in self.children[node].items():
                cost = e + (x != c)
                if cost <= self.most[child] and cost < after.get(child, 9):
                    after[child] = cost
            if e + 1 <= self.most[node] and e + 1 < after.get(node, 9):
                after[node] = e + 1
        return self._state(after, best)

    def best(self, word: str):
        if len(self.sets) > REMEMBERED:
            self._reset()
        state, steps = self.start, self.steps
        for c in word:
            after = steps[state].get(c)
            if after is None:
                after = steps[state][c] = self._step(state, c)
            state = after
            if not self.sets[state][0]:
                break
        return self.ends[state]


class Matcher:
    def __init__(self, terms: list[str]):
        self.automaton = LexiconAutomaton(terms)
        self.known: dict[str, tuple | None] = {}

    def matches(self, text: str) -> list[tuple[int, bool, bool]]:
        """(term number, misspelled, quoted) of each word that matches the lexicon, in order."""
        lowered = text.lower()
        words = WORD.findall(lowered)
        known, hit = self.known, False
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.automaton.best(w)
            hit = hit or known[w] is not None
        if not hit:
            return []
        out, spans = [], [m.span() for m in WORD.finditer(lowered)]
        for i, w in enumerate(words):
            found = known[w] if w in known else self.automaton.best(w)
            if found:
                near = range(max(0, i - WINDOW), min(len(words), i + WINDOW + 1))
                before = lowered[spans[near[0]][0] : spans[i][0]]
                after = lowered[spans[i][1] : spans[near[-1]][1] + 1]
                out.append((found[0], found[1] > 0, self._quoted(before, after) or any(words[k] in REPORTING for k in near)))
        return out

    @staticmethod
    def _quoted(before: str, after: str) -> bool:
        """An open quotation mark on the left, in the window, and its counterpart on the right."""
        for a, b in QUOTES.items():
            is_open = before.count(a) % 2 == 1 if a == b else before.rfind(a) > before.rfind(b)
            if is_open and b in after:
                return True
        return False


_matchers: dict[bytes, Matcher] = {}


def matcher(terms: list[str]) -> Matcher:
    """One Matcher for each lexicon in a worker."""
    key = hashlib.sha256(pickle.dumps(terms)).digest()
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(terms)
    return _matchers[key]


def evidence(found: list[tuple[int, bool, bool]], weights: dict[tuple[int, bool], float]) -> tuple[float, float]:
    """What the matches in plain and in quoting contexts weigh; each further match of a term counts half the one before."""
    share: dict = defaultdict(lambda: 1.0)
    total = [0.0, 0.0]
    for term, misspelled, quoted in found:
        total[quoted] += weights.get((term, misspelled), 0.0) * share[term, quoted]
        share[term, quoted] /= 2
    return total[0] / 8, total[1] / 8


def score_of(x: tuple[float, float], coefficients: tuple[float, float, float]) -> float:
    z = coefficients[0] + coefficients[1] * x[0] + coefficients[2] * x[1]
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def choose_terms(counts: list[tuple[str, int, int]], base: float, tried: int) -> list[str]:
    """Terms whose counts (term, toxic documents, other documents) chance explains for a few of so many tried at most.

    A chance term costs little, as one match alone is not enough evidence in the fit; a missed one costs a document.

    Of a stem and a longer one with nearly its toxic documents the longer stays; of a stem with many more, and as few others, the shorter.
    """
    need, good = math.log(max(tried, 1)) - 3, {}
    for term, pos, neg in counts:
        p = pos / (pos + neg)
        if pos >= 3 and p > base and p >= 0.8:
            gain = pos * math.log(p / base) + (neg * math.log((1 - p) / (1 - base)) if neg else 0)
            if gain >= need:
                good[term] = (pos, gain, p)
    fuller: dict[str, int] = {}
    for term, (pos, _, _) in good.items():
        for k in range(STEMS[0], len(term)):
            stem = term[:k]
            fuller[stem] = max(fuller.get(stem, 0), pos)
    closed = {t: g for t, g in good.items() if fuller.get(t, 0) < 0.95 * g[0]}
    covered = lambda t: any(closed[t[:k]][2] >= closed[t][2] - 0.01 for k in range(STEMS[0], len(t)) if t[:k] in closed)
    kept = [t for t in closed if not covered(t)]
    return sorted(kept)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; ridge pulls towards a prior in which a quoted match counts a quarter."""
    a = np.column_stack((np.ones(len(x)), x))
    prior = np.array(PRIOR)
    c, pull = prior.copy(), ridge * np.array([0.1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -40, 40)))
        g = a.T @ (p - y) + pull * (c - prior)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(h, g)
        c = c - step * min(1, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in c)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model {terms, weights, coefficients} from labelled documents that are not held out.

    Terms are counted by Spark over the sample. What comes to the driver are the terms that chance does not explain, which the
    sample bounds, and two numbers for each of its rows. Null ids and labels are left out, an id with several labels is toxic if
    one says so. Without a toxic or without a clean row the lexicon is empty and every text has the score of the prior.

    Labelled rows seldom quote, so the weight of a quoted match is learned from examples made of the lexicon, too: for each term
    a clean text that quotes it once.
    """
    spark = docs.sparkSession
    ship(spark)
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    marked = marked.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = keep(texts.join(F.broadcast(marked), "doc_id"), "labelled")
    n, pos = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not pos or pos == n:
        return {"terms": [], "weights": {}, "coefficients": PRIOR}
    tasks, base = -(-n // TASK_ROWS), pos / n

    # Copies of one text are no separate evidence for its words: of texts with the same least shingle hash the first by id counts.
    in_order = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)
    three = lambda w, i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    once = sample.select("doc_id", "toxic", in_order.alias("w")).withColumn("least", F.array_min(F.transform("w", three)))
    once = once.groupBy("toxic", "least").agg(F.min(F.struct("doc_id", "w")).alias("one")).select("toxic", F.col("one.w").alias("w"))
    words = F.array_distinct("w")
    lengths = lambda w: F.filter(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[1])), lambda k: k <= F.length(w))
    cut = lambda w: F.concat(F.transform(lengths(w), lambda k: w.substr(F.lit(1), k)), F.array(F.concat(w, F.lit(END))))
    spread = once.repartition(tasks).select("toxic", F.explode(F.array_distinct(F.flatten(F.transform(words, cut)))).alias("term"))
    counted = keep(spread.groupBy("term").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).where("n >= 3"), "terms")
    tried = counted.count()
    share = F.col("pos") / F.col("n")
    gain = F.col("pos") * F.log(share / base) + F.when(share < 1, (F.col("n") - F.col("pos")) * F.log((1 - share) / (1 - base))).otherwise(0)
    likely = counted.where("pos >= 3").where(share >= 0.8).where(gain >= math.log(max(tried, 1)) - 3 - 1e-6)
    terms = choose_terms([(r.term, r.pos, r.n - r.pos) for r in likely.collect()], base, tried)

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = matcher(terms)
        for frame in frames:
            found = [m.matches(t) for t in frame["text"]]
            yield pd.DataFrame({"toxic": frame["toxic"], "found": list(map(pickle.dumps, found)), "keys": [sorted({2 * t + misspelled for t, misspelled, _ in f}) for f in found]})

    matched = keep(sample.repartition(tasks).mapInPandas(find, "toxic int, found binary, keys array<int>"), "matched")
    by_key = matched.select("toxic", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()
    weight = lambda bad, good: max(0.0, math.log((bad + 0.5) / (pos + 1)) - math.log((good + 0.5) / (n - pos + 1)))
    weights = {(r.key // 2, bool(r.key % 2)): w for r in by_key if (w := weight(r.bad, r.n - r.bad)) >= LEAST_WEIGHT}

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [evidence(pickle.loads(f), weights) for f in frame["found"]]
            yield pd.DataFrame({"toxic": frame["toxic"], "plain": [x for x, _ in both], "quoted": [y for _, y in both]})

    rows = [((r.plain, r.quoted), r.toxic) for r in matched.mapInPandas(weigh, "toxic int, plain double, quoted double").collect()]
    rows += [(evidence([(t, False, True)], weights), 0) for t in range(len(terms)) if (t, False) in weights]
    rows.sort()
    for table in (sample, counted, matched):
        release(table)
    return {"terms": terms, "weights": weights, "coefficients": fit(np.array([x for x, _ in rows]), np.array([y for _, y in rows]))}


def toxic_score(model: dict, text: Column) -> Column:
    """The score of a text, 0 to 1; null texts count as empty."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = matcher(model["terms"])
        for part in parts:
            yield pd.Series([score_of(evidence(m.matches(t or ""), model["weights"]), model["coefficients"]) for t in part], dtype="float64")

    return run(text)


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs, without a shuffle.

    Only the text enters the score. Null, empty and wordless texts have the score of no evidence; a null id is held out of
    nothing (held_out false). Repeated rows have equal scores; empty tables give no rows; further columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), toxic_score(model, F.col("text")).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict = {}
