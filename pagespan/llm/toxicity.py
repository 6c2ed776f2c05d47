"""Toxicity: Levenshtein automata of a learnt lexicon, and a score of each match's context.

1. The lexicon is learnt from labels: words, and stems (prefixes of 4 to 7 letters that many
   words share), that are far likelier in toxic texts. Counts cover all labelled rows that may
   be learnt.
2. Lexicon trie and Levenshtein automata are intersected: a state is a set of (trie node,
   edits so far), made when first met. Terms of 5 letters allow one edit, of 8 two; a swap of
   neighbours is one edit; digits and signs that stand for letters are read as these. Stems
   match exactly. Spellings common in clean texts are exceptions.
3. A match inside quotation marks, or with a word of reporting close before it, counts as
   quotation. A logistic model of matches used, quoted, misspelt, and their density gives the score.
   It is fitted to at most ``TRAIN_ROWS`` labelled texts' features, towards prior weights, so
   that a feature that the sample lacks keeps its prior.

Defined results: null and empty texts have no match and get the score of that; several labels of
one document count each; without labels the lexicon is empty and all scores are equal; repeated
rows get equal scores. labels, lang, source and doc_id are no input of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespan.llm.shared import in_train, sliced, unit_hash, written

TRAIN_ROWS = 20_000
STEMS = (4, 5, 6, 7)
#: A term is in this share of toxic texts at least (and in 3), and so many times likelier in them.
MIN_SHARE, MIN_COUNT, MIN_RATIO = 0.005, 3, 12.0
#: Misspelt forms and words of reporting are told by this share of clean texts at least (and 2, 3 of them), so that their
#: number is bounded by a text's words / MIN_CLEAN, whatever the input's size.
MIN_CLEAN, MIN_REPORTS, REPORT_RATIO = 1e-5, 3, 8.0
#: Words before a term that can report it; tokens that a quotation spans at most.
WINDOW, QUOTATION = 4, 60
CACHE = 300_000
THRESHOLD = 0.7
#: Signs read as letters, quotation marks.
LEET = str.maketrans("013457@$!", "oieastasi")
EDGE = ".,;:!?\"'`()[]{}|#*$%&<>~-_/\\=+^“”„‘’«»…"
QUOTES = "\"“”„«»"
FEATURES = ("any_used", "log_used", "any_quoted", "any_misspelt", "log_misspelt", "density")
PRIOR = np.array([-3.0, 2.5, 1.2, 0.8, 2.0, 1.0, 0.5])  # bias first


def cleaned(token: str) -> str:
    """A lower-cased token as a word: signs cut from its ends, those inside read as letters."""
    word = token.strip(EDGE)
    if word.isalpha():
        return word
    read = (word or token).translate(LEET).strip(EDGE)
    return "".join(c for c in read if c.isalpha())


class Automaton:
    """The lexicon's trie times the Levenshtein automata of its terms, determinised as needed."""

    def __init__(self, words: list[str], stems: list[str], exceptions: set[str] = frozenset()):
        self.next: list[dict[str, int]] = [{}]
        self.word, self.stem, self.allow = [False], [False], [0]
        self.exceptions = exceptions
        for terms, kind in ((words, self.word), (stems, self.stem)):
            for term in terms:
                at, edits = 0, self.edits(term) if kind is self.word else 0
                self.allow[0] = max(self.allow[0], edits)
                for c in term:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        for x in (self.word, self.stem):
                            x.append(False)
                        self.allow.append(0)
                    at = self.next[at][c]
                    self.allow[at] = max(self.allow[at], edits)  # most edits of any term below
                kind[at] = True
        self.bound = {t: self.edits(t) for t in words}
        self.depth = [0] * len(self.next)
        for at, children in enumerate(self.next):
            for to in children.values():
                self.depth[to] = self.depth[at] + 1
        self.start = self.closed({(0, ""): 0})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}

    @staticmethod
    def edits(term: str) -> int:
        return 2 if len(term) >= 8 else 1 if len(term) >= 5 else 0

    def closed(self, state: dict) -> frozenset:
        """With letters of terms left out, one edit each. Keys are (node, letter owed by a swap)."""
        todo = [(n, owed, e) for (n, owed), e in state.items()]
        while todo:
            n, owed, e = todo.pop()
            if owed or e >= self.allow[n]:
                continue
            for to in self.next[n].values():
                if e + 1 <= self.allow[to] and e + 1 < state.get((to, ""), 9):
                    state[to, ""] = e + 1
                    todo.append((to, "", e + 1))
        return frozenset((n, owed, e) for (n, owed), e in state.items())

    def step(self, state: frozenset, c: str) -> frozenset:
        key = (state, c)
        if key not in self.steps:
            out: dict = {}

            def put(n: int, owed: str, e: int) -> None:
                if e <= self.allow[n] and e < out.get((n, owed), 9):
                    out[n, owed] = e

            for n, owed, e in state:
                if owed:
                    if c == owed[0]:
                        put(int(owed[1:]), "", e)
                    continue
                put(n, "", e + 1)  # a letter too much
                for x, to in self.next[n].items():
                    put(to, "", e if x == c else e + 1)
                    if x != c and c in self.next[to]:
                        put(self.next[to][c], f"{x}{self.next[to][c]}", e + 1)  # c before x: x is owed
            if len(self.steps) > CACHE:
                self.steps.clear()
            self.steps[key] = self.closed(out)
        return self.steps[key]

    def match(self, word: str) -> int:
        """0: none, 1: exact word or stem, 2: misspelt."""
        at: int | None = 0
        for c in word:
            at = self.next[at].get(c)
            if at is None:
                break
            if self.stem[at]:
                return 1
        if at and self.word[at]:
            return 1
        if len(word) < 4 or word in self.exceptions:
            return 0
        state = self.start
        for c in word:
            state = self.step(state, c)
            if not state:
                return 0
        return 2 if any(not owed and self.word[n] and e <= (2 if self.depth[n] >= 8 else 1 if self.depth[n] >= 5 else 0) for n, owed, e in state) else 0


class Scorer:
    """Features and scores of texts, with a memory of tokens seen."""

    def __init__(self, words: list[str], stems: list[str], exceptions: set[str], reporting: set[str] = frozenset()):
        self.automaton = Automaton(words, stems, exceptions)
        self.reporting = reporting
        self.seen: set[str] = set()
        self.hits: dict[str, int] = {}

    def matches(self, tokens: list[str]) -> list[tuple[int, int]]:
        distinct = set(tokens)
        if len(self.seen) > CACHE:
            self.seen.clear()
        for t in distinct - self.seen:
            if m := self.automaton.match(cleaned(t)):
                self.hits[t] = m
        self.seen |= distinct
        if len(self.hits) > CACHE:
            self.hits = {t: m for t, m in self.hits.items() if t in distinct}
            self.seen = distinct
        if distinct.isdisjoint(self.hits):
            return []
        return [(i, self.hits[t]) for i, t in enumerate(tokens) if t in self.hits]

    def context(self, text: str | None) -> set[str]:
        """'form x' of a text's misspelt forms, and 'before x' of words that stand before terms."""
        tokens = (text or "").lower().split()
        found = self.matches(tokens)
        out = {f"form {cleaned(tokens[i])}" for i, m in found if m == 2}
        for i, _ in found:
            out.update(f"before {w}" for t in tokens[max(0, i - WINDOW) : i] if (w := cleaned(t)))
        return out

    def features(self, text: str | None) -> tuple[list[float], list[str]]:
        """FEATURES of a text, and its misspelt forms."""
        tokens = (text or "").lower().split()
        found = self.matches(tokens)
        if not found:
            return [0.0] * len(FEATURES), []
        inside_at = quotations(tokens)
        used = quoted = misspelt = 0
        forms = []
        for i, m in found:
            if i in inside_at or any(cleaned(t) in self.reporting for t in tokens[max(0, i - WINDOW) : i]):
                quoted += 1
            elif m == 2:
                misspelt += 1
            else:
                used += 1
            if m == 2:
                forms.append(cleaned(tokens[i]))
        rate = 100 * (used + misspelt) / len(tokens)
        return [float(used > 0), math.log1p(used), float(quoted > 0), float(misspelt > 0), math.log1p(misspelt), min(rate, 10.0)], forms


def _terms(text: str | None) -> set[str]:
    """Words ('=word') and prefixes ('word') of a text, each once."""
    out = set()
    for w in {cleaned(t) for t in set((text or "").lower().split())}:
        if len(w) >= STEMS[0]:
            out.add(f"={w}")
            out.update(w[:k] for k in STEMS if len(w) > k)
    return out


def _counted(texts: DataFrame, only: set[str] | None) -> DataFrame:
    """term and number of rows with it; each task sends its sums."""
    sent = texts.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*count], pa.string()), pa.array([*count.values()], pa.int64())], ["term", "n"])

        for part in sliced(batches, "text"):
            for text in part.column("text").to_pylist():
                terms = _terms(text)
                count.update(terms if sent.value is None else terms & sent.value)
            if len(count) > 4 * CACHE:
                yield out()
                count.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(labelled: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems of ``labelled`` (text, toxic), from counts over all of it."""
    totals = labelled.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n")).first()
    p_all, n_all = totals["p"], totals["n"]
    if not p_all or not n_all:
        return [], []
    least = max(MIN_COUNT, math.ceil(MIN_SHARE * p_all))
    # at most (terms of a text) / MIN_SHARE terms are so frequent, whatever the input's size
    pos = {r["term"]: r["n"] for r in _counted(labelled.filter("toxic = 1"), None).filter(F.col("n") >= least).collect()}
    neg = {r["term"]: r["n"] for r in _counted(labelled.filter("toxic = 0"), set(pos)).collect()}
    share = p_all / (p_all + n_all)

    def evidence(n: int, m: int) -> float:
        """Log-likelihood of n toxic and m clean texts at their own share, above that at the common one."""
        return n * math.log(n / ((n + m) * share)) + (m * math.log(m / ((n + m) * (1 - share))) if m else 0.0)

    # so that of all the terms tested, chance alone passes about one
    enough = math.log(max(100, len(pos)))
    strong = {t for t, n in pos.items() if n / p_all >= MIN_RATIO * (m := neg.get(t, 0)) / n_all and evidence(n, m) >= enough}
    # a prefix that one word accounts for stands for that word
    best: dict[str, int] = {}
    for t, n in pos.items():
        if t[0] == "=":
            for k in STEMS:
                best[t[1 : k + 1]] = max(best.get(t[1 : k + 1], 0), n)
    stems: set[str] = set()
    for t in sorted((t for t in strong if t[0] != "="), key=len):
        if best.get(t, 0) < 0.8 * pos[t] and not any(t[:k] in stems for k in STEMS):
            stems.add(t)
    words = [t[1:] for t in strong if t[0] == "=" and not any(t[1 : k + 1] in stems for k in STEMS)]
    words.sort(key=lambda w: (-pos["=" + w], w))
    return words, sorted(stems, key=lambda s: (-pos[s], s))


def learn_context(labelled: DataFrame, words: list[str], stems: list[str]) -> tuple[set[str], set[str]]:
    """Misspelt forms that clean texts have (no misspellings of terms), and words of reporting: those that stand before
    terms in clean texts much more than in toxic ones. Counts are over all of ``labelled``."""
    sent = labelled.sparkSession.sparkContext.broadcast((words, stems))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value, set())
        for part in sliced(batches, "text"):
            rows = [(item, toxic) for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True) for item in scorer.context(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["item", "toxic"])

    items = labelled.select("text", F.col("toxic").cast("int")).mapInArrow(run, "item string, toxic int")
    counts = items.groupBy("item").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("foul"))
    totals = labelled.agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("foul")).first()
    n = F.col("clean")
    form = F.col("item").startswith("form ") & (n >= max(2, math.ceil(MIN_CLEAN * totals["clean"]))) & (n >= 2 * F.col("foul"))
    report = F.col("item").startswith("before ") & (n >= max(MIN_REPORTS, math.ceil(MIN_CLEAN * totals["clean"]))) & (n / max(totals["clean"], 1) >= REPORT_RATIO * F.col("foul") / max(totals["foul"], 1))
    got = [r["item"].split(" ", 1) for r in counts.filter(form | report).select("item").collect()]
    return {x for kind, x in got if kind == "form"}, {x for kind, x in got if kind == "before"}


def quotations(tokens: list[str]) -> set[int]:
    """Places of tokens between two quotation marks at most QUOTATION tokens apart; a mark without partner quotes nothing."""
    inside: set[int] = set()
    open_at = None
    for i, t in enumerate(tokens):
        for _ in range(sum(map(t.count, QUOTES))):
            if open_at is not None and i - open_at <= QUOTATION:
                inside.update(range(open_at, i + 1))
                open_at = None
            else:
                open_at = i
    return inside


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, pull: float = 2.0) -> np.ndarray:
    """Logistic weights (bias first) by Newton steps, pulled towards ``prior``."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, words: list[str], stems: list[str], exceptions: set[str], reporting: set[str], weights: np.ndarray):
        self.words, self.stems, self.exceptions, self.reporting, self.weights = words, stems, exceptions, reporting, weights


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, seed: int = 5) -> Model:
    """Learn from ``labelled`` (doc_id, text, toxic), of which all rows may be learnt."""
    labelled = labelled.filter(F.col("toxic").isin(0, 1))
    words, stems = learn_lexicon(labelled)
    exceptions, reporting = learn_context(labelled, words, stems)
    sent = labelled.sparkSession.sparkContext.broadcast((words, stems, exceptions, reporting))
    # rows, not ids, are drawn: an id of very many rows takes no more than its part
    h = unit_hash(seed, F.col("doc_id"), F.xxhash64("text"))
    sample = labelled.select(h.alias("h"), "doc_id", "text", F.col("toxic").cast("int").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for part in sliced(batches, "text"):
            got = [scorer.features(t)[0] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("doc_id"), part.column("toxic"), pa.array(got, pa.list_(pa.float64()))], ["h", "doc_id", "toxic", "x"])

    most = sample.select("h", "doc_id").orderBy("h", "doc_id").limit(rows).agg(F.max("h")).first()[0]
    if most is None:
        return Model(words, stems, exceptions, reporting, PRIOR)
    got = sample.filter(F.col("h") <= most).mapInArrow(run, "h double, doc_id long, toxic int, x array<double>").orderBy("h", "doc_id", "toxic").limit(rows).collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)
    return Model(words, stems, exceptions, reporting, fit(x, y))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer = Scorer(m.words, m.stems, m.exceptions, m.reporting)
        for part in sliced(batches, "text"):
            x = np.array([scorer.features(t)[0] for t in part.column("text").to_pylist()])
            z = m.weights[0] + x @ m.weights[1:]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learnt from labels that may be learnt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(in_train(F.col("doc_id"))).select("doc_id", "toxic")
    # labels grow with the documents, so that both sides are always shuffled
    labelled = docs.filter(in_train(F.col("doc_id"))).join(labels.hint("merge"), "doc_id")
    model = train(written(labelled, "labelled"))
    out = scored(docs, model)
    held = ~in_train(F.col("doc_id")) & F.col("doc_id").isNotNull()
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
