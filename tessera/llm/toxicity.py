"""Toxicity scores from a Levenshtein automaton intersected with a lexicon trie.

The lexicon (whole terms and stems with log-odds) is learned from labelled rows. Its trie is
run together with the Levenshtein automaton of one edit; the product is made deterministic
on the fly, so a word costs one table look-up a letter and most words are dead after three.

Each match is evidence: a term's or stem's log-odds, or, for a misspelled term, the log-odds that
a misspelling of it stands in a toxic text rather than in a clean one. Clean labelled texts say how
often words that happen to lie one letter off stand there, so a misspelling of a long term tells
much and one of a short, crowded term little. The context window then decides how much of the
evidence counts: all of it where the word is used, ``QUOTED`` of it where the window shows
quotation marks around it, more where other matches stand nearby. A logistic model, fitted
on other labelled rows than the lexicon, turns the sum into a probability.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import crc_mod, hash_share, load_documents, table
from tessera.session import cut

#: Labelled rows that the model is fitted on, about, at most; half for the lexicon, half for the weights.
FIT_ROWS = 20_000
#: Words on either side of a match that make up its context.
AROUND = 8
#: What a match between quotation marks keeps of its evidence, and what each match nearby adds.
QUOTED, NEARBY = 0.25, 0.25
#: How many misspellings of a term toxic texts are taken to have for one right spelling.
MISSPELLINGS = 0.2
#: Evidence of one match at most, so that no single word decides more than is known of it.
MOST = 8.0
THRESHOLD = 0.7

WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»‹›‘’]")
EDGE = "\"'.,;:!?()[]{}<>|*-–—…“”„«»‹›‘’`~#/\\"
OPENS, CLOSES = set("\"“„«‹‘"), set("\"”“»›’")
FEATURES = 3


class Automaton:
    """Product of the lexicon's trie and the automaton of words within ``edits`` of a term.

    ``terms`` are (text, is_stem, weight, weight of a misspelling). A word matches a term within the
    edits (terms under five letters: exactly), and a stem if it begins with it.
    """

    LIMIT = 200_000

    def __init__(self, terms: list[tuple[str, bool, float, float]], edits: int = 1):
        self.edits = edits
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.term: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.short: set[int] = set()
        for number, (text, is_stem, *_) in enumerate(terms):
            node = 0
            for ch in text:
                node = self.child[node].setdefault(ch, len(self.child))
                if node == len(self.child):
                    self.child.append({})
            (self.stem if is_stem else self.term)[node] = number
            if len(text) < 5:
                self.short.add(node)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.stems: list[int | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The number of a set of (trie node, edits so far), closed under left-out letters; -1 for none."""
        todo = list(items)
        while todo:
            node, e = todo.pop()
            if e < self.edits:
                for c in self.child[node].values():
                    if (c, e + 1) not in items:
                        items.add((c, e + 1))
                        todo.append((c, e + 1))
        key = frozenset(i for i in items if not any((i[0], e) in items for e in range(i[1])))
        if not key:
            return -1
        if (at := self.ids.get(key)) is None:
            at = self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            ends = [(e, -self.terms[self.term[n]][3 if e else 2], self.term[n]) for n, e in key if n in self.term and (e == 0 or n not in self.short)]
            best = min(ends, default=None)
            self.ends.append((best[2], best[0]) if best else None)
            self.stems.append(next((self.stem[n] for n, e in key if e == 0 and n in self.stem), None))
        return at

    def _next(self, state: int, ch: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            for c, n in self.child[node].items():
                if c == ch:
                    out.add((n, e))
                elif e < self.edits:
                    out.add((n, e + 1))
            if e < self.edits:
                out.add((node, e + 1))
        at = self._state(out)
        self.step[state][ch] = at
        return at

    def match(self, word: str) -> tuple[int, int] | None:
        """(number of the term, kind) of the best match: kind 0 a term, 1 a term within the edits, 2 a stem (the heaviest)."""
        if len(self.sets) > self.LIMIT:
            self._reset()
        state, stem = self.start, None
        for ch in word:
            state = at if (at := self.step[state].get(ch)) is not None else self._next(state, ch)
            if state < 0:
                break
            if (s := self.stems[state]) is not None and (stem is None or self.terms[s][2] > self.terms[stem][2]):
                stem = s
        end = self.ends[state] if state >= 0 else None
        if end and end[1] == 0:
            return end[0], 0
        if stem is not None:
            return stem, 2
        return (end[0], 1) if end else None


def matched_words(auto: Automaton, lowered: str, seen: dict[str, tuple[int, int] | None]) -> dict[str, tuple[int, int]]:
    """The distinct words of a text that match. seen: a bounded memory of words met before."""
    if len(seen) > 300_000:
        seen.clear()
    found = {}
    for token in set(lowered.split()):
        core = token.strip(EDGE)
        for w in (core,) if core.isalpha() else WORD.findall(core):
            r = seen.get(w, 0)
            if r == 0:
                r = seen[w] = auto.match(w)
            if r:
                found[w] = r
    return found


def evidence(auto: Automaton, text: str | None, seen: dict) -> list[tuple[int, int, float]]:
    """(term, kind, context score) of each match. The context score is 1 for a word in use."""
    lowered = (text or "").lower()
    found = matched_words(auto, lowered, seen) if lowered else {}
    if not found:
        return []
    tokens = TOKEN.findall(lowered)
    at = [i for i, t in enumerate(tokens) if t in found]
    out = []
    for k, i in enumerate(at):
        term, kind = found[tokens[i]]
        before, after = tokens[max(0, i - AROUND) : i], tokens[i + 1 : i + 1 + AROUND]
        if _opened(before) and any(t in CLOSES for t in after):
            context = QUOTED
        else:
            near = (k > 0 and i - at[k - 1] <= AROUND) + (k + 1 < len(at) and at[k + 1] - i <= AROUND)
            context = 1 + NEARBY * near
        out.append((term, kind, context))
    return out


def features(auto: Automaton, text: str | None, seen: dict) -> np.ndarray:
    """What the model sees of a text: the sum and the most of its terms' evidence (square roots), and how dense it is; zeros for none."""
    x = np.zeros(FEATURES)
    found = evidence(auto, text, seen)
    if not found:
        return x
    terms: dict[int, float] = {}
    for term, kind, context in found:
        weight = min(MOST, auto.terms[term][3 if kind == 1 else 2]) * context
        terms[term] = max(terms.get(term, 0.0), weight)
    total = sum(terms.values())
    x[0], x[1] = math.sqrt(total), math.sqrt(max(terms.values()))
    x[2] = min(1.0, total / (1 + len((text or "")) / 50))
    return x


def _opened(before: list[str]) -> bool:
    """Whether a quotation mark in the window before has not been closed again."""
    marks = [t for t in before if t in OPENS or t in CLOSES]
    return len(marks) % 2 == 1 and marks[-1] in OPENS


def keys(text: str | None) -> dict[str, int]:
    """Candidates of the lexicon, words (with a $) and their first 4 to 6 letters, each with a hash of the words around its first place."""
    words = WORD.findall((text or "").lower())
    first: dict[str, int] = {}
    for i, w in enumerate(words):
        first.setdefault(w, i)
    out: dict[str, int] = {}
    for w, i in first.items():
        if 3 <= len(w) <= 40:
            around = zlib.crc32(" ".join(words[max(0, i - 2) : i] + words[i + 1 : i + 3]).encode())
            out.setdefault(w + "$", around)
            for n in (4, 5, 6):
                if len(w) > n:
                    out.setdefault(w[:n], around)
    return out


def learn_lexicons(sample: DataFrame) -> list[list[tuple[str, bool, float, float]]]:
    """(text, toxic, half: 0 or 1) of bounded, labelled rows -> the lexicons of half 0, half 1 and both, as (text, is_stem, log-odds, log-odds of a misspelling).

    Entries are terms and stems that toxic texts have and others lack. A candidate counts once
    for each toxic text, and once for all in which the same words stand around it, so the words
    of a text with many copies gain nothing by them. Its surprise (binomial divergence from the
    share of toxic rows) has to exceed what the number of candidates makes likely by chance.
    A lexicon is as large as the rows support; the bound on rows bounds it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad, good = set(), Counter()
            for text, y, half in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = keys(text.as_py())
                if y:
                    bad.update((k, c, half) for k, c in found.items())
                else:
                    good.update((k, half) for k in found)
            rows = [(k, half, c, 0) for k, c, half in bad] + [(k, half, None, n) for (k, half), n in good.items()]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["k", "half", "around", "good"])

    p = sample.agg(F.avg("toxic")).first()[0] or 0.0
    if not 0 < p < 1:
        return [[], [], []]
    each = sample.select("text", "toxic", F.col("half").cast("int")).mapInArrow(run, "k string, half int, around long, good long")
    each = each.groupBy("k", "around").agg(*(F.max(F.when((F.col("half") == h) & F.col("around").isNotNull(), 1)).alias(f"b{h}") for h in (0, 1)), *(F.sum(F.when(F.col("half") == h, F.col("good")).otherwise(0)).alias(f"g{h}") for h in (0, 1)))
    counts = each.groupBy("k").agg(F.count("b0").alias("bad0"), F.count("b1").alias("bad1"), F.count("around").alias("bad2"), F.sum("g0").alias("good0"), F.sum("g1").alias("good1"), F.sum(F.col("g0") + F.col("g1")).alias("good2"))
    counts = cut(counts.where("bad2 >= 3"))
    tested = counts.count()
    lexicons = []
    for part in (0, 1, 2):
        bad, n = F.col(f"bad{part}"), F.col(f"bad{part}") + F.col(f"good{part}")
        share = bad / n
        surprise = n * (share * F.ln(share / p) + F.when(share < 1, (1 - share) * F.ln((1 - share) / (1 - p))).otherwise(0.0))
        odds = F.ln((bad + 0.5) / (F.col(f"good{part}") + 0.5)) - math.log(p / (1 - p))
        rows = counts.where(bad >= 3).select("k", bad.alias("bad"), surprise.alias("surprise"), odds.alias("odds"), share.alias("share")).where(F.col("share") > max(0.5, p))
        rows = rows.where(F.col("surprise") > math.log(tested + 1) + 2).select("k", "odds", "bad").orderBy("k").collect()
        lexicons.append([(r[0].rstrip("$"), not r[0].endswith("$"), float(r[1]), int(r[2])) for r in rows])
    return _misspellings(sample, lexicons)


def _misspellings(sample: DataFrame, lexicons: list[list[tuple[str, bool, float, int]]]) -> list[list[tuple[str, bool, float, float]]]:
    """Puts a misspelling's log-odds in place of the number of toxic texts with a term.

    Clean texts of the half (or halves) that a lexicon comes from are searched for misspellings
    of its terms; toxic texts are taken to have MISSPELLINGS for each right spelling.
    """
    sent = sample.sparkSession.sparkContext.broadcast([[(t, stem, odds, odds) for t, stem, odds, _ in lexicon] for lexicon in lexicons])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        autos = [(Automaton(terms), {}) for terms in sent.value]
        for b in batches:
            seen: Counter = Counter()
            for text, half in zip(b.column(0), b.column(1).to_pylist()):
                for part in (half, 2):
                    auto, memory = autos[part]
                    seen.update((part, term) for term in {e[0] for e in evidence(auto, text.as_py(), memory) if e[1] == 1})
                    seen[part, -1] += 1
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["part", "term", "n"])

    clean = sample.where("toxic = 0").select("text", F.col("half").cast("int"))
    met = {(r[0], r[1]): r[2] for r in clean.mapInArrow(run, "part int, term int, n long").groupBy("part", "term").agg(F.sum("n")).collect()}
    toxic = {r[0]: r[1] for r in sample.where("toxic = 1").groupBy(F.col("half").cast("int").alias("half")).count().collect()}
    toxic[2] = sum(toxic.values())
    out = []
    for part, lexicon in enumerate(lexicons):
        good = met.get((part, -1), 0) + 1.0
        rows = []
        for number, (text, stem, odds, bad) in enumerate(lexicon):
            share = met.get((part, number), 0) + 0.5
            wrong = math.log((MISSPELLINGS * bad / max(1, toxic.get(part, 0))) / (share / good)) if bad else 0.0
            rows.append((text, stem, odds, max(0.0, min(odds, wrong))))
        out.append(rows)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _featured(lexicon: list, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    auto, seen = Automaton(lexicon), {}
    for b in batches:
        yield b, np.array([features(auto, t.as_py(), seen) for t in b.column("text")]).reshape(-1, FEATURES)


def scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probabilities of rows of features."""
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list, np.ndarray] | None:
    """(lexicon, weights), or None where the labelled rows have one class only or none.

    The rows: ``labels`` with a toxic label and crc32(doc_id) mod 3 not 1, about
    ``fit_rows`` of them drawn by the hash of doc_id and written once. The weights are fitted on matches of
    each half with the lexicon of the other half; the lexicon that is returned is that of both.
    """
    mine = labels.where("toxic is not null and doc_id is not null").where(crc_mod("doc_id", 3) != 1)
    mine = mine.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    mine = mine.where(hash_share(F.col("doc_id"), mine.count(), fit_rows))
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(mine), "doc_id")
    sample = cut(sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))))
    *halves, lexicon = learn_lexicons(sample)
    sent = docs.sparkSession.sparkContext.broadcast(halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        autos = [(Automaton(terms), {}) for terms in sent.value]
        for b in batches:
            x = [list(features(*_using(autos[1 - half], t.as_py()))) for t, half in zip(b.column(0), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1).cast(pa.int32())], ["x", "y"])

    rows = sample.select("text", "toxic", F.col("half").cast("int")).mapInArrow(run, "x array<double>, y int").collect()
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    return lexicon, fit_logistic(np.array([r[0] for r in rows]), y)


def _using(auto: tuple[Automaton, dict], text: str | None) -> tuple[Automaton, str | None, dict]:
    return auto[0], text, auto[1]


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text) and (doc_id, toxic) -> (doc_id, score), a row for each document.

    Null and empty texts get the model's score for a text without matches. Without labels of
    both classes every score is 0. Labels of unknown documents and null labels are ignored;
    a document with several labels counts as toxic if one says so. Extra columns are ignored.
    """
    model = train(docs, labels, fit_rows)
    base = docs.select(F.col("doc_id").cast("long"), "text")
    if model is None:
        return base.select("doc_id", F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = sent.value
        for b, x in _featured(lexicon, batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(x, weights))], ["doc_id", "score"])

    return base.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...), all columns, whose score is under the threshold."""
    model = train(docs, labels, fit_rows)
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = sent.value
        for b, x in _featured(lexicon, batches):
            yield b.filter(pa.array(scores(x, weights) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = toxicity(load_documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
