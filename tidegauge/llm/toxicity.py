"""Toxicity: a learned lexicon, met also in misspelled form, weighed by its context.

The lexicon holds words far likelier in toxic than in clean labelled documents, in at
least a few different surroundings, so that copies of one document do not fill it. A trie
of the lexicon is intersected with the Levenshtein automaton (one edit) of each word; a
word can only match if it shares the first or second half of a term, which most do not.
Terms between quotation marks or near words of reporting count apart from plain abuse. A
logistic regression on these few sums gives the score.

Labels are read only of rows whose crc32(key) mod 3 is not 1, and of a bounded sample of
them: the ``sample_toxic`` and ``sample_clean`` rows of the smallest hash. Regression
weights are fitted on documents that the lexicon used for them was not learned from.

Defined results: null and empty texts score as texts without a term; without labels of
both classes the lexicon is empty and every score is 0; repeated rows score alike; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.pieces import Chunks
from tidegauge.session import materialize

SAMPLE_TOXIC, SAMPLE_CLEAN, LEXICON_TERMS = 4000, 12_000, 3000
#: A term needs so many surroundings, and at least this share of the toxic documents as support.
LEAST_SURROUNDINGS, LEAST_SHARE, LEAST_ODDS = 3, 0.003, 15.0
REMEMBERED = 600_000
WINDOW = 6
QUOTES = "\"“”„«»"
# Words that report what others say.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes term word dijo escribió sagte schrieb dit écrit".split())
OUTER = ".,;:!?()[]{}\"'`*&#%$|<>~…«»“”„‘’-_"
FEATURES = ("exact", "near", "quoted", "share")


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1


class Lexicon:
    """Terms with weights; finds the best term within one edit of a word."""

    def __init__(self, terms: dict[str, float], least_fuzzy: int = 5):
        self.terms = terms
        self.trie: dict = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        self.lengths: set[int] = set()
        for term in terms:
            if len(term) < least_fuzzy:
                continue
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            self.heads.add(term[:len(term) // 2])
            self.tails.add(term[len(term) // 2:])
            self.lengths.add(len(term))

    def _may(self, word: str) -> bool:
        n = len(word)
        for length in (n - 1, n, n + 1):
            if length in self.lengths and (word[:length // 2] in self.heads or word[length // 2 - length:] in self.tails):
                return True
        return False

    def near(self, word: str) -> str | None:
        """The heaviest term within one edit, by walking the trie along the word's automaton."""
        if not self._may(word):
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        goal, best = 1 << len(word), None
        # bit i of a state: i letters of the word are read, without an edit and with one
        stack = [(self.trie, 1, 0b11)]
        while stack:
            node, none, one = stack.pop()
            for c, below in node.items():
                if c == "":
                    if (none | one) & goal and (best is None or self.terms[below] > self.terms[best]):
                        best = below
                    continue
                fits = masks.get(c, 0)
                none_next = (none & fits) << 1
                one_next = ((one & fits) << 1) | none | (none << 1) | (none_next << 1)
                one_next &= (goal << 1) - 1
                if none_next | one_next:
                    stack.append((below, none_next, one_next))
        return best

    def match(self, token: str) -> tuple[float, float] | None:
        """Weight of an exact and of a near match of a raw token."""
        word = token.strip(OUTER).lower()
        if word in self.terms:
            return self.terms[word], 0.0
        term = self.near(word) if len(word) >= 4 else None
        return (0.0, self.terms[term]) if term else None


class Scorer:
    def __init__(self, terms: dict[str, float], remembered: int = REMEMBERED):
        self.known = Chunks(Lexicon(terms).match, remembered)

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        exact = near = quoted = 0.0
        hits = [(i, m) for i, m in enumerate(map(self.known.__getitem__, tokens)) if m]
        if not hits:
            return [0.0, 0.0, 0.0, 0.0]
        for i, (whole, fuzzy) in hits:
            around = tokens[max(0, i - WINDOW):i + WINDOW + 1]
            before = sum(t.count(q) for t in tokens[max(0, i - WINDOW):i + 1] for q in QUOTES)
            after = sum(t.count(q) for t in tokens[i:i + WINDOW + 1] for q in QUOTES)
            if before and after or any(t.strip(OUTER).lower() in REPORTING for t in around):
                quoted += whole + fuzzy
            else:
                exact, near = exact + whole, near + fuzzy
        return [math.log1p(exact), math.log1p(near), math.log1p(quoted), len(hits) / len(tokens)]


@lru_cache(maxsize=2)
def _shared(terms: tuple[tuple[str, float], ...]) -> Scorer:
    """One per Python worker and lexicon."""
    return Scorer(dict(terms))


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """doc_id and the features of ``body``; other columns of ``docs`` pass."""
    kept = [c for c in docs.columns if c != "body"]
    terms = tuple(sorted(lexicon.items()))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = _shared(terms)
        for batch in batches:
            rows = np.array([scorer.features(t) for t in batch.column("body").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in kept} | {name: pa.array(rows[:, k]) for k, name in enumerate(FEATURES)})

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + "".join(f", {f} double" for f in FEATURES)
    return docs.mapInArrow(run, schema)


def learned(sample: DataFrame, most: int = LEXICON_TERMS) -> dict[str, float]:
    """Word -> weight from (body, toxic); at most ``most`` terms come to the driver."""
    size = sample.groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in size}
    if not n.get(1) or not n.get(0):
        return {}
    words = F.filter(F.split(F.lower("body"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    listed = sample.select("toxic", F.monotonically_increasing_id().alias("row"), bare.alias("words"))
    least = max(LEAST_SURROUNDINGS, LEAST_SHARE * n[1])
    toxic = (
        listed.where("toxic = 1").select("row", "words", F.posexplode("words").alias("at", "word"))
        .select("row", "word", F.get("words", F.col("at") - 1).alias("before")).where(F.length("word") >= 3)
        .groupBy("word", "row").agg(F.min("before").alias("before"))
        .groupBy("word").agg(F.count("*").alias("t"), F.count_distinct("before").alias("surroundings"))
        .where((F.col("surroundings") >= least) & (F.col("t") >= least))
    )
    clean = listed.where("toxic = 0").select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    odds = (F.col("t") / n[1]) / ((F.coalesce("c", F.lit(0)) + 0.5) / n[0])
    weighed = toxic.join(clean, "word", "left").withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    rows = weighed.orderBy(F.desc("t"), "word").limit(most).select("word", F.log("odds").alias("weight")).collect()
    return {r.word: round(r.weight, 6) for r in rows}


def fitted(frame: pd.DataFrame, rounds: int = 60, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps; classes weigh alike. The last weight is the constant."""
    x = np.column_stack((frame[list(FEATURES)].to_numpy(np.float64), np.ones(len(frame))))
    y = frame["toxic"].to_numpy(np.float64)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w, pull = np.zeros(x.shape[1]), np.diag([ridge] * len(FEATURES) + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + pull, x.T @ (share * (y - p)) - pull @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model(NamedTuple):
    lexicon: dict[str, float]
    weights: list[float]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
          sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Model:
    chosen = labels.where(F.col(key).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col(key))).select(F.col(key).alias("k"), "toxic")
    order = F.xxhash64("k")
    picked = chosen.where("toxic = 1").orderBy(order, "k").limit(sample_toxic).unionAll(chosen.where("toxic = 0").orderBy(order, "k").limit(sample_clean))
    source = docs.select(docs[key].alias("k"), F.coalesce(docs[text], F.lit("")).alias("body"))
    # the sample has a stated number of rows, whatever the corpus
    sample = materialize(source.join(F.broadcast(picked), "k").dropDuplicates(["body", "toxic"]), "toxic-sample")
    half = F.pmod(F.xxhash64("k", F.lit("half")), F.lit(2))
    parts = [sample.where(half == side).select("body", "toxic") for side in (0, 1)]
    crossed = [with_features(parts[1 - side], learned(parts[side])).toPandas() for side in (0, 1)]
    lexicon = learned(sample.select("body", "toxic"))
    frame = pd.concat(crossed)
    return Model(lexicon, fitted(frame).tolist() if lexicon and frame["toxic"].nunique() == 2 else [])


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the features and ``score``."""
    source = docs.select(docs[key].alias(key), F.coalesce(docs[text], F.lit("")).alias("body"))
    found = with_features(source, model.lexicon)
    if not model.weights:
        return found.withColumn("score", F.lit(0.0))
    total = F.lit(model.weights[-1])
    for name, weight in zip(FEATURES, model.weights):
        total = total + F.col(name) * weight
    return found.withColumn("score", 1 / (1 + F.exp(-total)))
