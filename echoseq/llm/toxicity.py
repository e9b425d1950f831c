"""Toxicity by a weighted lexicon.

Text is folded: lower case, homoglyphs to Latin letters, digits and signs that stand for letters
inside a word, zero-width characters dropped, everything between words to one space. The lexicon holds
whole words and beginnings of words with weights; Aho-Corasick finds them all in one pass. A match inside
an exception phrase doesn't count. The sum of weights, as it is and by length, goes through a logistic
function, which gives the score.

The lexicon and the logistic are learnt from labelled rows outside the held-out quarter (CRC-32 of
doc_id as text, modulo 4, equal to 2); of those the SAMPLE with the least hash at most. Counts of word
beginnings, in toxic and in clean rows, are made on the executors and filtered there by support and weight,
so only terms that may enter the lexicon come to the driver. Without toxic labels the lexicon is SEED_TERMS.

Null or empty text scores as a text without matches. Repeated rows score alike. Extra columns are
ignored; labels, language, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

#: Bound on labelled rows that a model is fitted on.
SAMPLE = 24_000
THRESHOLD, HELD_OUT = 0.3, 2
SUPPORT, SHORTEST, LONGEST, LEAST_WEIGHT = 4, 3, 9, 2.0

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝвкмнтαεικνορτυχβηρω", "aeopcyxijsdhqwbkmhtaeikvoptuxbhpw", strict=True))
# Digits and signs that stand for letters inside a word.
DIGITS = dict(zip("01345789@$", "oieastbgas", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
# What counts without labels, and benign phrases.
SEED_TERMS = {w: 4.0 for w in "disgusting idiot loser moron pathetic scum stupid trash worthless".split()}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "stupid question of mine", "white paper trash")

FOLD = str.maketrans({**HOMOGLYPHS, **dict.fromkeys(INVISIBLE, "")})
MIXED = re.compile(r"(?=[\w@$]*[^\W\d_])(?=[\w@$]*[\d@$])[\w@$]+")
LEET = str.maketrans(DIGITS)
BETWEEN = re.compile(r"[\W_]+")
CYRILLIC_GREEK = re.compile("[Ͱ-ԯ­​-‍⁠﻿]")
DIGIT_SIGN = re.compile(r"[\d@$]")


def fold(text: str | None) -> str:
    """Folded words joined by single spaces, with one space before and after."""
    if not text:
        return " "
    t = text.lower()
    if CYRILLIC_GREEK.search(t):
        t = t.translate(FOLD)
    if DIGIT_SIGN.search(t):
        t = MIXED.sub(lambda m: m[0].translate(LEET), t)
    return f" {BETWEEN.sub(' ', t).strip()} "


def terms_of(folded: str) -> set[str]:
    """Beginnings of words of several lengths (' abc') and whole words (' abcd ')."""
    out = set()
    for w in set(folded.split()):
        out.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
        out.add(f" {w} ")
    return out


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == HELD_OUT


class Lexicon:
    """Weighted terms, exception phrases and the logistic that makes a score of their matches."""

    def __init__(self, terms: dict[str, float], exceptions: tuple[str, ...], coef: tuple[float, float, float]):
        self.terms, self.exceptions, self.coef = terms, exceptions, coef

    def __getstate__(self):
        return self.terms, self.exceptions, self.coef

    def __setstate__(self, state):
        self.terms, self.exceptions, self.coef = state

    def automaton(self):
        if "auto" not in self.__dict__:
            import ahocorasick

            self.auto = ahocorasick.Automaton()
            for t, weight in self.terms.items():
                self.auto.add_word(t, (len(t), weight))
            for p in self.exceptions:
                key = f" {p} "
                if key not in self.terms:
                    self.auto.add_word(key, (len(key), None))
            if len(self.auto):
                self.auto.make_automaton()
        return self.auto

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """(start, weight) of the heaviest term at each word that no exception phrase covers."""
        auto = self.automaton()
        if not len(auto):
            return []
        best: dict[int, float] = {}
        covered: list[list[int]] = []
        # Phrases come by their ends; one that begins in those before it is joined to them.
        for end, (size, weight) in auto.iter(folded):
            start = end - size + 1
            if weight is None:
                while covered and covered[-1][1] >= start:
                    start = min(start, covered.pop()[0])
                covered.append([start, end])
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if not covered:
            return list(best.items())
        begins = [a for a, _ in covered]
        at = [(s, w, bisect.bisect_right(begins, s) - 1) for s, w in best.items()]
        return [(s, w) for s, w, k in at if k < 0 or s >= covered[k][1]]

    def features(self, folded: str) -> tuple[float, float]:
        total = sum(w for _, w in self.matches(folded))
        words = folded.count(" ") - 1
        return np.log1p(total), np.log1p(100.0 * total / (words + 20))

    def score(self, text: str | None) -> float:
        a, b, c = self.coef
        x, y = self.features(fold(text))
        return float(1.0 / (1.0 + np.exp(-np.clip(a + b * x + c * y, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Coefficients by Newton steps, slopes held at 0 or more."""
    x1 = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x1.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + penalty, x1.T @ (y - p) - penalty @ beta)
        beta += step
        beta[1:] = np.maximum(beta[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def choose(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Terms with the weight of their smoothed log odds; a longer one stays only if it says more than its beginnings."""
    out: dict[str, float] = {}
    for t in sorted(counts, key=lambda t: (len(t), t)):
        a, b = counts[t]
        if a < SUPPORT:
            continue
        weight = float(np.log((a + 0.1) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))
        word = t.rstrip()
        known = max((out.get(word[:k], 0.0) for k in range(SHORTEST + 1, len(word) + 1)), default=0.0)
        if weight >= LEAST_WEIGHT and a >= 3 * b and weight > known + (0.7 if known else 0.0):
            out[t] = weight
    return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """A lexicon from labelled rows outside the held-out quarter."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    labels = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Toxic rows are the rare class: they may take half of the sample. The bound holds for what follows.
    tox = labels.where("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(sample // 2)
    chosen = tox.unionByName(labels.where("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(sample // 2))
    rows = documents(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    scratch = Scratch(spark, "toxicity")

    def support(batches):
        """Rows that have a term, toxic (a) and clean (b); '' counts the rows."""
        n, m = Counter(), Counter()
        for rb in batches:
            for y, t in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                of = n if y else m
                of[""] += 1
                of.update(terms_of(fold(t.as_py())))
        every = list(n.keys() | m.keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([n[t] for t in every], pa.int64()), pa.array([m[t] for t in every], pa.int64())], ["term", "a", "b"])

    found = scratch.table(rows.mapInArrow(support, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= SUPPORT), "terms")
    total = found.where("term = ''").first()
    toxic, clean = (total["a"], total["b"]) if total else (0, 0)
    if not toxic:
        return Lexicon({f" {t}": w for t, w in SEED_TERMS.items()}, EXCEPTIONS, (-4.0, 2.5, 0.0))
    # choose() takes no other terms, whatever the rest of them is; the margin leaves rounding to it.
    weight = F.log((F.col("a") + 0.1) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    counts = {r["term"]: (r["a"], r["b"]) for r in found.where((F.col("term") != "") & (F.col("a") >= 3 * F.col("b")) & (weight >= LEAST_WEIGHT - 1e-6)).collect()}
    lexicon = Lexicon(choose(counts, toxic, clean), EXCEPTIONS, (0.0, 0.0, 0.0))

    def phrases(batches):
        """Matches with the word before or after, in clean rows and in toxic ones; and the features of each row."""
        n, m, feats = Counter(), Counter(), []
        for rb in batches:
            for y, t in zip(rb.column(0).to_pylist(), rb.column(1), strict=True):
                f = fold(t.as_py())
                feats.append((int(y), *lexicon.features(f)))
                near = set()
                for s, _ in lexicon.matches(f):
                    end = f.find(" ", s + 1)
                    before, after = f.rfind(" ", 0, s), f.find(" ", end + 1)
                    if before >= 0:
                        near.add(f[before + 1 : end])
                    if after >= 0:
                        near.add(f[s + 1 : after])
                (m if y else n).update(near)
        rows = [("p", k, v, m.get(k, 0), None, None) for k, v in n.items()] + [("p", k, 0, v, None, None) for k, v in m.items() if k not in n]
        rows += [("f", None, y, 0, float(a), float(b)) for y, a, b in feats]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["kind", "phrase", "n", "m", "x", "y"])

    seen = rows.mapInArrow(phrases, "kind string, phrase string, n long, m long, x double, y double")
    # Equal rows are counted where they are: most texts have no match, and phrases must recur in clean texts.
    got = seen.groupBy("kind", "phrase", F.when(F.col("kind") == "f", F.col("n")).alias("label"), "x", "y").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count("*").alias("c"))
    got = got.where((F.col("kind") == "f") | ((F.col("n") >= 5) & (F.col("m") == 0))).collect()
    benign = sorted(((r["n"], r["phrase"]) for r in got if r["kind"] == "p"), key=lambda r: (-r[0], r[1]))
    feats = np.array([(r["label"], r["x"], r["y"], r["c"]) for r in got if r["kind"] == "f"])
    rep = np.repeat(feats[:, :3], feats[:, 3].astype(int), axis=0)
    return Lexicon(lexicon.terms, (*EXCEPTIONS, *(p for _, p in benign)), tuple(logistic(rep[:, 1:], rep[:, 0])))


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""

    def run(batches):
        for rb in batches:
            ids = rb.column(0).to_pylist()
            s = np.array([lexicon.score(t.as_py()) for t in rb.column(1)], float)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is under the threshold."""
    at = docs.columns.index("text")

    def run(batches):
        for rb in batches:
            yield rb.filter(pa.array([lexicon.score(t.as_py()) < threshold for t in rb.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
