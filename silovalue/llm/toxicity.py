"""Toxicity by a weighted lexicon that is matched with an Aho-Corasick automaton after folding.

Folding maps accents, homoglyphs and digit or sign substitutions to plain letters. The lexicon (words and word beginnings,
each with a log-odds weight) and the exception phrases are learned from labelled rows. A document's score is a logistic
function of the matched weight, as a sum and normalised by length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from silovalue.llm import common

MAX_ROWS = 12_000
MAX_TERMS = 4_000
MAX_EXCEPTIONS = 1_000
BEGINNINGS = (4, 5, 6, 7)
LEAST_DOCS = 6
LEAST_WEIGHT = 2.5

# Letters that look like, or stand for, Latin ones.
HOMOGLYPHS = dict(zip("аеорсухікмтнвѕјԁɡαεορτυικνßøłđ", "aeopcyxikmthbsjdgaeoptuiknsold"))
SUBSTITUTES = dict(zip("013456789|", "oieasgtbgi"))
SIGNS = {"$": "s", "@": "a", "!": "i"}
# l is folded with i, as 1 and | stand for both.
_TABLE = {c: " " for c in range(0x80) if not chr(c).isalnum() and chr(c) != "'"}
_TABLE |= {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()} | {ord("l"): "i", ord("2"): "z", ord("'"): None}
_SIGNS = re.compile(r"[$@!](?=[^\W\d_])")
_MARKS = re.compile("[̀-ͯ​-‍﻿­]+")


def fold(text: str | None) -> str:
    """The text's folded words, each between single spaces; no words give one space."""
    text = (text or "").lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    if "$" in text or "@" in text or "!" in text:
        text = _SIGNS.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(_TABLE).split())} "


@dataclass
class Model:
    terms: dict[str, float]
    exceptions: list[str]
    coefficients: list[float]

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        found.make_automaton()
        return found


def features(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, float, float]:
    """Matched weight, the number of matched words and the number of words; of the matches of one word the heaviest
    counts, and none within an exception phrase."""
    folded = fold(text)
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    if len(automaton):
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    for a, b in spared:
        for start in [s for s in best if a <= s < b]:
            del best[start]
    return sum(best.values()), float(len(best)), float(folded.count(" ") - 1)


def design(raw: np.ndarray) -> np.ndarray:
    """Constant, total weight, matched words and weight per word, the last three on a slow scale."""
    weight, count, words = raw.T
    return np.stack([np.ones(len(raw)), np.log1p(weight), np.log1p(count), np.sqrt(weight / np.maximum(words, 1.0)),
                     weight / (weight + 5.0)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic) of labelled rows that aren't held out: all, or about ``max_rows`` chosen by a hash of their id."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").where(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _candidates(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}


def _counted(rows: DataFrame, terms_of, least: int) -> DataFrame:
    """Documents and toxic documents with each term: counted per task, then added up; terms below ``least`` go."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bad = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = terms_of(fold(text))
                seen.update(terms)
                if toxic:
                    bad.update(terms)
        keys = list(seen)
        for a in range(0, len(keys), 50_000):
            part = keys[a : a + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([seen[k] for k in part], pa.int64()), pa.array([bad[k] for k in part], pa.int64())],
                ["term", "seen", "bad"])

    summed = rows.mapInArrow(one, "term string, seen bigint, bad bigint").groupBy("term").agg(
        F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    return summed.where(F.col("seen") >= least).withColumn("share", F.col("bad") / F.col("seen"))


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS, max_exceptions: int = MAX_EXCEPTIONS,
) -> Model:
    """Learns terms, exceptions and coefficients from at most about ``max_rows`` labelled rows; no labels: score 0.5 for all.

    The model keeps the ``max_terms`` weightiest terms and the ``max_exceptions`` most frequent exceptions. Of several labels
    of a document the highest counts. Rows without a doc_id are never learned from.
    """
    rows = common.stored(training_rows(docs, labels, max_rows), "toxic-rows")
    total, bad = rows.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    bad = bad or 0
    if not bad or bad == total:
        return Model({}, [], [0.0 if not total else float(np.log((bad + 0.5) / (total - bad + 0.5))), 0.0, 0.0, 0.0, 0.0])
    rate = lambda n, of: F.log((n + 0.5) / (of - n + 0.5))
    weight = rate(F.col("bad"), bad) - rate(F.col("seen") - F.col("bad"), total - bad)
    counted = _counted(rows, _candidates, LEAST_DOCS)
    found = counted.withColumn("weight", weight).where((F.col("weight") >= LEAST_WEIGHT) & (F.col("bad") >= LEAST_DOCS)).orderBy(
        F.desc(F.col("weight") * F.sqrt("bad")), "term").limit(max_terms).collect()
    terms = {r.term: float(r.weight) for r in found}
    model = Model(terms, _exceptions(rows, terms, bad / total, max_exceptions), [])

    automaton = model.automaton()

    def measure(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = np.array([features(t, automaton) for t in batch.column(0).to_pylist()]).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([*map(pa.array, raw.T), pa.array([float(x == 1) for x in batch.column(1).to_pylist()])], ["a", "b", "c", "y"])

    got = np.array(common.map_batches(rows, measure, "a double, b double, c double, y double").collect()).reshape(-1, 4)
    model.coefficients = logistic(design(got[:, :3]), got[:, 3]).tolist()
    return model


def _exceptions(rows: DataFrame, terms: dict[str, float], base: float, most: int) -> list[str]:
    """Pairs of neighbouring words with a term in the first or second that are no more toxic than documents at large."""
    bare = ahocorasick.Automaton()
    for term in terms:
        bare.add_word(term, len(term))
    if not len(bare):
        return []
    bare.make_automaton()

    def phrases(folded: str) -> set[str]:
        out = set()
        for end, length in bare.iter(folded):
            start = end - length + 1
            stop = folded.index(" ", start + 1)
            after = folded.find(" ", stop + 1)
            before = folded.rfind(" ", 0, start)
            if after > 0:
                out.add(folded[start : after + 1])
            if before >= 0:
                out.add(folded[before : stop + 1])
        return out

    found = _counted(rows, phrases, LEAST_DOCS).where(F.col("share") <= base).orderBy(F.desc("seen"), "term").limit(most).collect()
    return [r.term for r in found]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc, score): doc is a struct of the document's own columns, whatever their names; null text counts as empty.

    The whole text is read; the model is at most MAX_TERMS terms and 1,000 phrases, shipped with the task.
    """
    terms = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = terms.automaton()
        for batch in batches:
            doc = batch.column(0)
            raw = np.array([features(t, automaton) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            value = 1 / (1 + np.exp(-np.clip(design(raw) @ np.array(terms.coefficients), -30, 30)))
            yield pa.RecordBatch.from_arrays([doc, pa.array(value)], ["doc", "score"])

    packed = docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc.text").cast("string").alias("text"))
    return packed.mapInArrow(run, packed.select("doc").schema.add("score", "double"))


def digest(docs: DataFrame, model: Model) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc.doc_id", "score").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    return score(docs, model).where(F.col("score") < limit).select("doc.*")
