"""Language identification as multilingual mixture inference.

A language is a distribution over hashed byte trigrams of lower-cased letters. Each document is
taken as a mixture: expectation-maximisation estimates its language proportions from the trigram
likelihoods, and languages leave the mixture one by one, the least share first, for as long as the
penalised likelihood (log-likelihood less ``penalty * log(trigrams)`` for each language) gains.

The model is learnt from a sample of labelled rows of bounded size: ``max_rows`` for each language,
drawn by a hash of the id, of the ``max_languages`` languages with the most rows; the documents to
predict are always taken whole.

Defined results: ``und`` with score 0 for a null text, or one without a letter (Unicode category L);
a text with a letter but without any trigram that the model has seen gets the language that sorts
first, with score 0, as nothing speaks for it; ties go to the language that sorts first; very long
texts are counted whole; no labelled rows: every prediction is ``und``; more than ``max_languages``
values of the language column: the rarer ones (of equal ones those that sort last) aren't learnt;
rows that repeat an id are predicted each; an empty table gives an empty result. Columns of the
input pass through; ``lang_pred`` and ``score`` are replaced if they are there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_columns

BINS = 1 << 14
UNKNOWN = "und"
MAX_ROWS = 20_000
MAX_LANGUAGES = 256

#: ASCII other than letters becomes a space; bytes of longer code points stay.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams over the whole text; trigrams of two spaces or more are left out."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b" ", np.uint8)
    space = b == 32
    keep = (space[:-2].astype(np.uint8) + space[1:-1] + space[2:]) < 2
    x = b.astype(np.uint32)
    code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:])[keep]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(18), minlength=BINS)


@dataclass(frozen=True)
class Model:
    """Languages in sorted order, the probability of each trigram bin in each of them, and which bins were seen at all."""

    languages: tuple[str, ...]
    likelihood: np.ndarray  # BINS x languages
    known: np.ndarray  # BINS
    penalty: float = 3.0

    def mixture(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the selected languages and their proportions."""
        seen = np.flatnonzero(counts * self.known)
        c, p = counts[seen].astype(np.float64), self.likelihood[seen]
        n = max(c.sum(), 1.0)
        price = self.penalty * np.log(n + 1)
        active = np.arange(p.shape[1])
        share, fit = _maximise(c, p, np.full(len(active), 1 / len(active)))
        while len(active) > 1:
            least = len(share) - 1 - int(share[::-1].argmin())  # of equal shares the last one goes
            rest = np.delete(np.arange(len(share)), least)
            tried, other = _maximise(c, p[:, rest], np.maximum(share[rest], 1e-3))
            if other + price < fit:
                break
            p, active, share, fit = p[:, rest], active[rest], tried, other
        return active, share

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not has_letter(text):
            return UNKNOWN, 0.0
        counts = trigram_counts(text)
        if not (counts * self.known).any():
            return self.languages[0], 0.0
        active, share = self.mixture(counts)
        best = int(share.argmax())
        return self.languages[active[best]], float(min(1.0, share[best]))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _maximise(c: np.ndarray, p: np.ndarray, share: np.ndarray, rounds: int = 25, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the proportions: c counts, p likelihoods; also the log-likelihood."""
    total = max(c.sum(), 1.0)
    share = share / share.sum()
    if p.shape[1] > 1:
        for _ in range(rounds):
            new = share * (p.T @ (c / (p @ share))) / total
            new = new / max(new.sum(), 1e-300)
            moved = np.abs(new - share).max()
            share = new
            if moved < tolerance:
                break
    return share, float(c @ np.log(p @ share))


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, smoothing: float = 0.5, max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn from the rows where ``usable`` holds and the language isn't null, ``max_rows`` of each of ``max_languages``."""
    rows = docs.select(docs[lang_col].alias("lang"), F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[text_col].alias("text"), usable.alias("usable"))
    rows = rows.where("usable and lang is not null and text is not null")
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_languages)
    known = {r["lang"]: r["n"] for r in most.collect()}
    if not known:
        return Model((), np.zeros((BINS, 0)), np.zeros(BINS, bool))
    languages = tuple(sorted(known))
    place = {lang: i for i, lang in enumerate(languages)}
    steps = 1 << 20
    limits = [(lang, place[lang], int(min(1.0, max_rows / n) * steps)) for lang, n in known.items()]
    sampled = F.broadcast(docs.sparkSession.createDataFrame(limits, "known string, number int, threshold int"))  # a row a language
    drawn = rows.join(sampled, F.col("lang") == F.col("known"))
    sample = drawn.where(F.pmod(F.xxhash64("id"), F.lit(steps)) < F.col("threshold")).select("number", "text")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part in parts:
            for number, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                if number not in held:
                    held[number] = np.zeros(BINS, np.int64)
                held[number] += trigram_counts(text.as_py())
        for number, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["number", "bin", "n"])

    # At most BINS rows for each language come to the driver, however many documents there are.
    counted = sample.mapInArrow(count, "number int, bin int, n long").groupBy("number", "bin").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros((BINS, len(languages)), np.float64)
    np.add.at(totals, (counted["bin"].to_numpy(np.int64), counted["number"].to_numpy(np.int64)), counted["n"].to_numpy(np.float64))
    return Model(languages, (totals + smoothing) / (totals + smoothing).sum(axis=0), totals.any(axis=1))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with ``lang_pred`` and ``score``."""

    # At most MAX_LANGUAGES times BINS probabilities.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns(docs.withColumn(text_col, docs[text_col].cast("string")), [text_col], lambda text: shared.value.predict(text), "lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """The third of the ids that nothing is learnt from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1
