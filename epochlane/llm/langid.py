"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from epochlane.llm.workers import tidy
from epochlane.session import materialise

#: Hashed n-gram classes.
BINS = 1 << 14
#: Most training texts of one language; the centroids are fitted on these.
SAMPLE_PER_LANG = 800
#: Languages that a model may have unless fit() is told otherwise; this bounds its size.
MOST_LANGS = 1000
#: Centroids of one language.
CENTROIDS = 4
ROUNDS = 8
#: A text is rejected when its cosine is under REJECT_SHARE of the REJECT_QUANTILE point of the cosines
#: of training texts that have about as many letters: short texts have few n-grams and lie farther out.
REJECT_SHARE, REJECT_QUANTILE = 0.5, 0.01
#: Lengths in letters where a new class of lengths begins.
LENGTHS = [16, 32, 64, 128, 256, 512, 1024]
SLICE = 1 << 16
UND = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def count_ngrams(text: str) -> tuple[np.ndarray, int]:
    """Counts of the text's letter bigrams and trigrams by class, and its number of letters.

    Lower case; every run of other characters is one blank, also at both ends. Long texts
    go slice by slice, the last two characters carried over, so the whole text counts."""
    alpha, counts, n = _letters(), np.zeros(BINS, np.int64), 0
    tail = np.array([32], np.uint64)
    text = text.lower()
    for at in range(0, len(text) + 1, SLICE):
        codes = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "replace"), np.uint32)
        is_letter = alpha[codes]
        n += int(is_letter.sum())
        codes = np.where(is_letter, codes, 32).astype(np.uint64)
        if at + SLICE > len(text):
            codes = np.append(codes, np.uint64(32))
        now = np.concatenate((tail, codes))
        now = now[np.concatenate((np.ones(len(tail), bool), (now[len(tail) :] != 32) | (now[len(tail) - 1 : -1] != 32)))]
        two = now[:-1] * np.uint64(0x9E3779B1) + now[1:] * np.uint64(0x85EBCA77)
        if len(two) > 1:
            three = two[:-1] * np.uint64(0x27D4EB2F) + now[2:] * np.uint64(0x165667B1)
            counts += np.bincount(((three >> np.uint64(17)) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        new = two[max(0, len(tail) - 1) :]
        counts += np.bincount(((new >> np.uint64(13)) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        tail = now[-2:]
    return counts, n


@dataclass
class Model:
    """idf by class of n-grams; one row of `centroids` for each entry of `langs`; one floor for each class of lengths."""

    idf: np.ndarray = field(default_factory=lambda: np.ones(BINS, np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS), np.float32))
    langs: list[str] = field(default_factory=list)
    floors: np.ndarray = field(default_factory=lambda: np.zeros(len(LENGTHS) + 1, np.float32))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the best centroid and its cosine; ties go to the first language by name."""
        cos = vectors @ self.centroids.T
        best = cos.argmax(axis=1)
        return best, cos[np.arange(len(best)), best]


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as normalised TF-IDF vectors, tf as log(1 + count)."""
    rows = np.log1p(counts.astype(np.float32)) * idf
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def length_class(letters) -> np.ndarray:
    return np.searchsorted(LENGTHS, letters, side="right")


class Rows:
    """Texts of one language as n-gram classes and their counts, made dense a block at a time."""

    def __init__(self, at: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray) -> None:
        self.at, self.counts, self.idf = at, counts, idf

    def blocks(self, only: np.ndarray | None = None, size: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, their TF-IDF vectors)."""
        rows = np.arange(len(self.at)) if only is None else only
        for lo in range(0, len(rows), size):
            own = rows[lo : lo + size]
            dense = np.zeros((len(own), BINS), np.float32)
            for i, r in enumerate(own.tolist()):
                dense[i, self.at[r]] = self.counts[r]
            yield own, weigh(dense, self.idf)

    def mean(self, only: np.ndarray) -> np.ndarray:
        return sum(x.sum(axis=0) for _, x in self.blocks(only)) / len(only)

    def along(self, only: np.ndarray, direction: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ direction for _, x in self.blocks(only)])

    def halves(self, only: np.ndarray, steps: int = 4) -> tuple[np.ndarray, np.ndarray] | None:
        """Two halves of some rows, cut at the median along their direction of largest spread; None for equal rows."""
        mean = self.mean(only)
        direction = next(self.blocks(only[self.along(only, mean).argsort(kind="stable")[:1]]))[1][0] - mean
        for _ in range(steps):
            far = self.along(only, direction) - mean @ direction
            norm = np.linalg.norm(far)
            if norm < 1e-4:
                return None
            direction = sum((far[i : i + len(x), None] * x).sum(axis=0) for i, (_, x) in zip(range(0, len(only), 64), self.blocks(only), strict=True)) - far.sum() * mean
            direction /= max(float(np.linalg.norm(direction)), 1e-12)
        order = self.along(only, direction).argsort(kind="stable")
        return only[np.sort(order[: len(order) // 2])], only[np.sort(order[len(order) // 2 :])]


def cluster(rows: Rows, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: at most k centroids, and each row's cosine to the nearest.

    It starts from the means of groups: the largest is halved until there are k. So outliers
    don't take a centroid of their own."""
    groups, whole = [np.arange(len(rows.at))], []
    while groups and len(groups) + len(whole) < k:
        groups.sort(key=len)
        largest = groups.pop()
        parts = rows.halves(largest) if len(largest) >= 2 else None
        if parts is None:
            whole.append(largest)
        else:
            groups += parts
    unit = lambda m: m / max(float(np.linalg.norm(m)), 1e-9)
    at = np.stack([unit(rows.mean(g)) for g in sorted([*groups, *whole], key=lambda g: int(g[0]))])
    for last in [False] * rounds + [True]:
        sums, n, best = np.zeros_like(at), np.zeros(len(at)), []
        for _, x in rows.blocks():
            cos = x @ at.T
            own = cos.argmax(axis=1)
            best.append(cos.max(axis=1))
            for j in np.unique(own).tolist():
                sums[j] += x[own == j].sum(axis=0)
                n[j] += (own == j).sum()
        if not last:
            at = np.stack([unit(s) if c else old for s, c, old in zip(sums, n, at, strict=True)])
    return at[n > 0], np.concatenate(best)


def reject_floors(letters: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The least cosine that isn't rejected in each class of lengths; a class without a text takes the next shorter one's."""
    of, out = length_class(letters), np.zeros(len(LENGTHS) + 1, np.float32)
    for c in range(len(out)):
        own = cosines[of == c]
        out[c] = REJECT_SHARE * np.quantile(own, REJECT_QUANTILE) if len(own) else out[c - 1] if c else 0
    return out


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts with a letter in docs (text), and for each class of n-grams how many of them hold it.

    Each task counts its own texts; the driver gets one number a class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BINS + 1, np.int64)  # the last is the number of texts
        for batch in batches:
            for text in batch.column("text"):
                counts, letters = count_ngrams(text.as_py())
                if letters:
                    df[:BINS] += counts > 0
                    df[BINS] += 1
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(df[on])], names=["at", "n"])

    out = np.zeros(BINS + 1, np.int64)
    for at, n in docs.select("text").mapInArrow(tidy(count), "at int, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return int(out[BINS]), out[:BINS]


def fit(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS, most_langs: int = MOST_LANGS) -> Model:
    """A model of all languages, from rows that aren't held out; more than most_langs of them are an error, as the model
    is sent to every task.

    docs: doc_id, text, lang. Rows with null text or lang, or no letter, teach nothing. Document
    frequencies cover all the others. Centroids are fitted on at most sample_per_lang texts of
    each language, the rows whose hashed doc_id comes first, thinned by a threshold before any
    sort; one task has one language's. The driver gets idf (BINS numbers), the centroids, and
    length and cosine of each sampled text. No labelled row: a model without languages."""
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(~F.coalesce(held_out("doc_id"), F.lit(False)))
    total, df = document_frequencies(known)
    if not total:
        return Model()
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(0.1)
    n = materialise(known.groupBy("lang").agg(F.count("*").alias("n")))
    if (languages := n.count()) > most_langs:
        raise ValueError(f"{languages} languages are more than most_langs = {most_langs}")
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 40))
    least = n.select("lang", (F.lit(float(1 << 40)) * F.least(F.lit(1.0), F.lit(1.5 * sample_per_lang + 200) / F.col("n"))).alias("_most"))
    thin = known.withColumn("_o", order).join(F.broadcast(least), "lang").where("_o <= _most")  # most_langs rows at most
    ranked = thin.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_o", "doc_id"))).where(F.col("_k") <= sample_per_lang)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at, values, size = [], [], [], []
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                counts, letters = count_ngrams(text.as_py())
                if letters:
                    on = np.flatnonzero(counts)
                    langs.append(lang.as_py()), at.append(on.astype(np.int32)), values.append(counts[on].astype(np.int32)), size.append(letters)
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "letters": pa.array(size, pa.int64()), "at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(values, pa.list_(pa.int32()))})

    sample = materialise(ranked.select("lang", "text").mapInArrow(tidy(featurise), "lang string, letters long, at array<int>, n array<int>"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        mid, cos = cluster(Rows(group["at"].tolist(), group["n"].tolist(), idf), centroids)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "mid": [m.astype(np.float32).tobytes() for m in mid], "letters": [group["letters"].tolist(), *[[]] * (len(mid) - 1)], "cos": [cos.astype(float).tolist(), *[[]] * (len(mid) - 1)]})

    rows = sorted(sample.groupBy("lang").applyInPandas(one, "lang string, mid binary, letters array<long>, cos array<double>").collect(), key=lambda r: r["lang"])
    floors = reject_floors(*(np.concatenate([np.array(r[c], float) for r in rows]) for c in ("letters", "cos")))
    return Model(idf, np.stack([np.frombuffer(r["mid"], np.float32) for r in rows]), [r["lang"] for r in rows], floors)


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """For each text its language, cosine in 0..1, and whether it is rejected."""
    langs, score, out = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    for at in range(0, len(texts), 64):
        found = [(at + i, *count_ngrams(t)) for i, t in enumerate(texts[at : at + 64]) if t]
        found = [x for x in found if x[2]]
        for i, _, _ in found:
            out[i] = False
        if found and model.langs:
            best, cos = model.nearest(weigh(np.stack([x[1] for x in found]), model.idf))
            floors = model.floors[length_class([x[2] for x in found])].tolist()
            for (i, _, _), j, c, floor in zip(found, best.tolist(), cos.tolist(), floors, strict=True):
                langs[i], score[i], out[i] = model.langs[j], min(1.0, max(0.0, c)), c < floor
    return langs, score, out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (any columns, text among them) with lang_pred, score and rejected, row by row.

    A null text or one without a letter is `und` with score 0 and rejected. Another gets the
    language of the nearest centroid; it is rejected if it lies farther from it than texts of
    its length do, see REJECT_SHARE. Without a learned language every text is `und`, and one
    with a letter isn't rejected, since there is no distance to judge by. The model is
    broadcast, at most most_langs * CENTROIDS * BINS numbers; nothing is shuffled. Columns of
    those three names in docs are replaced."""
    docs = docs.drop("lang_pred", "score", "rejected")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, out = judge(sent.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(out)], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    new = StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, *new.fields]))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, that predict() doesn't reject."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~judge(sent.value, batch.column("text").to_pylist())[2]))

    return docs.mapInArrow(tidy(run), docs.schema)
