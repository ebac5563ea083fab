"""Language identification by hierarchical discrimination: linear support vector machines, one against one,
first choose the language family, then the language within it.

Features are relative frequencies of hashed letter trigrams (with word edges) and of hashed words.

Defined cases. A text that is null, or has no word character, has no language: ``predicted`` is null and it is
rejected. A text whose trigrams are mostly unknown to the training sample (``coverage`` under ``min_coverage``)
is in none of the trained languages and is rejected too. Every other text is accepted, whatever its length.
Equal texts get equal results; repeated rows yield repeated rows. A null ``doc_id`` is carried along. With an
empty table, or without any labelled row, the model knows no language and rejects every text. Extra columns,
whatever their names, are neither read nor returned by ``identify`` and do not disturb ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import pieces
from cairn.llm.textkernel import Words, words

#: Languages that no family lists form a family of their own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "mr", "ur", "pa", "gu", "ne"],
}
BITS = 11  #: of a feature's number, for trigrams and for words
PER_LANGUAGE = 400  #: the training sample has so many documents a language at most
MIN_COVERAGE = 0.5


def family_of(lang: str) -> str:
    base = lang.split("-")[0].split("_")[0]
    return next((k for k, v in FAMILIES.items() if base in v), f"other:{base}")


def _trigrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """24-bit codes of three bytes around each byte of a word, and the text of each."""
    size = len(w.flat)
    text = np.full(size + 2, 32, np.uint32)
    lens = w.end - w.start
    inside = np.repeat(w.start - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
    text[inside + 1] = w.flat[inside]
    code = text[inside] | (text[inside + 1] << np.uint32(8)) | (text[inside + 2] << np.uint32(16))
    return code, np.repeat(w.row, lens)


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _features(w: Words) -> tuple[np.ndarray, list[np.ndarray]]:
    """Relative frequencies, a row for each text; the different trigrams of each text."""
    n = len(w.offsets) - 1
    code, row = _trigrams(w)
    x = np.zeros((n, 2 << BITS), np.float32)
    np.add.at(x, (row, _slot(code)), np.float32(1))
    np.add.at(x, (w.row, (1 << BITS) + (w.hash >> np.uint64(64 - BITS)).astype(np.int64)), np.float32(1))
    for part in (x[:, : 1 << BITS], x[:, 1 << BITS :]):
        part /= np.maximum(part.sum(1, keepdims=True), 1)
    bounds = np.searchsorted(row, np.arange(n + 1))
    return x, [np.unique(code[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 0.01, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (hinge loss), by dual coordinate descent."""
    scale = 1 / (x.std(0) + 1e-3)
    z = np.hstack([x * scale, np.ones((len(x), 1))]).astype(np.float32)
    norms = np.einsum("ij,ij->i", z, z)
    weights, alpha, rng = np.zeros(z.shape[1], np.float32), np.zeros(len(z)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(z)):
            new = min(max(alpha[i] - (y[i] * float(weights @ z[i]) - 1) / norms[i], 0.0), cost)
            if new != alpha[i]:
                weights += np.float32((new - alpha[i]) * y[i]) * z[i]
                alpha[i] = new
    return (weights[:-1] * scale).astype(np.float32), float(weights[-1])


@dataclass
class Model:
    """Choices are tuples (names, pairs, weights, biases) of one-against-one machines."""

    families: tuple = ((), [], np.zeros((0, 2 << BITS), np.float32), np.zeros(0))
    languages: dict[str, tuple] = field(default_factory=dict)
    known: np.ndarray = field(default_factory=lambda: np.zeros(1 << 21, np.uint8))  #: bitmap of trigrams

    def predict(self, w: Words) -> dict[str, np.ndarray]:
        """family, predicted (object arrays with None), margin, coverage."""
        n = len(w.offsets) - 1
        code, row = _trigrams(w)
        slot, word = _slot(code), (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
        some = np.diff(w.first) > 0
        tri_at, word_at = np.searchsorted(row, np.flatnonzero(some)), w.first[:-1][some]
        tri_n = np.diff(np.r_[tri_at, len(row)])
        word_n = np.diff(w.first)[some]

        def mean(tri: np.ndarray, of_word: np.ndarray | None) -> np.ndarray:
            out = np.add.reduceat(tri, tri_at, dtype=np.float64) / tri_n
            return out if of_word is None else out + np.add.reduceat(of_word, word_at, dtype=np.float64) / word_n

        def choose(machines: tuple) -> tuple[np.ndarray, np.ndarray]:
            names, pairs, weights, biases = machines
            votes = np.zeros((int(some.sum()), len(names)))
            least = np.full(len(votes), np.inf)
            margins = np.zeros((len(pairs), len(votes)))
            for k, (i, j) in enumerate(pairs):
                margins[k] = m = mean(weights[k, : 1 << BITS][slot], weights[k, 1 << BITS :][word]) + biases[k]
                votes[:, i] += (m > 0) + 1e-3 * np.tanh(m)
                votes[:, j] += (m <= 0) - 1e-3 * np.tanh(m)
            best = votes.argmax(1)
            for k, (i, j) in enumerate(pairs):
                least = np.where((best == i) | (best == j), np.minimum(least, np.abs(margins[k])), least)
            return best, least

        out = {k: np.full(n, None, object) for k in ("family", "predicted")} | {k: np.full(n, np.nan) for k in ("margin", "coverage")}
        if some.any():
            out["coverage"][some] = mean((self.known[code >> 3] >> (code & np.uint32(7)).astype(np.uint8)) & 1, None)
        if some.any() and self.families[0]:
            fam, margin = choose(self.families)
            lang = np.full(len(fam), None, object)
            for k, name in enumerate(self.families[0]):
                if (mine := fam == k).any():
                    best, within = choose(self.languages[name])
                    lang[mine] = np.array(self.languages[name][0], object)[best][mine]
                    margin[mine] = np.minimum(margin, within)[mine]
            out["family"][some] = np.array(self.families[0], object)[fam]
            out["predicted"][some] = lang
            out["margin"][some] = margin
        return out


def _one_to_one(sparse: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, names: list[str]) -> tuple:
    pairs, weights, biases = list(combinations(range(len(names)), 2)), [], []
    for i, j in pairs:
        use = np.flatnonzero((labels == names[i]) | (labels == names[j]))
        x = np.zeros((len(use), 2 << BITS), np.float32)
        for row, k in enumerate(use):
            x[row, sparse[k][0]] = sparse[k][1]
        a, b = linear_svm(x, np.where(labels[use] == names[i], 1.0, -1.0))
        weights.append(a)
        biases.append(b)
    return tuple(names), pairs, np.array(weights, np.float32).reshape(len(pairs), 2 << BITS), np.array(biases)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the rows that have ``lang`` and a text with a word in it: of every language the ``per_language``
    documents with the lowest hash of their text. The driver gets their features, sparse, some 2 KiB a document."""
    labelled = docs.select(F.col("lang").alias("lang"), F.col("text").alias("text")).filter("lang is not null and text is not null and lang <> ''")
    counts = labelled.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return Model()
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 3.0 * per_language / r["count"] + 1e-9))).otherwise(share)
    key = F.xxhash64("text")
    few = labelled.withColumn("k", key).filter((F.col("k").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))) < share)
    low = Window.partitionBy("lang").orderBy("k", "text")
    few = few.dropDuplicates(["lang", "k"]).withColumn("n", F.row_number().over(low)).filter(F.col("n") <= per_language).select("lang", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                w = words(part.column("text"))
                some = np.diff(w.first) > 0
                x, codes = _features(w)
                yield pa.RecordBatch.from_pydict({
                    "lang": part.column("lang").filter(pa.array(some)),
                    "at": pa.array([np.flatnonzero(r).astype(np.uint16).tobytes() for r in x[some]], pa.binary()), "x": pa.array([r[r != 0].tobytes() for r in x[some]], pa.binary()),
                    "codes": pa.array([c.tobytes() for c, s in zip(codes, some) if s], pa.binary()),
                })

    rows = few.mapInArrow(extract, "lang string, at binary, x binary, codes binary").toArrow().to_pydict()
    if not rows["lang"]:
        return Model()
    lang = np.array(rows["lang"], object)
    order = sorted(range(len(lang)), key=lambda i: (lang[i], rows["at"][i], rows["x"][i]))
    lang = lang[order]
    sparse = [(np.frombuffer(rows["at"][i], np.uint16), np.frombuffer(rows["x"][i], np.float32)) for i in order]
    fam = np.array([family_of(v) for v in lang], object)
    known = np.zeros(1 << 21, np.uint8)
    code = np.unique(np.frombuffer(b"".join(rows["codes"]), np.uint32))
    np.bitwise_or.at(known, code >> 3, (1 << (code & np.uint32(7))).astype(np.uint8))
    names, own = sorted(set(fam)), lambda f: np.flatnonzero(fam == f)
    within = {f: _one_to_one([sparse[i] for i in own(f)], lang[own(f)], sorted(set(lang[own(f)]))) for f in names}
    return Model(_one_to_one(sparse, fam, names), within, known)


def _apply(docs: DataFrame, model: Model, min_coverage: float, keep: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                p = shared.value.predict(words(part.column("text")))
                ok = np.array([v is not None for v in p["predicted"]], bool) & (np.nan_to_num(p["coverage"]) >= min_coverage)
                if keep:
                    yield part.filter(pa.array(ok))
                else:
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": part.column("doc_id"), "family": pa.array(p["family"], pa.string()), "predicted": pa.array(p["predicted"], pa.string()),
                        "margin": pa.array(p["margin"], from_pandas=True), "coverage": pa.array(p["coverage"], from_pandas=True), "accepted": pa.array(ok),
                    })

    return docs.mapInArrow(run, docs.schema if keep else "doc_id bigint, family string, predicted string, margin double, coverage double, accepted boolean")


def identify(docs: DataFrame, model: Model, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row for each document: doc_id, family, predicted, margin, coverage, accepted."""
    return _apply(docs.select("doc_id", "text"), model, min_coverage, False)


def keep_identified(docs: DataFrame, model: Model, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The accepted rows of ``docs``, with the columns as they are."""
    return _apply(docs, model, min_coverage, True)
