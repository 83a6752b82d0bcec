"""Language identification by nearest centroid.

A text is a vector of hashed letter n-grams (two and three characters, lower case, anything but letters
a blank), log term frequency times inverse document frequency, normalised. Each language has
several centroids (spherical k-means); the nearest by cosine names the language, and a
text too far from all of them for its length is rejected.

The model is fitted on a bounded sample of labelled rows (`fit_rows`, shared evenly by the
languages, chosen by hash). Prediction reads every text whole.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_prefix, tune

#: Hashed n-gram bins.
BINS = 8192
#: Labelled rows to fit on, over all languages.
FIT_ROWS = 2400
_LENGTHS = 24


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def count_ngrams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (texts x BINS) and the number of letters of each text."""
    lowered = [t.lower() if t else "" for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(texts))
    codes = np.frombuffer((" ".join(["", *lowered]) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32)) * np.uint32(0x9E3779B1)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)  # a text and the blank before it
    owner = np.append(owner, len(texts) - 1)
    row = owner * BINS
    two = codes[:-1] * np.uint32(0x85EBCA6B) + codes[1:]
    three = two[:-1] * np.uint32(0xC2B2AE35) + codes[2:]
    # an n-gram counts if its last or middle character is a letter; it belongs to the text of its last
    keep2, keep3 = letter[:-1] | letter[1:], letter[1:-1]
    at2 = np.minimum(row[1:], row[:-1])[keep2] + ((two[keep2] ^ (two[keep2] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int64)
    at3 = row[1:-1][keep3] + ((three[keep3] ^ (three[keep3] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)).astype(np.int64)
    counts = np.bincount(at2, minlength=len(texts) * BINS) + np.bincount(at3, minlength=len(texts) * BINS)
    return counts.reshape(len(texts), BINS), np.bincount(owner[letter], minlength=len(texts))


def _slices(texts: list, rows: int = 48, characters: int = 400_000):
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= characters or i + 1 - at == rows:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


@dataclass
class CentroidModel:
    languages: list[str]
    label: np.ndarray  # centroid -> index of its language
    centroids: np.ndarray  # centroids x BINS, unit length
    idf: np.ndarray
    least: np.ndarray  # by log2 of the number of letters: the cosine below which a text is rejected

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.zeros(counts.shape, np.float32)
        at = counts.nonzero()
        x[at] = np.log1p(counts[at].astype(np.float32)) * self.idf[at[1]]
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        return x / np.maximum(norm, 1e-9)[:, None]

    def predict(self, texts: list) -> tuple[list, np.ndarray, np.ndarray]:
        """Language ('und' without letters or model), cosine of the nearest centroid, rejected."""
        names, scores, far = [], [], []
        for piece in _slices(texts):
            counts, letters = count_ngrams(texts[piece])
            if not self.languages:
                names += ["und"] * len(letters)
                scores.append(np.zeros(len(letters)))
                far.append(np.ones(len(letters), bool))
                continue
            cosine = self.vectors(counts) @ self.centroids.T
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
            bare = letters == 0
            names += ["und" if b else self.languages[self.label[k]] for k, b in zip(best, bare)]
            scores.append(np.where(bare, 0.0, score))
            far.append(bare | (score < self.least[np.log2(np.maximum(letters, 1)).astype(int).clip(0, _LENGTHS - 1)]))
        return names, np.concatenate(scores) if scores else np.empty(0), np.concatenate(far) if far else np.empty(0, bool)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other. At most k unit centroids."""
    centres = [x.mean(axis=0)]
    centres[0] /= max(np.linalg.norm(centres[0]), 1e-9)
    nearest = x @ centres[0]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[nearest.argmin()])
        nearest = np.maximum(nearest, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        member = (x @ c.T).argmax(axis=1)
        c = np.stack([x[member == i].mean(axis=0) if (member == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(docs: DataFrame, training: Column, *, clusters: int = 4, fit_rows: int = FIT_ROWS, slack: float = 0.5) -> CentroidModel:
    """Fit on rows where `training` holds and text and lang are not null.

    fit_rows distinct rows at most, shared evenly by the languages: those of least hash of doc_id and text, so
    null or repeated doc_id do no harm and copies count once. An empty table gives a model without languages. The
    distance limit is `slack` times a low quantile of the cosine that training texts and
    beginnings of them reach at each length."""
    tune(docs.sparkSession)
    order = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(5)).bitwiseAND(F.lit((1 << 63) - 1))
    rows = docs.where(training & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string"), order.alias("order"), F.col("text").cast("string").alias("text"))
    totals = {r["lang"]: r["n"] for r in rows.select("lang", "order").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return CentroidModel([], np.empty(0, int), np.empty((0, BINS), np.float32), np.ones(BINS, np.float32), np.zeros(_LENGTHS))
    each = max(1, fit_rows // len(totals))
    # twice the rows wanted on average, so that enough are there for any hash; then exactly the least
    limit = F.element_at(F.create_map([F.lit(x) for s, n in totals.items() for x in (s, int((1 << 63) * min(1.0, 2 * each / n + 8 / n) - (1 << 10)))]), F.col("lang"))
    chosen = rows.where(F.col("order") <= limit).groupBy("lang", "order").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    chosen = chosen.withColumn("place", place).where(F.col("place") <= each).drop("place")

    def run(batches):
        for pdf in batches:
            out = []
            for lang, where, text in zip(pdf["lang"], pdf["order"], pdf["text"]):
                piece = text[: 8 << (where % 7)]
                for kind, t in ((0, text), (1, piece)):
                    counts, letters = count_ngrams([t])
                    at = counts[0].nonzero()[0]
                    out.append((lang, where, kind, int(letters[0]), at.astype("<u2").tobytes(), counts[0][at].astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["lang", "order", "kind", "letters", "bins", "counts"])

    found = chosen.mapInPandas(run, "lang string, order long, kind int, letters long, bins binary, counts binary").toPandas()
    found = found.sort_values(["lang", "order", "letters"]).reset_index(drop=True)

    def dense(part):
        x = np.zeros((len(part), BINS), np.float32)
        for i, (bins, counts) in enumerate(zip(part["bins"], part["counts"])):
            x[i, np.frombuffer(bins, "<u2")] = np.frombuffer(counts, "<f4")
        return x

    whole = found[(found["kind"] == 0) & (found["letters"] > 0)]
    df = np.zeros(BINS)
    for bins in whole["bins"]:
        df[np.frombuffer(bins, "<u2")] += 1
    model = CentroidModel(sorted(totals), np.empty(0, int), np.empty((0, BINS), np.float32), (np.log((1 + len(whole)) / (1 + df)) + 0.1).astype(np.float32), np.zeros(_LENGTHS))
    label, centres = [], []
    for k, lang in enumerate(model.languages):
        own = whole[whole["lang"] == lang]
        if len(own):
            c = _clusters(model.vectors(dense(own)), clusters)
            centres.append(c)
            label += [k] * len(c)
    model.label, model.centroids = np.array(label, int), np.concatenate(centres).astype(np.float32) if centres else np.empty((0, BINS), np.float32)
    if not centres:
        model.languages = []
        return model
    reached: list[list[float]] = [[] for _ in range(_LENGTHS)]
    for at in range(0, len(found), 400):
        part = found.iloc[at : at + 400]
        best = (model.vectors(dense(part)) @ model.centroids.T).max(axis=1)
        for n, s in zip(part["letters"], best):
            reached[min(_LENGTHS - 1, int(np.log2(max(n, 1))))].append(float(s))
    low = [slack * float(np.quantile(r, 0.005)) if len(r) >= 50 else np.nan for r in reached]
    known = [i for i, x in enumerate(low) if x == x]
    if known:
        model.least = np.interp(np.arange(_LENGTHS), known, [low[i] for i in known], left=0.0)
    return model


def identify(docs: DataFrame, model: CentroidModel, names: str = "") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected; `names` stands before these three.

    'und', score 0 and rejected for null texts and texts without a letter. Only the text is
    read. Other columns are kept; those named like a result are replaced. Repeated rows and null doc_id are
    treated like any other row; an empty table gives no rows."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x clusters x BINS floats

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def named(texts: pd.Series) -> pd.DataFrame:
        found, score, far = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": found, "score": score, "rejected": far})

    results = ["lang_pred", "score", "rejected"]
    kept = [c for c in docs.columns if c not in [names + r for r in results]]
    own = own_prefix(docs, "_own" + names)
    return docs.select(*kept, named(F.col("text").cast("string")).alias(own)).select(*kept, *(F.col(f"{own}.{r}").alias(names + r) for r in results))
