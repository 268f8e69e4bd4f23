"""Language identification by string kernels.

A text is the set of its character n-grams of lengths 1 to 4 (a blended
spectrum, presence only), hashed to 2^14 numbers.  The kernel of two texts is
the size of their sets' intersection over the geometric mean of their sizes.
A few landmark texts of every language give a Nyström map, on which kernel
ridge regression is fitted one-versus-rest.  A batch of texts is scored by two
matrix products: presence x landmarks gives the kernel block, kernel block x
coefficients the class values.

The class values of a text sum to 2 - C over C classes, whatever the text, so
no score tells a text of no learned language.  Its *likeness* does: the share
of its n-grams that one landmark holds (of the landmark's, if that has fewer),
less what chance gives sets of these sizes (0: chance, 1: all).  ``Model.least`` is the bound for it,
LIKENESS times what all but LIKE_SHARE of the training texts reach with landmarks other
than themselves.

Training takes at most ``per_class`` texts of each language, those with the
smallest hashes of their id (rows that repeat an id count as one), and of these ``landmarks`` are landmarks; both are
parameters.  Many languages give fewer each, but every language is learned.  Executors turn whole texts into sets, so a training text brings at
most 2^14 numbers to the driver.  Scoring takes whole texts as well.

Defined results: null text and text without any letter is ``und`` with score
0; rows that repeat a doc_id are scored one by one; null doc_ids stay null and
are never trained on; other columns don't enter a prediction; an empty table
gives an empty one; without any labelled text everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, pieces

ORDERS, BITS = 4, 14
PER_CLASS, LANDMARKS, RIDGE = 400, 32, 1e-3
#: Training texts and landmarks of all languages together, but one each at least.
MOST_SAMPLE, MOST_LANDMARKS = 20_000, 6_400
#: Texts of less than LIKENESS times the likeness that all but LIKE_SHARE of the training texts reach are of no learned language.
LIKENESS, LIKE_SHARE = 0.6, 0.01
_MULTIPLIER = np.uint32(0x9E3779B1)


def gram_ids(text: str) -> np.ndarray:
    """Hash numbers of all n-grams of the lower-cased text, repeats included."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, code = [], np.zeros(0, np.uint32)
    for n in range(1, ORDERS + 1):
        if len(cp) < n:
            break
        code = cp + np.uint32(1) if n == 1 else code[:-1] * np.uint32(0x01000193) + cp[n - 1 :] + np.uint32(n)
        mixed = (code ^ (code >> np.uint32(15))) * _MULTIPLIER
        out.append(mixed >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def presence(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
    for row, t in zip(x, texts, strict=True):
        row[gram_ids(t)] = 1
    return x


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    def __init__(self, classes: list[str], landmarks: np.ndarray, coefficients: np.ndarray, least: float = 0.0):
        self.classes, self.landmarks, self.coefficients, self.least = classes, landmarks, coefficients, least
        self.sizes = (landmarks > 0).sum(0)

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        x = presence(texts)
        size = np.maximum(x.sum(1, keepdims=True), 1)
        return (x @ self.landmarks) / np.sqrt(size), size

    def values(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts)[0] @ self.coefficients[:-1] + self.coefficients[-1]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and likeness of each text."""
        names, scores, like = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        able = [k for k, t in enumerate(texts) if has_letter(t)] if self.classes else []
        for i in range(0, len(able), 64):
            rows = able[i : i + 64]
            kernel, size = self.kernel([texts[k] for k in rows])
            v = kernel @ self.coefficients[:-1] + self.coefficients[-1]
            best = v.argmax(1)
            for k, c, top, near in zip(rows, best, v.max(1), likeness(kernel, size, self.sizes).max(1), strict=True):
                names[k], scores[k], like[k] = self.classes[c], float(np.clip((float(top) + 1) / 2, 0, 1)), float(near)
        return names, scores, like

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.judge(texts)[:2]


def likeness(kernel: np.ndarray, size: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of texts (rows) and landmarks: the part of the smaller set that the larger holds, 0 for as much as chance gives.

    A landmark smaller than the text and than half of the landmarks says nothing of it.
    """
    chance = np.maximum(size, sizes) / (1 << BITS)
    like = (kernel * np.sqrt(size * sizes) / np.maximum(np.minimum(size, sizes), 1) - chance) / np.maximum(1 - chance, 1e-3)
    return np.where(sizes >= np.minimum(size, np.median(sizes)), like, 0)


def _sets(batches):
    for b in batches:
        for i, j in pieces(b, "text"):
            sets = [np.unique(gram_ids(t)).astype("<u2").tobytes() for t in b.column("text")[i:j].to_pylist()]
            yield {"lang": b.column("lang")[i:j], "u": b.column("u")[i:j], "share": b.column("share")[i:j], "doc_id": b.column("doc_id")[i:j], "grams": sets}


def train(sets: list[np.ndarray], labels: list[str], *, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström features of ``landmarks`` sets a class, and a ridge solution of +1/-1 targets for each class."""
    classes = sorted(set(labels))
    if not classes:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((1, 0), np.float32))
    y = np.array(labels)
    marks = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in classes])
    land = np.zeros((1 << BITS, len(marks)), dtype=np.float32)
    for col, k in enumerate(marks):
        land[sets[k], col] = 1 / np.sqrt(max(1, len(sets[k])))
    kernel = np.array([land[s].sum(0) / np.sqrt(max(1, len(s))) for s in sets], dtype=np.float64)
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ root
    phi1 = np.c_[phi, np.ones(len(phi))]
    target = np.where(y[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    # each class counts alike
    weight = 1 / np.array([(y == c).sum() for c in y])
    weight *= len(y) / weight.sum()
    gram = (phi1 * weight[:, None]).T @ phi1
    solved = np.linalg.solve(gram + ridge * len(y) * np.diag(np.r_[np.ones(phi.shape[1]), 1e-6]), (phi1 * weight[:, None]).T @ target)
    coefficients = np.r_[root @ solved[:-1], solved[-1:]]
    like = likeness(kernel, np.array([max(1, len(s)) for s in sets])[:, None], (land > 0).sum(0))
    like[marks, np.arange(len(marks))] = -1
    least = LIKENESS * max(0.0, float(np.quantile(like.max(1), LIKE_SHARE)))
    return Model(classes, land, coefficients.astype(np.float32), least)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(spark: SparkSession, docs: DataFrame, *, per_class: int = PER_CLASS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Trains on labelled documents that aren't held out."""
    pool = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    pool = pool.where(F.col("text").rlike(r"\p{L}"))
    rank = F.xxhash64(F.lit(11), "doc_id").bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))
    sizes = pool.groupBy("lang").agg(F.count("*").alias("n"), F.min(rank).alias("least")).collect()
    sets, labels = [], []
    if sizes:
        per_class = max(1, min(per_class, MOST_SAMPLE // len(sizes)))
        landmarks = max(1, min(landmarks, MOST_LANDMARKS // len(sizes)))
        # about 1.5 per_class rows of a language pass the threshold, whatever its size, and one at least
        share = spark.createDataFrame([(r["lang"], max(r["least"], min(1.0, 1.5 * per_class / r["n"]))) for r in sizes], "lang string, share double")
        few = pool.select("lang", rank.alias("u"), F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(share), "lang").where("u <= share")
        # rows that repeat a doc_id count as one; the order settles which rows are taken, wherever they lie
        few = few.groupBy("lang", "doc_id").agg(F.min("u").alias("u"), F.min("share").alias("share"), F.min("text").alias("text"))
        few = map_arrow(few, "lang string, u double, share double, doc_id long, grams binary", _sets)
        by: dict[str, list] = {}
        for r in few.orderBy(F.col("u") / F.col("share"), "lang", "doc_id").limit(2 * per_class * len(sizes)).collect():
            by.setdefault(r["lang"], []).append((r["u"], r["doc_id"], bytes(r["grams"])))
        for lang in sorted(by):
            for _, _, grams in sorted(by[lang])[:per_class]:
                sets.append(np.frombuffer(grams, dtype="<u2").astype(np.int64))
                labels.append(lang)
    return train(sets, labels, landmarks=landmarks, ridge=ridge)


def _predict(batches, model):
    model = model.value
    for b in batches:
        for i, j in pieces(b, "text"):
            names, scores, like = model.judge(b.column("text")[i:j].to_pylist())
            yield {"lang_pred": pa.array(names), "score": pa.array(scores, pa.float64()), "likeness": pa.array(like, pa.float64())} | {c: b.column(c)[i:j] for c in b.schema.names if c != "text"} | {"text": b.column("text")[i:j]}


def predict(spark: SparkSession, rows: DataFrame, model: Model) -> DataFrame:
    """rows(text, ...) with lang_pred, score and likeness."""
    rest = [c for c in rows.columns if c not in ("lang_pred", "score", "likeness")]
    rows = rows.select(*rest)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("likeness", T.DoubleType())])
    return map_arrow(rows, schema, _predict, spark.sparkContext.broadcast(model))


def identify(spark: SparkSession, docs: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    model = fit(spark, docs, **params)
    own = docs.select(F.col("doc_id"), F.col("text"))
    out = predict(spark, own, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
