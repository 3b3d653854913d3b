"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated difference of sizes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .arrowmap import annotate
from .common import crc_mod

#: Labelled documents of each class, about, from which dictionaries and calibration are fitted, half each.
SAMPLE_DOCS = 1200
#: Bytes of the longest text in that sample, and pieces of a dictionary's texts, drawn at random, that it is trained on.
SAMPLE_BYTES, SAMPLE_PIECES = 1 << 18, 6000
#: Bytes of a dictionary, of the pieces it is built from, and of the blocks in which a text is compressed.
DICT_BYTES, PIECE, BLOCK = 112 << 10, 1024, 256
LEVEL = 3


def _blocks(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


class QualityModel:
    """Two dictionaries and the weights of the calibration."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights
        self._coders = None

    def __getstate__(self):
        return self.__dict__ | {"_coders": None}

    def features(self, text: str | None) -> np.ndarray:
        """1, the normalised difference of compressed sizes, the same times the compressibility, the compressibility."""
        import zstandard

        if self._coders is None:
            self._coders = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw) if raw else None
                if d is not None:
                    d.precompute_compress(level=LEVEL)
                self._coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        raw = (text or "").encode()
        if not raw:
            return np.array([1.0, 0.0, 0.0, 1.0])
        a = b = 0
        good, bad = self._coders
        for block in _blocks(raw, BLOCK):
            a += len(good.compress(block))
            b += len(bad.compress(block))
        d, r = (b - a) / (a + b), (a + b) / (2 * len(raw))
        return np.array([1.0, d, d * r, r])

    def score(self, text: str | None) -> float:
        z = float(self.features(text) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method for the regularised log likelihood."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes], rng: np.random.Generator, sample_pieces: int = SAMPLE_PIECES) -> bytes:
    import zstandard

    pieces = [p for t in texts for p in _blocks(t, PIECE)]
    rng.shuffle(pieces)
    pieces = pieces[:sample_pieces]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(pieces)[:DICT_BYTES]


def fit_texts(good: list[str], bad: list[str], share_good: float) -> QualityModel:
    """Dictionaries from every other text of each class, calibration on the others, weighed to the classes' shares."""
    rng = np.random.default_rng(7)
    good, bad = sorted(set(good)), sorted(set(bad))
    if not good or not bad:
        z = np.log(max(share_good, 1e-3) / max(1 - share_good, 1e-3))
        return QualityModel(b"", b"", np.array([z, 0.0, 0.0, 0.0]))
    rng.shuffle(good)
    rng.shuffle(bad)
    half = lambda x: x[: max(1, len(x) // 2)]
    rest = lambda x: x[max(1, len(x) // 2) :] or x
    model = QualityModel(_dictionary([t.encode() for t in half(good)], rng), _dictionary([t.encode() for t in half(bad)], rng), np.zeros(4))
    x = np.array([model.features(t) for t in [*rest(good), *rest(bad)]])
    y = np.array([1.0] * len(rest(good)) + [0.0] * len(rest(bad)))
    w = _logistic(x, y)
    # the sample's share of good documents is not the labels': move the constant
    sampled = y.mean()
    w[0] += np.log(share_good / (1 - share_good)) - np.log(sampled / (1 - sampled)) if 0 < share_good < 1 else 0.0
    return QualityModel(model.good, model.bad, w)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Learn from about sample_docs labelled documents of each class, chosen by a hash of the id, none over sample_bytes.

    docs: doc_id and text; labels: doc_id and quality (1 good, 0 bad; others count not). Counts of the classes cover all
    labels; what comes to the driver is the bounded sample, and what is broadcast are its ids. Null texts and ids teach
    nothing; of repeated rows one counts; an empty table gives a model that knows the classes' shares alone.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    sizes = {int(r[0]): r[1] for r in known.groupBy("quality").count().collect()}
    if not sizes:
        return fit_texts([], [], 0.5)
    rate = F.coalesce(*[F.when(F.col("quality") == k, F.lit(int(min(1.0, sample_docs / n) * 1_000_000))) for k, n in sizes.items()])
    ids = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(1_000_000)) < rate).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(ids), "doc_id").filter(F.octet_length("text") <= sample_bytes).select("text", "quality").collect()
    return fit_texts([r[0] for r in rows if r[1] == 1], [r[0] for r in rows if r[1] == 0], sizes.get(1, 0) / sum(sizes.values()))


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """docs with quality_score, the probability that the label is 1 (a column of that name is replaced).

    A text is compressed whole, in blocks of BLOCK bytes, with either dictionary; the difference of the sums by their
    total, with the compressibility, goes through a logistic curve fitted on held-back labelled documents. Null and
    empty texts have difference 0 and their own calibrated score; equal texts, repeated rows among them, score alike; an
    empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries

    def make():
        model = sent.value
        return lambda column: [[model.score(t) for t in column.to_pylist()]]

    return annotate(docs, text, [StructField("quality_score", DoubleType())], make)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = fit(docs.filter(~held_out), labels.filter(~held_out))
    out = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"))
