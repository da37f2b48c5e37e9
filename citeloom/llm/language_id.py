"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1; for each of its bits a logistic classifier over hashed byte
n-grams says which half of the languages a text belongs to. A text's language is the one whose codeword has
the least loss, each bit's loss weighted by how well its classifier does; near ties are flagged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hold, id_and_text, raw_bytes

#: Hashed features, and the longest n-gram in bytes.
FEATURES, LONGEST = 4096, 4
#: Training texts: at most so many of each language (by a hash of id and text), and so many in all.
PER_LANGUAGE, IN_ALL = 500, 20_000
#: Difference of the two best losses (a mean over bits) under which the language is ambiguous.
AMBIGUOUS = 0.15
#: Loss of the nearest codeword from which a text is in none of the languages. No bit says anything at ln 2 = 0.69; learned languages stay under 0.15 but for the shortest texts.
FAR = 0.3
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LETTER = re.compile(rb"[A-Za-z]")


def profile(text: bytes) -> np.ndarray:
    """Square roots of hashed n-gram counts, as a vector of length 1; whole texts, in pieces of bounded size."""
    flat = b" " + b" ".join(text.translate(NORMAL).split()) + b" "
    counts = np.zeros(FEATURES, np.int64)
    for at in range(0, max(1, len(flat) - LONGEST + 1), 1 << 18):
        a = np.frombuffer(flat[at : at + (1 << 18) + LONGEST - 1], np.uint8).astype(np.uint64)
        gram = np.zeros(len(a), np.uint64)
        for n in range(LONGEST):
            gram = gram[: len(a) - n] * np.uint64(256) + a[n:]
            counts += np.bincount((((gram + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64), minlength=FEATURES)
    x = np.sqrt(counts).astype(np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def has_letter(text: bytes) -> bool:
    return bool(LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def codewords(n: int) -> np.ndarray:
    """n distinct rows of +1 and -1: every split of the languages in two if they are few, else well-spread random ones."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 6:
        return np.array([(1, *bits) for bits in product((-1, 1), repeat=n - 1) if -1 in bits], np.float32).T
    length, rng, best = 10 * int(np.ceil(np.log2(n))), np.random.default_rng(11), None
    for _ in range(40):
        c = rng.choice(np.array([-1, 1], np.float32), (n, length))
        near = ((length - c @ c.T) / 2 + length * np.eye(n)).min()
        mixed = (np.abs(c.sum(0)) < n).all()
        if mixed and (best is None or near > best[0]):
            best = (near, c)
    return best[1]


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, rounds: int = 250, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, offsets and reliabilities of the bits' logistic classifiers, by accelerated gradient descent."""
    target = code[y]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    pw, pb, step = w.copy(), b.copy(), 3.0 / (1 + penalty)
    for k in range(rounds):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        pull = target / (1 + np.exp(np.clip(target * (x @ vw + vb), -30, 30)))
        pw, pb = w, b
        w, b = vw + step * (x.T @ pull / len(x) - penalty * vw), vb + step * pull.mean(0) / 2
    right = (np.sign(x @ w + b) == target).mean(0)
    return w, b, np.clip(2 * right - 1, 0.01, 1).astype(np.float32)


def training_rows(docs: DataFrame, label_col: str) -> DataFrame:
    """At most PER_LANGUAGE texts of each language, those with the least hashes; all languages, IN_ALL rows together."""
    docs = docs.select("doc_id", "text", F.col(f"`{label_col}`").cast("string").alias("lang"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("h")).where("text is not null and lang is not null")
    counts = docs.groupBy("lang").count().collect()
    each = max(1, min(PER_LANGUAGE, IN_ALL // max(1, len(counts))))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, 4 * each / r["count"]))]) if counts else None
    if share is None:
        return docs.select("lang", "text")
    near = docs.where((F.col("h").cast("double") / float(2**64) + 0.5) <= share[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    return near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("lang", "text")


def fit(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model from labelled rows: languages, codewords and the bits' classifiers. The sample is bounded; see training_rows."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("languages")
        for batch in batches:
            rows = [profile(t).astype(np.float16).tobytes() for t in raw_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "x"])

    rows = docs.withColumns({"doc_id": F.col(f"`{id_col}`").cast("long"), "text": F.col(f"`{text_col}`").cast("string")})
    got = sorted((r.lang, bytes(r.x)) for r in training_rows(rows, label_col).mapInArrow(features, "lang string, x binary").collect())
    languages = sorted({lang for lang, _ in got})
    code = codewords(len(languages))
    if len(languages) < 2:
        return {"languages": languages, "code": code, "w": np.zeros((FEATURES, 1), np.float32), "b": np.ones(1, np.float32), "reliability": np.ones(1, np.float32)}
    x = np.stack([np.frombuffer(x, np.float16) for _, x in got]).astype(np.float32)
    w, b, reliability = fit_bits(x, np.array([languages.index(lang) for lang, _ in got]), code)
    return {"languages": languages, "code": code, "w": w, "b": b, "reliability": reliability}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword (of equal ones the first), its score (a softmax of minus the losses), the ambiguity flag and its loss, for each row of x."""
    margins = x @ model["w"] + model["b"]
    share = model["reliability"] / model["reliability"].sum()
    loss = (np.log1p(np.exp(np.clip(-margins[:, None, :] * model["code"][None], -30, 30))) * share).sum(2)
    odds = np.exp(-loss.astype(np.float64) * model["code"].shape[1])
    odds /= odds.sum(1, keepdims=True)
    best = loss.argmin(1)
    ordered = np.sort(loss, 1)
    near = ordered[:, 1] - ordered[:, 0] < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(len(x), bool)
    return best, odds[np.arange(len(x)), best], near, ordered[:, 0]


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score, ambiguous, loss (of the nearest codeword).

    `und` with score 0 and no loss where the text is null, empty or without a letter, or where no language was learned.
    Null ids stay, ids that aren't whole numbers raise, repeated rows get a row each; of languages equally near the first by
    name is taken, flagged as ambiguous; very long texts are read whole, in pieces; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("languages")
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = raw_bytes(batch.column(1))
                real = np.array([bool(m["languages"]) and has_letter(t) for t in texts], bool)
                names, scores, near, losses = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.full(len(texts), np.nan)
                if real.any():
                    best, score, close, loss = decode(m, np.stack([profile(t) for t, ok in zip(texts, real, strict=True) if ok]))
                    for i, k in zip(np.flatnonzero(real), best, strict=True):
                        names[i] = m["languages"][k]
                    scores[real], near[real], losses[real] = score, close, loss
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores), pa.array(near), pa.array(losses, from_pandas=True)], names=["doc_id", "lang_pred", "score", "ambiguous", "loss"])

    return id_and_text(docs, id_col, text_col).mapInArrow(guess, "doc_id long, lang_pred string, score double, ambiguous boolean, loss double")


def keep_identified(docs: DataFrame, model: dict, far: float = FAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose language is `und` or that are as far as `far` from every codeword; all columns, no shuffle.

    A softmax can't tell a text of no learned language, as some language is always the nearest; the loss itself can."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("languages")
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = raw_bytes(batch.column(batch.schema.get_field_index(text_col)))
                keep = np.array([bool(m["languages"]) and has_letter(t) for t in texts], bool)
                if keep.any():
                    keep[keep] = decode(m, np.stack([profile(t) for t, ok in zip(texts, keep, strict=True) if ok]))[3] < far
                    yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % parts == part, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out and predict all: doc_id, held_out, lang_pred, score, ambiguous.

    Rows with a null text or lang are not learned from; repeated rows count as they come; extra columns are ignored."""
    found = predict(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous", "loss")
