"""Language ID by string kernels.

Texts are compared by the n-grams that both hold, of lengths one to three blended (presence kernels on the bytes of the
whole lower-cased text, hashed into a fixed number of slots, each text scaled to unit length). A bounded sample of
labelled rows gives landmarks for a Nyström map and the rows of a one-versus-rest kernel ridge regression; the model is
one landmark matrix and one coefficient matrix, so scoring is two matrix products a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 1 << 14
GRAMS = (1, 2, 3)
#: Labelled rows that the model is fitted on, at most, and those of one language.
SAMPLE_ROWS, SAMPLE_PER_LANGUAGE = 4096, 400
#: Rows of a language that are ranked for the sample, as a multiple of those it may give.
MARGIN = 4
LANDMARKS = 256
RIDGE = 1e-4
BATCH_ROWS = 256
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def presence(text: str, out: np.ndarray) -> None:
    """Marks the slots of the n-grams that the text holds."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = np.zeros(len(data), np.uint32)
    for n in GRAMS:
        code = (code[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
        out[((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(18)] = 1


def features(texts: list[str]) -> np.ndarray:
    """Unit rows of presence."""
    x = np.zeros((len(texts), SLOTS), np.float32)
    for i, text in enumerate(texts):
        presence(text, x[i])
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    x /= np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
    return x


def _unpacked(packed: np.ndarray) -> np.ndarray:
    return _unit(np.unpackbits(packed, axis=1).astype(np.float32))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        return (features(texts) @ self.landmarks) @ self.weights + self.bias


def fit(packed: np.ndarray, labels: list[str], ridge: float = RIDGE, landmarks: int = LANDMARKS) -> Model:
    """Kernel ridge regression on the Nyström features of packed presence rows; landmarks take the languages in turn. Few rows are unpacked at a time."""
    languages = sorted(set(labels))
    names = np.array([languages.index(x) for x in labels])
    turn = np.zeros(len(names), np.int64)
    for c in range(len(languages)):
        turn[names == c] = np.arange((names == c).sum())
    chosen = np.lexsort((names, turn))[:landmarks]
    marks = _unpacked(packed[chosen])
    kernel = np.concatenate([_unpacked(packed[i : i + BATCH_ROWS]) @ marks.T for i in range(0, len(packed), BATCH_ROWS)]).astype(np.float64)
    square = kernel[chosen]
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = kernel @ root
    target = np.where(names[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(names, minlength=len(languages))[names]
    weight = (weight / weight.mean())[:, None]
    middle, offset = (phi * weight).mean(axis=0), (target * weight).mean(axis=0)
    x = phi - middle
    beta = np.linalg.solve(x.T @ (x * weight) + ridge * len(x) * np.eye(x.shape[1]), x.T @ ((target - offset) * weight))
    return Model(languages, np.ascontiguousarray(marks.T), (root @ beta).astype(np.float32), (offset - middle @ beta).astype(np.float32))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2, per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from at most ``rows`` labelled rows, ``per_language`` of each language, the first in the order of a hash of their id.

    Of more than ``rows`` languages the most frequent count. Only rows with a language and a letter, outside the held-out fold: others take no place in
    the sample. Ids with one hash go by id, repeated rows count once. None where there are none. Other columns aren't read.
    """
    labelled = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    labelled = labelled.where("lang is not null").where(F.col("text").rlike(r"\p{L}")).where(fold_of(F.col("doc_id"), folds) != held_fold)
    keys = labelled.where("doc_id is not null").select("doc_id", "lang", F.xxhash64(F.lit("language"), "doc_id").alias("key"))
    # Only the low end of the hash range of a language is ranked: some MARGIN times what it may give, whatever its size.
    share = keys.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(rows)  # a sample holds no more languages
    share = share.select("lang", F.least(F.lit(1.0), F.lit(MARGIN * per_language) / F.col("n")).alias("share"))
    low = keys.join(F.broadcast(share), "lang").where(F.col("key") / F.lit(2.0**64) + 0.5 <= F.col("share")).select("doc_id", "lang", "key").distinct()
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))).where(F.col("rank") <= per_language)
    chosen = F.broadcast(ranked.orderBy("rank", "lang").limit(rows).select("doc_id", "lang", "rank"))  # at most ``rows`` ids

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if has_letter(t) else None for t in batch.column("text").to_pylist()]
            bits = []
            for t in texts:
                mark = np.zeros(SLOTS, np.uint8)
                if t is not None:
                    presence(t, mark)
                bits.append(np.packbits(mark).tobytes() if t is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("lang"), pa.array(bits, pa.binary())], names=["rank", "lang", "bits"])

    # The driver gets 2 KB for each row of the sample; of rows with one id and language, one counts.
    packed = labelled.join(chosen, ["doc_id", "lang"]).select("rank", "lang", "text").mapInArrow(pack, "rank int, lang string, bits binary").where("bits is not null")
    found = sorted((r["rank"], r["lang"], bytes(r["bits"])) for r in packed.groupBy("rank", "lang").agg(F.min("bits").alias("bits")).collect())
    if not found:
        return None
    return fit(np.frombuffer(b"".join(b for _, _, b in found), np.uint8).reshape(len(found), -1), [lang for _, lang, _ in found])


def fold_of(id_, folds: int):
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def predict_languages(docs: DataFrame, model: Model | None, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) and the columns in ``keep``, prefixed ``kept_``, a row for each row of docs.

    Whole texts, of any length. ``und`` with score 0 for null texts, texts without a letter, and without a model. score: how far
    the best one-versus-rest output is from -1 to 1, on 0 to 1; of equal outputs the language that sorts first wins. Copies get the same;
    an empty table gives no rows.
    """
    keep = keep or []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"kept_{c}") for c in keep])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks * slots numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if held is not None and has_letter(t)]
            for k in range(0, len(known), BATCH_ROWS):
                part = known[k : k + BATCH_ROWS]
                out = held.scores([texts[i] for i in part])
                for i, best, top in zip(part, out.argmax(axis=1).tolist(), out.max(axis=1).tolist(), strict=True):
                    langs[i], scores[i] = held.languages[best], min(1.0, max(0.0, (top + 1) / 2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *[batch.column(f"kept_{c}") for c in keep]], names=["doc_id", "lang_pred", "score", *[f"kept_{c}" for c in keep]])

    return rows.mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", "lang_pred string, score double", *[f"`kept_{c}` {kinds[f'kept_{c}']}" for c in keep]]))
