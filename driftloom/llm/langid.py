"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. Three neighbouring letters are bound into one vector, the
product of their vectors after two, one and no rotations; a text's vector is the sum over its letter triples. A
language's prototype is the sum over its training texts, and a text takes the language whose prototype has the
greatest cosine with its own vector. White space and other characters between letters count as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, text_of

DIMENSIONS, SEED = 1024, 20_240_501
#: Letter triples whose vectors a worker keeps, texts that are multiplied together, and triples that are at once.
CACHE_GRAMS, GROUP, SLICE = 16_384, 128, 4_096
UNKNOWN = "und"
_STATE: dict = {}


def is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if "letters" not in _STATE:
        _STATE["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _STATE["letters"]


def letter_vector(code: int) -> np.ndarray:
    vectors = _STATE.setdefault("vectors", {})
    if code not in vectors:
        vectors[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, dtype=np.int8) * np.int8(2) - np.int8(1)
    return vectors[code]


def gram_vector(gram: int) -> np.ndarray:
    a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    known = _STATE.setdefault("grams", {})
    out = np.empty((len(grams), DIMENSIONS), np.float32)
    for i, g in enumerate(grams.tolist()):
        v = known.get(g)
        if v is None:
            v = gram_vector(g)
            if len(known) < CACHE_GRAMS:
                known[g] = v
        out[i] = v
    return out


def grams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letter triples of a text, blanks at both ends included, and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.where(letter, codes, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]  # one blank for each run
    codes = np.concatenate([[0], codes[keep], [0]])
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def text_vectors(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row for each text: the sum of its triples' vectors. Counts are laid out for a slice of the triples at a time."""
    grams, number = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    owner = np.repeat(np.arange(len(found)), [len(g) for g, _ in found])
    order = np.argsort(number, kind="stable")
    number, owner, times = number[order], owner[order], np.concatenate([n for _, n in found])[order]
    out = np.zeros((len(found), DIMENSIONS), np.float32)
    for k in range(0, len(grams), SLICE):
        own = slice(*np.searchsorted(number, (k, k + SLICE)))
        counts = np.zeros((len(found), min(SLICE, len(grams) - k)), np.float32)
        counts[owner[own], number[own] - k] = times[own]
        out += counts @ gram_vectors(grams[k : k + SLICE])
    return out


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """lang to the summed vector of its texts. Tasks add up counts, then send one vector for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            counts: dict[str, dict[int, int]] = {}
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                own = counts.setdefault(lang, {})
                grams, n = grams_of(text.as_py())
                for g, k in zip(grams.tolist(), n.tolist(), strict=True):
                    own[g] = own.get(g, 0) + k
            for lang, own in counts.items():
                grams, n = np.fromiter(own, np.int64, len(own)), np.fromiter(own.values(), np.float64, len(own))
                total = totals.setdefault(lang, np.zeros(DIMENSIONS))
                for k in range(0, len(grams), SLICE):
                    total += n[k : k + SLICE] @ gram_vectors(grams[k : k + SLICE])
        for lang, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total.astype(np.int64))], names=["lang", "dim", "value"])

    rows = dealt(docs.select("text", "lang")).mapInArrow(run, "lang string, dim int, value long")
    summed = rows.groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in summed.collect():  # languages times dimensions
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["dim"]] = r["value"]
    return out


def held_out_of(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score from doc_id and text, with prototypes as the model."""
    langs = sorted(model)
    units = np.stack([model[x] / (np.linalg.norm(model[x]) or 1.0) for x in langs]).astype(np.float32) if langs else np.zeros((0, DIMENSIONS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = [], []
            for k in range(0, batch.num_rows, GROUP):
                found = [grams_of(t.as_py()) for t in batch.column("text")[k : k + GROUP]]
                pred, score = np.full(len(found), UNKNOWN, dtype=object), np.zeros(len(found))
                some = [i for i, (g, _) in enumerate(found) if len(g)]
                if some and langs:
                    vectors = text_vectors([found[i] for i in some])
                    cosines = vectors @ units.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                    best = cosines.argmax(axis=1)
                    pred[some] = [langs[b] for b in best]
                    score[some] = np.clip(cosines[np.arange(len(some)), best], 0.0, 1.0)
                preds += pred.tolist()
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return dealt(docs.select("doc_id", held_out_of().alias("held_out"), text_of().alias("text"))).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from rows that are not held out and have a lang.

    A null text or one without letters is ``und`` with score 0, as is every text if nothing could be learned.
    A null doc_id is never held out. Ties take the first language by code point. Other columns are not read.
    """
    train = docs.where(~held_out_of() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return identify(docs, prototypes(train))
