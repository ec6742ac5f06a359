"""Phrase collocations: all n-grams as rows, counted for each language, scored by their weakest cut.

Lengths are counted one after the other. A phrase that is told ``least`` times holds no shorter one that is told less
often, so an n-gram is exploded only if both (n - 1)-grams in it may be frequent: a broadcast filter of at most MOST_BITS
bits says so, without a false no. Tasks merge equal n-grams before rows are exchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, passing, stored

MAX_WORDS, LEAST, COVERED, BEST = 4, 30, 80, 2_000
SCALE = 2_000_000
#: Bits of the filter for each frequent phrase, and the fewest and most of all: 128 KB to 32 MB.
BITS_EACH, FEWEST_BITS, MOST_BITS = 32, 1 << 20, 1 << 28
#: Parts of a word's table, and of a language's ranks.
SALTS = 32

# Bytes that end a piece, and those that end a word within one.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_KIND[list(b" \t")] = 1
_CHUNK, _BLOCK, _HELD, _SLICE = 1 << 21, 1 << 18, 150_000, 256
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = [(_powers(b), _powers(pow(b, -1, 1 << 64))) for b in _BASES]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _long(word: bytes) -> tuple[int, int]:
    import hashlib

    digest = hashlib.blake2b(word, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")


class Words:
    """The words of some lower-cased texts that line ends part: places, pieces and two digests of each."""

    def __init__(self, raw: bytes, langs: np.ndarray, ends: np.ndarray) -> None:
        """langs: a number for each text; ends: where each text ends in raw."""
        self.raw, data = raw, np.frombuffer(raw, np.uint8)
        kinds = _KIND[data]
        edges = np.diff((kinds == 0).astype(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.piece = np.searchsorted(np.flatnonzero(kinds == 2), self.starts)
        self.lang = langs[np.searchsorted(ends, self.starts, side="right")]
        plain = data[self.ends[:-1]] == 32  # one blank, and the next word
        self.plain = np.append(plain & (self.starts[1:] == self.ends[:-1] + 1), False)
        self.digests = self._digests(data)

    def _digests(self, data: np.ndarray) -> list[np.ndarray]:
        """Polynomial digests of the words by running sums, a block of some bytes at a time."""
        out, k = [np.empty(len(self.starts), np.uint64) for _ in _BASES], 0
        while k < len(self.starts):
            at = self.starts[k]
            last = int(np.searchsorted(self.ends, at + _BLOCK, side="right"))
            if last <= k:  # a word that is longer than a block
                out[0][k], out[1][k] = _long(self.raw[at : self.ends[k]])
                k += 1
                continue
            part = data[at : self.ends[last - 1]].astype(np.uint64) + np.uint64(1)
            first, after = self.starts[k:last] - at, self.ends[k:last] - at
            for digest, (up, down) in zip(out, _POWERS, strict=True):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)])
                digest[k:last] = mixed((sums[after] - sums[first]) * down[first])
            k = last
        return out

    def grams(self, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The first words of all n-grams within pieces, and two digests of each, which depend on the language."""
        at = np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :]) if len(self.piece) >= n else np.empty(0, np.int64)
        out = []
        for base, digest in zip(_BASES, self.digests, strict=True):
            h = self.lang[at] * np.uint64(base) + np.uint64(n)
            for k in range(n):
                h = h * np.uint64(base) + digest[at + k]
            out.append(h)
        return at, [mixed(out[0]), out[1]]

    def phrases(self, at: np.ndarray, n: int) -> list[bytes]:
        """The texts of n-grams, with one blank between words."""
        raw, plain = self.raw, np.ones(len(at), bool)
        for k in range(n - 1):
            plain &= self.plain[at + k]
        out = [raw[s:e] for s, e in zip(self.starts[at].tolist(), self.ends[at + (n - 1)].tolist(), strict=True)]
        for k in np.flatnonzero(~plain).tolist():
            out[k] = b" ".join(out[k].split())
        return out


def told(words: Words, n: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """First words and counts of the distinct n-grams whose two (n - 1)-grams the filter lets through."""
    at, (one, two) = words.grams(n)
    if allowed is not None:
        shorter, (digest, _) = words.grams(n - 1)
        free = np.zeros(len(words.starts) + 1, bool)
        place = digest & np.uint64(len(allowed) * 8 - 1)
        free[shorter] = (allowed[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
        good = free[at] & free[at + 1]
        at, one, two = at[good], one[good], two[good]
    codes, distinct = pd.factorize(one)
    first = np.zeros(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    if (two[first][codes] != two).any():  # two n-grams share a digest
        _, first, counts = np.unique(np.stack([one, two], 1), axis=0, return_index=True, return_counts=True)
        return at[first], counts
    return at[first], np.bincount(codes, minlength=len(distinct))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Words of texts of some megabytes together, or of one longer text, and the names of their languages."""
    texts: list[bytes] = []
    langs: list[int] = []
    names: dict[str, int] = {}

    def out() -> tuple[Words, list[str]]:
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        return Words(b"\n".join(texts), np.array([_long(list(names)[x].encode())[0] for x in langs], np.uint64), ends), list(names)

    held = 0
    for part in (batch.slice(k, _SLICE) for batch in batches for k in range(0, batch.num_rows, _SLICE)):
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if held and held + len(text) > _CHUNK:
                yield out()
                texts, langs, held = [], [], 0
            texts.append(text.lower())
            langs.append(names.setdefault(lang, len(names)))
            held += len(text) + 1
    if held:
        yield out()


def _rows(langs: list[str], texts: list[bytes], counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])


def counted(docs: DataFrame, n: int, allowed: Broadcast | None) -> DataFrame:
    """lang, phrase, f of the n-grams of docs (lang, text) that the filter lets through.

    Words recur, so a task merges those of its texts; longer n-grams mostly do not, and are merged by megabytes of text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(allowed.value, np.uint8) if allowed is not None else None
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            langs, texts = zip(*held, strict=True)
            return _rows(langs, texts, list(held.values()))

        for words, names in chunks(batches):
            of = {_long(name.encode())[0]: name for name in names}
            at, counts = told(words, n, bits)
            langs, texts = [of[x] for x in words.lang[at].tolist()], words.phrases(at, n)
            if n > 1:
                if len(at):
                    yield _rows(langs, texts, counts)
                continue
            for key, c in zip(zip(langs, texts, strict=True), counts.tolist(), strict=True):
                held[key] += c
            if len(held) >= _HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    rows = docs.mapInArrow(run, "lang string, phrase binary, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def filter_of(frequent: DataFrame, n: int) -> Broadcast:
    """A broadcast bitmap of the digests of the phrases of n words, made in tasks; it has MOST_BITS bits at most."""
    bits = FEWEST_BITS
    while bits < min(MOST_BITS, BITS_EACH * frequent.count()):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in chunks(batches):
            _, (digest, _) = words.grams(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(digest & np.uint64(bits - 1)).astype(np.int64))], names=["at"])

    at = frequent.select("lang", F.col("phrase").alias("text")).mapInArrow(run, "at long").select((F.col("at") + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    whole = bytearray(bits // 8)
    for row in parts.toLocalIterator():  # 4 KB each, bits / 32,768 of them
        whole[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = row["bits"]
    return frequent.sparkSession.sparkContext.broadcast(bytes(whole))


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases told ``least`` times, and (lang, n) with the number of all words."""
    texts = dealt(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text <> ''"))
    words = stored(counted(texts, 1, None), "phrases")
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    levels = [words.where(F.col("f") >= least)]
    for n in range(2, longest + 1):
        allowed = filter_of(levels[-1], n - 1)
        levels.append(stored(counted(texts, n, allowed).where(F.col("f") >= least), "phrases"))
        allowed.destroy()
    out = None
    for n, level in enumerate(levels, 1):
        level = level.select("lang", "phrase", F.lit(n).alias("words"), "f")
        out = level if out is None else out.union(level)
    return stored(out, "frequent"), totals


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of all phrases of two words and more: by their lowest cut, the first of equal ones.

    A frequent word begins very many phrases, so the table of single words is dealt to SALTS parts of each word.
    """
    cuts = phrases.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    first = F.expr("substring_index(phrase, ' ', k)")
    last = F.expr("substring_index(phrase, ' ', k - words)")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    none = F.lit(-1)
    cuts = cuts.select("lang", "phrase", "words", F.col("f").alias("a"), "k", first.alias("first"), last.alias("last"))
    cuts = cuts.withColumn("salt_l", F.when(F.col("k") == 1, salt).otherwise(none)).withColumn("salt_r", F.when(F.col("words") - F.col("k") == 1, salt).otherwise(none))
    salts = F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(none))
    parts = phrases.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("part"), "f", F.explode(salts).alias("salt"))
    for side, name, value in (("first", "salt_l", "l"), ("last", "salt_r", "r")):
        of = parts.withColumnRenamed("f", value)
        cuts = cuts.join(of, (F.col("lang") == F.col("of_lang")) & (F.col(side) == F.col("part")) & (F.col(name) == F.col("salt"))).drop("of_lang", "part", "salt")
    score = F.expr(f"CAST(CAST(a AS DECIMAL(20, 0)) * {SCALE} AS DECIMAL(38, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    least = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "words", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def uncovered(rows: DataFrame, covered: int = COVERED) -> DataFrame:
    """rows without the phrases that a phrase of one more word holds nearly as often.

    A longer phrase that covers one does so through those of one more word, which are told as often at least.
    """
    parts = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    longer = rows.where("words > 2").select(F.col("lang").alias("of_lang"), F.explode(parts).alias("part"), F.col("a").alias("f"))
    longer = longer.groupBy("of_lang", "part").agg(F.max("f").alias("f"))
    enough = F.expr(f"CAST(f AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {covered}")
    return rows.join(longer, (F.col("lang") == F.col("of_lang")) & (F.col("phrase") == F.col("part")) & enough, "left_anti")


def collocations(docs: DataFrame, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases.

    A null text has no words, a null lang is ``und``, and repeated rows all count. Ties of score and count go by the
    phrase's bytes. Long texts are taken whole, some eight bytes of memory to each of theirs. Other columns are not
    read. An empty table gives an empty result.
    """
    with passing(docs.sparkSession) as kept:
        phrases, totals = frequencies(docs)
        rows = stored(scored(phrases), "scored")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
        some = uncovered(rows).withColumn("within", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("within") <= best)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
        totals = totals.withColumnRenamed("lang", "of_lang")
        out = ranked.join(totals, F.col("lang") == F.col("of_lang"))
        return kept(stored(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations"))


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), sizes AS (
  SELECT unnest(range(1, {MAX_WORDS + 1})) AS words
), grams AS (
  SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase FROM split, sizes WHERE len(w) >= words
), counts AS (
  SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY lang, words, phrase
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang
), cuts AS (
  SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM counts WHERE words > 1 AND f >= {LEAST}
), scores AS (
  SELECT c.*, l.f AS l, r.f AS r, (c.a::HUGEINT * {SCALE} // (l.f + r.f))::BIGINT AS score FROM cuts c
  JOIN counts l ON c.lang = l.lang AND array_to_string(w[1:k], ' ') = l.phrase JOIN counts r ON c.lang = r.lang AND array_to_string(w[k + 1:], ' ') = r.phrase
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scores
), candidates AS (
  SELECT lang, phrase, words, a, l, r, score FROM lowest WHERE o = 1
), kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT lang, a, unnest([array_to_string(w[1:words - 1], ' '), array_to_string(w[2:], ' ')]) AS part FROM cuts WHERE words > 2 AND k = 1) e
    WHERE e.lang = c.lang AND e.part = c.phrase AND 100 * e.a::HUGEINT >= {COVERED} * c.a::HUGEINT)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM ranked k JOIN totals t ON k.lang = t.lang WHERE rank <= {BEST}
"""
