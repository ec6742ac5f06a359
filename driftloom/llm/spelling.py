"""Spelling variants by a symmetric-delete join.

Words are counted over all documents. Every word gives its own key and those of its distinct single deletions; words
that share a key are joined, and the two runs of equal letters that were cut tell exactly whether the words are one edit
apart. Each word's strongest neighbour is its form, and forms are followed to their roots by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, passing, release, stored, word_counts
from .sharding import CRC_TABLE, crc_sql

#: Words have so many code points and occurrences at least; a form has so many times a word's occurrences.
SHORTEST, LEAST, STRONGER = 6, 5, 5
#: One occurrence in so many, by its hash, loses a code point.
SLIP = 199
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # of lower-cased UTF-8
_BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_SLICE = 1 << 22


def slices(text: bytes) -> Iterator[bytes]:
    """The text in parts of some megabytes, cut where no run goes on."""
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, at + _SLICE) if at + _SLICE < len(text) else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def runs(text: bytes) -> Counter:
    """The lower-cased runs of letters of a text, and how often each occurs."""
    found: Counter = Counter()
    for part in slices(text):
        for token, n in Counter(part.lower().translate(_LETTERS).split()).items():
            if token.isascii():
                found[token] += n
            else:
                for run in _RUN.findall(token):
                    found[run] += n
    return found


def words_of(doc_id: int | None, text: bytes, slip: int = SLIP) -> Counter:
    """The words of a document, of SHORTEST code points at least, after slips."""
    found: Counter = Counter()
    start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
    for run, n in runs(text).items():
        if len(run) < SHORTEST:
            continue
        h = zlib.crc32(run, start)
        if h % slip == 0:
            word = run.decode()
            at = h % len(word)
            run = (word[:at] + word[at + 1 :]).encode()
        if len(run) - run.count(b"\xc3") >= SHORTEST:
            found[run] += n
    return found


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """word, n of the words that all documents have at least ``least`` times; counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True))
        return word_counts(words_of(doc_id, text) for doc_id, text in rows if text)

    counts = dealt(docs.select("doc_id", "text")).mapInArrow(run, "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(F.col("word").cast("string").alias("word"), "n")


_PRIME, _BASE = (1 << 61) - 1, 0x1B873593_CC9E2D51 % ((1 << 61) - 1)


def keys_of(word: str) -> Iterator[tuple[int, int, int]]:
    """(key, first, last): the word's own key with -1, -1, then that of each distinct deletion with the run of equal letters that it shortens.

    Keys are polynomial digests, of all deletions in time proportional to the word.
    """
    n = len(word)
    codes = [ord(c) for c in word]
    after = [0] * (n + 1)  # digests of the word from each place on
    power = [1] * (n + 1)
    for k in range(n - 1, -1, -1):
        power[n - k] = power[n - k - 1] * _BASE % _PRIME
        after[k] = (codes[k] * power[n - 1 - k] + after[k + 1]) % _PRIME
    yield after[0], -1, -1
    before, k = 0, 0
    while k < n:
        last = k
        while last + 1 < n and codes[last + 1] == codes[k]:
            last += 1
        yield (before * power[n - 1 - k] + after[k + 1]) % _PRIME, k, last
        for _ in range(k, last + 1):
            before = (before * _BASE + codes[k]) % _PRIME
        k = last + 1


def emitted(words: DataFrame) -> DataFrame:
    """key, id, first, last of every word: itself and its distinct single deletions, in rows that do not grow with the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ident, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True):
                for key, first, last in keys_of(word):
                    out.append((key, ident, first, last))
                    if len(out) >= 50_000:
                        yield rows(out)
                        out = []
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "id", "first", "last"])

    return words.select("id", "word").mapInArrow(run, "key long, id binary, first int, last int")


def cut(side: str) -> Column:
    """What a side's key stands for: its word, without the letter at its first place."""
    word, first = F.col(f"{side}.word"), F.col(f"{side}_first")
    return F.when(first < 0, word).otherwise(F.concat(F.substring(word, F.lit(1), first), F.substring(word, first + 2, F.length(word))))


def near(words: DataFrame) -> DataFrame:
    """id, n_near, form_n, form: for each word that has one, its number of words one edit away, and the strongest.

    Two words of a key are one edit apart if one of them is the key, or if the runs that they shorten meet in a place:
    a letter is replaced there. That, and the comparison of what the keys stand for, is exact, and holds for one key of
    a pair only.
    """
    a, b = emitted(words).alias("a"), emitted(words).alias("b")
    meet = (F.col("a.first") >= 0) & (F.col("b.first") >= 0) & (F.col("a.first") <= F.col("b.last")) & (F.col("b.first") <= F.col("a.last"))
    one = (F.col("a.first") < 0) != (F.col("b.first") < 0)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & (one | meet))
    pairs = pairs.select(F.col("a.id").alias("a_id"), F.col("a.first").alias("a_first"), F.col("b.id").alias("b_id"), F.col("b.first").alias("b_first"))
    pairs = pairs.join(words.alias("a"), F.col("a_id") == F.col("a.id")).join(words.alias("b"), F.col("b_id") == F.col("b.id")).where(cut("a") == cut("b"))
    out = pairs.groupBy(F.col("a_id").alias("of")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b.n")).alias("less"), F.col("b.word").alias("form"))).alias("best"))
    return out.select("of", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """word, root of every word of links (word, form), which have no circles: each round doubles the steps taken."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        further = now.select(F.col("word").alias("of"), F.col("root").alias("next"))
        after = stored(now.join(further, F.col("root") == F.col("of"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        release(now)
        now = after.select("word", "root")
        now.scratch = after.scratch
        if not moved:
            return now
    raise RuntimeError(f"forms did not end in {most_rounds} rounds")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus.

    A null text has no runs; a null doc_id counts as the text ``null``. Rows of a repeated id, and repeated rows, all
    count. Runs of any length are words. Other columns are not read. An empty table gives an empty result.
    """
    with passing(docs.sparkSession) as kept:
        words = stored(vocabulary(docs).withColumn("id", F.unhex(F.md5(F.col("word").cast("binary")))), "words")
        joined = words.join(near(words), F.col("id") == F.col("of"), "left")
        strong = F.col("form_n") >= STRONGER * F.col("n")
        rows = kept(stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")), "near"))
        found = kept(roots(rows.where("form IS NOT NULL").select("word", "form")))
    out = rows.join(found.withColumnRenamed("word", "of_word"), F.col("word") == F.col("of_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_CRC = crc_sql("encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)")
SQL = f"""
WITH RECURSIVE {CRC_TABLE}, occurrences AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM occurrences WHERE length(run) >= {SHORTEST} GROUP BY doc_id, run
), hashed AS (
  SELECT *, {_CRC} AS h FROM runs, crc
), slipped AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}
), keys AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
  UNION ALL SELECT word, n, word FROM words
), pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word
  WHERE length(a.word) <> length(b.word) OR len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i, 1) <> substr(b.word, i, 1))) = 1
), best AS (
  SELECT word, count(*)::BIGINT AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {STRONGER} * w.n THEN other END AS form, CASE WHEN other_n >= {STRONGER} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), walks AS (
  SELECT word, word AS at FROM formed UNION ALL SELECT k.word, f.form FROM walks k JOIN formed f ON k.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walks k ON f.word = k.word JOIN formed e ON k.at = e.word WHERE e.form IS NULL
"""
