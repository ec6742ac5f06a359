"""Quality rules with host-level verdicts, in DataFrame functions alone.

Each text gets base statistics and a base verdict. Failures are summed for each host (the ``source``),
rates are shrunk towards the corpus with a beta prior fitted to the hosts' own rates, and hosts whose
shrunk rate is above a threshold take their documents with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD_RE, let, packed, passing, stored, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Base rules: fewer words than this, or more percent of them in repeated windows, fail.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A host goes if its shrunk failure rate is above this.
HOST_RATE = 0.5
#: Limits of the prior's strength, in documents.
STRENGTH = (2.0, 1000.0)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeat_words(words: Column) -> Column:
    """Words within 5-word windows that are found twice or more among words.

    Windows are compared by 64-bit digests within their own text. The sort that finds places runs only for
    texts in which the digests are not all distinct.
    """

    def places(hashes: Column) -> Column:
        at = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            def one(x: Column, k: Column) -> Column:
                same = (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
                return F.struct(x["i"].alias("i"), F.coalesce(same, F.lit(False)).alias("r"))

            return F.array_sort(F.transform(F.filter(F.transform(s, one), lambda x: x["r"]), lambda x: x["i"]))

        return let(at, repeated)

    def covered(p: Column) -> Column:
        last = lambda k: F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW))
        return F.aggregate(F.transform(p, lambda _, k: F.least(last(k), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x)

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        by_hash = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places(h), covered)))
        return F.when(F.size(w) > WINDOW, by_hash).otherwise(F.lit(0).cast("long"))

    return let(words, count)


def counts_of(text: Column) -> Column:
    """A struct of the five counts of a text that is not null."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(without(x, SPACES)) > 0)
    words = F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0))
    counts = [
        F.length(without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ]
    return let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), *counts, repeat_words(w).alias("n_repeat_words")))


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def rule_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, the five counts and base_failed."""
    out = docs.select("doc_id", "source", counts_of(text_of()).alias("q")).select("doc_id", "source", *[F.col(f"q.{c}").alias(c) for c in COUNTS])
    return out.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))


def host_rates(ruled: DataFrame, host: str) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk) from rows with base_failed.

    The prior has the corpus's failure rate as its mean and the strength that the method of moments gives
    for the spread of the hosts' rates.
    """
    hosts = ruled.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    own = F.col("n_failed") / F.col("n_docs")
    fit = hosts.agg(F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"), F.count(F.lit(1)).alias("h"), F.sum(own).alias("s"), F.sum(own * own).alias("q")).first()
    mean = (fit["f"] / fit["n"]) if fit["n"] else 0.0
    spread = max(0.0, fit["q"] / fit["h"] - (fit["s"] / fit["h"]) ** 2) if fit["h"] else 0.0
    strength = STRENGTH[1] if spread == 0 else min(max(mean * (1 - mean) / spread - 1, STRENGTH[0]), STRENGTH[1])
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select(F.col(host).alias("of_host"), "n_docs", "n_failed", rate.alias("host_rate"))


def quality(docs: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """doc_id, the five counts, base_failed, host_rate and kept of every row.

    A null text has no words and fails; a null source is a host of its own; rows of a null or repeated
    doc_id are judged one by one. Other columns are not read. An empty table gives an empty result.
    """
    ruled = stored(rule_counts(docs), "rules")
    hosts = stored(host_rates(ruled, "source"), "hosts")  # broadcast only if its written size is small
    out = ruled.join(hosts, ruled["source"].eqNullSafe(hosts["of_host"]))
    return out.select("doc_id", *COUNTS, "base_failed", F.round("host_rate", 9).alias("host_rate"), (~F.col("base_failed") & (F.col("host_rate") <= host_rate)).alias("kept"))


def keep(docs: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """The rows of docs that pass their own rules and whose host passes, with docs' own columns, whatever their names.

    Texts are written once, with their verdicts: counting them again would cost more than reading them does.
    """
    rows = packed(docs).withColumn("q", counts_of(F.coalesce("row.text", F.lit(""))))
    with passing(docs.sparkSession) as kept:
        judged = kept(stored(rows.select("row", failed(F.col("q.n_words"), F.col("q.n_repeat_words")).alias("failed")), "judged"))
        hosts = kept(stored(host_rates(judged.select("row.source", F.col("failed").alias("base_failed")), "source"), "hosts"))
    hosts = hosts.where(F.col("host_rate") <= host_rate).select("of_host")
    return judged.where("NOT failed").join(hosts, F.col("row.source").eqNullSafe(F.col("of_host")), "left_semi").select("row.*")


SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 5)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, sum(least(5, coalesce(next - i, 5)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM repeated) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), ruled AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(words) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(words) AS base_failed
  FROM w LEFT JOIN covered c USING (r) LEFT JOIN lines l USING (r)
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::BIGINT)::DOUBLE AS f FROM ruled GROUP BY source
), moments AS (
  SELECT sum(f) / sum(n) AS mean, greatest(0.0::DOUBLE, sum((f / n) * (f / n)) / count(*) - (sum(f / n) / count(*)) * (sum(f / n) / count(*))) AS spread FROM hosts
), prior AS (
  SELECT mean, CASE WHEN spread = 0 THEN 1000.0::DOUBLE ELSE least(greatest(mean * (1 - mean) / spread - 1, 2.0::DOUBLE), 1000.0::DOUBLE) END AS strength FROM moments
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round((f + mean * strength) / (n + strength), 9) AS host_rate,
  NOT base_failed AND (f + mean * strength) / (n + strength) <= 0.5 AS kept
FROM ruled JOIN hosts ON ruled.source IS NOT DISTINCT FROM hosts.source CROSS JOIN prior
"""
