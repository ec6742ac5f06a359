"""Secret scans: fixed patterns, and guess costs of values that stand in a credential's place.

A value's guess cost is the least over all ways to cut it into words, dates, repeats, keyboard walks and
brute-force characters; the sum of the parts' log10 guesses is minimised by dynamic programming. Words are ranked
as a guesser would try them: common ones of passwords, those of the text itself, and the words of all documents by
their counts. No value in a credential's place, nor any repeat of it in its text, counts as a word. Values that are
dear to guess are reported although no fixed pattern knows them.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, frequent, lean, text_of, word_counts

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Cheap tests that any match of the patterns passes.
ASSIGN_HINTS, CONTEXT_HINTS = ("passw", "secret", "token", "api"), ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "login")
FOREIGN_HINTS = ("wort", "zugangscode", "geheimnis", "passe", "mdp", "contrase", "clave", "secreto", "credencial")
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: A credential's name, what joins it to its value, and the value.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_-]?key|credentials?|auth(?:orization)?|bearer|login)["']?"""
    r"""(?:\x20*(?P<sign>:=|=>|[:=])\x20*(?:bearer\x20+)?|\x20+(?:is|was|bearer)\x20+|(?<=bearer)\x20+)["']?(?P<value>[^\s"'<>,;]{6,})""",
    re.ASCII | re.IGNORECASE,
)
#: Names of credentials in German, French and Spanish; values follow a sign, as what follows a verb is mostly prose.
FOREIGN = re.compile(
    r"""(?<![A-Za-z0-9])(?:pa(?:ss|\xDF)wort|kennwort|zugangscode|geheimnis|mot\x20de\x20passe|mdp|contrase(?:\xF1|n)a|clave|secreto|credencial(?:es)?)["']?"""
    r"""\x20*(?P<sign>:=|=>|[:=])\x20*["']?(?P<value>[^\s"'<>,;]{6,})""",
    re.ASCII | re.IGNORECASE,
)
#: log10 of the guesses from which a value counts as a secret.
DEAR = 10.0
#: The same for values of letters alone that no sign joins to the credential's name: after ``is`` mostly prose follows.
DEAR_PROSE = 15.0
#: Words of all documents that are ranked: bounds a broadcast of some MB.
CORPUS_WORDS = 100_000
#: No part of a value costs less, which is what the first word does: longer values are dear whatever they hold.
CHEAPEST = math.log10(2)
#: The longest word, date or walk that is tried.
LONGEST = 24
#: Common words of passwords, commonest first.
COMMON = (
    "password", "qwerty", "admin", "welcome", "login", "letmein", "monkey", "dragon", "master", "secret", "token", "default", "example", "changeme", "test", "user",
    "root", "guest", "hello", "sunshine", "princess", "football", "shadow", "superman", "iloveyou", "trustno", "access", "love", "the", "your", "none", "null", "true", "false",
)
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("0134578@$!", "oleastbasi")
_STEP = {(a, b) for row in KEYBOARD for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in KEYBOARD for a, b in zip(row, row[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d", re.ASCII)
#: A time of a day, with its date before it or not, and an address whose parts are plain words; what guessers try for these.
_MOMENT = re.compile(r"(?:(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[T_])?(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{1,9})?)?(?:Z|[+-]\d\d:?\d\d)?", re.ASCII)
_ADDRESS = re.compile(r"[a-z]{3,6}://[a-z][a-z0-9.-]*(?::\d{2,5})?(?:/[a-z][a-z-]{0,14}(?:\.[a-z]{2,4})?(?![\w-]))*/?", re.ASCII)
DAY_GUESSES, TIME_GUESSES, HOST_GUESSES, STEP_GUESSES = math.log10(365 * 100), math.log10(86_400), 6.0, 0.5
#: What may hold a value, where a value may begin in it, and what ends no value.
_RUN, _INNER, _ENDS = re.compile(r"""[^\s"'<>,;]+"""), re.compile(r"(?:\A|(?<=[\W_]))(?=[^\s])"), ".:!?)]}"
_WORD = re.compile(r"[^\W\d_]{3,24}")


def brute(c: str) -> float:
    """log10 of the characters like c."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


def guess_cost(value: str, ranks: Ranks | dict[str, int]) -> float:
    """log10 of the guesses that value takes; ranks: of words, from 1. Time is the length times LONGEST."""
    n = len(value)
    low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i]
        step = here + brute(value[i])
        if step < best[i + 1]:
            best[i + 1] = step
        for j in range(i + 3, min(n, i + LONGEST) + 1):  # words, as they are or with digits for letters
            for form, extra in ((low, 0.0), (plain, 0.3)):
                if (rank := ranks.get(form[i:j])) is not None:
                    cost = here + math.log10(rank + 1) + extra + (0.3 if value[i:j] != low[i:j] else 0.0)
                    best[j] = min(best[j], cost)
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if _DATE.fullmatch(value, i, j):
                    best[j] = min(best[j], here + math.log10(365 * (100 if j - i > 4 else 1)))
        if value[i].isdigit() and (m := _MOMENT.match(value, i)):
            best[m.end()] = min(best[m.end()], here + TIME_GUESSES + (DAY_GUESSES if "-" in value[i : i + 5] else 0.0))
        if value.startswith("://", i + 3) or value.startswith("://", i + 4) or value.startswith("://", i + 5) or value.startswith("://", i + 6):
            if m := _ADDRESS.match(value, i):
                best[m.end()] = min(best[m.end()], here + HOST_GUESSES + STEP_GUESSES * (m[0].count("/") - 2))
        for unit in (1, 2, 3):  # repeats of a character, or of two or three
            j, one = i + unit, here + sum(map(brute, value[i : i + unit]))
            while value.startswith(value[i : i + unit], j) and j + unit <= n and j - i < LONGEST:
                j += unit
                if j - i >= max(3, 2 * unit):
                    best[j] = min(best[j], one + math.log10((j - i) / unit))
        j = i + 1
        while j < n and j - i < LONGEST and (low[j - 1], low[j]) in _STEP:
            j += 1
            if j - i >= 3:
                best[j] = min(best[j], here + math.log10(47 * 2 * (j - i)))
    return best[n]


class Ranks:
    """The ranks of words, from 1, by what a guesser knows: first the text, then all documents."""

    def __init__(self, own: dict[str, int], corpus: dict[str, int]) -> None:
        self.own, self.corpus = own, corpus

    def get(self, word: str) -> int | None:
        own, far = self.own.get(word), self.corpus.get(word)
        return far if own is None else own if far is None else min(own, far)


def ranks_of(text: str, values: frozenset[str] = frozenset(), corpus: dict[str, int] | None = None, first: int = 0) -> Ranks:
    """Words of the text itself and common ones, ranked: what a guesser who knows the text would try first.

    values, in lower case, are candidates: they do not count wherever the text has them, nor do words that are parts
    of them unless the text has those before its first candidate, which begins at ``first``.
    """
    ranks = {w: i + 1 for i, w in enumerate(COMMON)}
    parts = {w for v in values for w in _WORD.findall(v)}
    pieces = (text[:first].lower(), text[first:].lower()) if values else ("", text.lower())
    for k, piece in enumerate(pieces):
        for w in _WORD.findall(_without(piece, values) if values and piece else piece):
            if w not in ranks and not (k and w in parts):
                ranks[w] = len(ranks) + 1
    return Ranks(ranks, corpus or {})


def candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, value, whether it may be prose) of what stands in a credential's place."""
    out = {}
    for m in itertools.chain(CONTEXT.finditer(text), FOREIGN.finditer(text)):
        start, value = m.start("value"), m["value"].rstrip(_ENDS)
        if len(value) >= MIN_ASSIGN:
            out.setdefault(start, (start, start + len(value), value, m["sign"] is None and value.isalpha()))
    return [out[start] for start in sorted(out)]


def _hinted(low: str) -> bool:
    return any(x in low for x in CONTEXT_HINTS) or any(x in low for x in FOREIGN_HINTS)


def corpus_ranks(docs: DataFrame, most: int = CORPUS_WORDS) -> dict[str, int]:
    """The words that all documents have most often, ranked by count and then code point; without values in a credential's place."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                low = text.lower()
                if _hinted(low) and (values := frozenset(v.lower() for _, _, v, _ in candidates(text))):
                    low = _without(low, values)
                yield [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(low)]

    rows = dealt(docs.select(text_of().alias("text"))).mapInArrow(lean(lambda batches: word_counts(words(batches))), "word binary, n long")
    found = frequent(rows.groupBy("word").agg(F.sum("n").alias("n")), "word", "n", most)
    order = sorted(found, key=lambda w: (-found[w], w))
    return {bytes(w).decode("utf-8", "surrogatepass"): k + 1 for k, w in enumerate(order)}


def _without(low: str, values: frozenset[str]) -> str:
    """low with spaces for the values; a value within a longer word stays."""
    lengths = {len(v) for v in values}
    least = min(lengths)

    def clean(m: re.Match) -> str:
        run = m[0].rstrip(_ENDS)
        if len(run) >= least:
            for p in _INNER.finditer(run):
                if len(run) - p.start() in lengths and run[p.start() :] in values:
                    return run[: p.start()] + " " + m[0][len(run) :]
        return m[0]

    return _RUN.sub(clean, low)


def cost_of(value: str, ranks: Ranks) -> float:
    """The guess cost; of a value that is dear whatever it holds, the least that it can be."""
    least = len(value) / LONGEST * CHEAPEST
    return least if least >= max(DEAR, DEAR_PROSE) else guess_cost(value, ranks)


def judged(text: str, dear: float = DEAR, corpus: dict[str, int] | None = None) -> tuple[list[tuple[int, int, int]], float | None]:
    """(start, kind's index, end) of all spans by start, then kind, and the least guess cost of the values in a credential's place.

    All of these values are costed. Those within a span of the fixed patterns are found already, and add no span.
    """
    low, found, least = text.lower(), [], None
    if any(x in low for x in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if _hinted(low) and (held := candidates(text)):
        found.sort()
        starts, reach = [a for a, *_ in found], list(itertools.accumulate((b for *_, b in found), max))
        ranks = ranks_of(text, frozenset(v.lower() for _, _, v, _ in held), corpus, held[0][0])
        costs: dict[str, float] = {}
        for a, b, v, prose in held:
            cost = costs[v] if v in costs else costs.setdefault(v, cost_of(v, ranks))
            least = cost if least is None else min(least, cost)
            free = not (k := bisect_right(starts, a)) or reach[k - 1] < b
            if free and cost >= (max(dear, DEAR_PROSE) if prose else dear):
                found.append((a, 3, b))
    return sorted(found), least


def scan(text: str, dear: float = DEAR, corpus: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of all spans by start, then kind."""
    return judged(text, dear, corpus)[0]


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame, dear: float = DEAR, corpus_words: int = CORPUS_WORDS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, least_cost of every row.

    least_cost is log10 of the guesses that the cheapest value in a credential's place takes, in nine digits; null
    without such a value.

    A null text counts as empty: no spans, and the digest of the empty string. Rows of a null or repeated
    doc_id are scanned one by one. Other columns are not read. Offsets are code points, ends exclusive.
    """
    shared = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs, corpus_words))  # at most corpus_words words of 24 letters
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, least_cost double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans, least = judged(text.as_py(), dear, shared.value)
                base = spans_text([x for x in spans if x[1] < 3])
                rows.append((*[sum(k == kind for _, k, _ in spans) for kind in range(4)], hashlib.sha256(base.encode()).hexdigest(), spans_text(spans), None if least is None else round(least, 9)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "least_cost"]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return dealt(docs.select("doc_id", text_of().alias("text"))).mapInArrow(run, schema)


def redacted(text: str, dear: float = DEAR, corpus: dict[str, int] | None = None) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""
    out, at = [], 0
    for start, kind, end in scan(text, dear, corpus):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, dear: float = DEAR, corpus_words: int = CORPUS_WORDS) -> DataFrame:
    """docs with secrets in ``text`` replaced; all rows and columns stay, and a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs, corpus_words))

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: None if t is None else redacted(t, dear, shared.value))

    return docs.withColumn("text", clean("text"))
