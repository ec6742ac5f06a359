"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Whatever the number of documents, an instance is a histogram: how many pieces there are of each length
from 1 to the capacity. The driver solves that bounded histogram; the cluster numbers the pieces of each
length and looks up their places. Two reductions fix sets for good, each with all its copies at once:

* a piece that fits with no other is a sequence by itself;
* the longest remaining piece j and the longest piece k that fits with it: if k fills the sequence, or if no
  two pieces fit beside j, then {j, k} dominates every other set that holds j.

What neither fixes, because three pieces or more could share a sequence, is packed best-fit, longest first.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, lean, stored, text_of, worker_cache

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"
#: Pieces that one group of equal length and salt holds on average; bounds the rows that a task must order.
GROUP_ROWS = 5_000
#: Entries of each of a worker's caches from words to ids, and the longest word in them.
CACHE_WORDS, CACHE_CHARACTERS = 400_000, 48
#: White space other than blanks and line ends, in any library's view, and control characters near it.
_UNUSUAL = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Where white space meets white space, and what may begin a special string.
_BESIDE = ("  ", "\n\n", "\n ", " \n", "<|")
_TAIL = re.compile(r"[.,;:!?]+\Z")


class Known(dict):
    """Ids of words, worked out when first met and kept up to a bound."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(self) < CACHE_WORDS and len(word) <= CACHE_CHARACTERS:
            self[word] = ids
        return ids


class WordEncoder:
    """Token ids of a text as little-endian bytes, equal to the byte-level tokenizer's own.

    That tokenizer's pre-tokens never cross from a visible character to white space, and a line end before a
    visible character is one by itself. So a text with single blanks and line ends can be cut at these, and the
    ids of a cut depend on the cut alone. Cuts are looked up in caches of bounded size; texts with other white
    space or special strings are encoded whole.
    """

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.piece = self.tokenizer.model.tokenize
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.tails = Known(self.whole)
        self.inside, self.leading = Known(lambda w: self.word(w, " ")), Known(lambda w: self.word(w, ""))
        self.line = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str, blank: str) -> bytes:
        """Ids of blank and word, which holds no white space."""
        if word.isalpha():
            if word.isascii():
                mapped = self.letters[32] + word if blank else word
            else:
                mapped = (blank + word).encode().decode("latin-1").translate(self.letters)
            found = self.piece(mapped)
            return self.bytes_of[found[0].id] if len(found) == 1 else b"".join([self.bytes_of[t.id] for t in found])
        tail = _TAIL.search(word)
        if tail and (core := word[: tail.start()]).isalpha():
            return (self.inside if blank else self.leading)[core] + self.tails[tail[0]]
        return self.whole(blank + word)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0].isspace() or text[-1].isspace() or any(x in text for x in _BESIDE) or _UNUSUAL.search(text):
            return self.whole(text)
        inside, leading, out = self.inside.__getitem__, self.leading, []
        for line in text.split("\n"):
            first, *words = line.split(" ")
            out += [self.line, leading[first], *map(inside, words)]
        return b"".join(out[1:])


def _encoder(name: str) -> WordEncoder:
    return worker_cache(name, lambda: WordEncoder(name))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what full ones leave over."""
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return dealt(docs.select("doc_id", text_of().alias("text"))).mapInArrow(lean(run, tokenizer), PIECE_SCHEMA)


class Counts:
    """A multiset of lengths that finds the longest one up to a bound."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = Counter({k: v for k, v in counts.items() if v})
        self.keys = sorted(self.n)

    def partner(self, j: int, room: int) -> int | None:
        """The longest length up to room, with one piece of length j set aside."""
        at = bisect.bisect_right(self.keys, room) - 1
        if at >= 0 and self.keys[at] == j and self.n[j] == 1:
            at -= 1
        return self.keys[at] if at >= 0 else None

    def take(self, length: int, count: int) -> None:
        self.n[length] -= count
        if not self.n[length]:
            del self.n[length]
            self.keys.remove(length)

    def smallest_two(self, without: int) -> int | None:
        """The sum of the two shortest pieces, with one of length ``without`` set aside."""
        found: list[int] = []
        for k in self.keys:
            found += [k] * min(2 - len(found), self.n[k] - (k == without))
            if len(found) == 2:
                return sum(found)
        return None


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(patterns fixed for good with their multiplicities, the counts that remain)."""
    left, fixed = Counts(counts), []
    for j in reversed(list(left.keys)):
        while left.n[j]:
            room = capacity - j
            k = left.partner(j, room)
            if k is None:
                contents, times = (j,), left.n[j]
            elif k == room or (two := left.smallest_two(j)) is None or two > room:
                # the next of its copies finds no shorter ones beside it, so the set dominates for all of them
                contents, times = (j, k), left.n[j] // 2 if k == j else min(left.n[j], left.n[k])
            else:
                break
            for length in contents:
                left.take(length, times)
            fixed.append((contents, times))
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over equal lengths at once: open sequences are kept by their room and contents."""
    rooms: dict[int, list[list]] = {}  # room -> [contents, number of sequences]
    keys: list[int] = []

    def put(room: int, contents: tuple[int, ...], times: int) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(keys, room)
        rooms[room].append([contents, times])

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect.bisect_left(keys, length)
            if at == len(keys):
                fit = capacity // length
                if full := todo // fit:
                    put(capacity - fit * length, (length,) * fit, full)
                if todo % fit:
                    put(capacity - todo % fit * length, (length,) * (todo % fit), 1)
                break
            room = keys[at]
            contents, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(at)
            fit = room // length
            if full := min(times, todo // fit):
                put(room - fit * length, contents + (length,) * fit, full)
                todo, times = todo - full * fit, times - full
            if times and 0 < todo < fit:
                put(room - todo * length, contents + (length,) * todo, 1)
                todo, times = 0, times - 1
            if times:
                put(room, contents, times)
    return [(tuple(c), t) for x in rooms.values() for c, t in x]


def solve(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


class Places:
    """For each length, where its n-th piece goes: intervals of n, each with a pattern and a place in it."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]) -> None:
        runs: dict[int, list[tuple[int, int, int]]] = {}
        used: Counter = Counter()
        first = 0
        for contents, times in patterns:
            offset = 0
            for length in contents:
                runs.setdefault(length, []).append((used[length], first, offset))
                used[length] += times
                offset += length
            first += times
        self.sequences = first
        self.of = {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            own = lengths == length
            starts, first, at = self.of[int(length)]
            i = np.searchsorted(starts, ranks[own], side="right") - 1
            sequence[own], offset[own] = first[i] + ranks[own] - starts[i], at[i]
        return sequence, offset


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece.

    Null texts count as empty, so each row of docs gives at least the piece that holds its end token. Rows
    of a null or repeated doc_id are packed like others; equal pieces among them are told apart arbitrarily.
    Other columns are not read. An empty table gives no rows. Sequences are numbered from 0 without gaps.
    """
    cuts = stored(pieces(docs, tokenizer, end_id, capacity), "pieces")
    per = cuts.groupBy("length").count()
    counts = {r["length"]: r["count"] for r in per.collect()}  # at most ``capacity`` rows
    places = Places(solve(counts, capacity))
    salts = F.array(*[F.lit(1 + counts.get(n + 1, 0) // GROUP_ROWS).cast("long") for n in range(capacity)])
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(salts, F.col("length").cast("int"))))
    sizes = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inside) - 1).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).cast("long").alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(places)  # bounded by the capacity, not by the documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.find(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, PLACED_SCHEMA)
