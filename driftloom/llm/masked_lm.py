"""Masked pseudo-likelihood: a bidirectional window network scores each token from both sides.

The network sees two tokens on either side of a masked one, each through an embedding of its own for that
place, and predicts the masked token in three steps of sixteen branches. A document's score is the sum over all its
tokens of the log-probability given the rest.

Words are counted over all documents. The most frequent ones are tokens; the rest fall into buckets by their ending,
which says much about a word's language and kind, so that rare words too tell the network what to expect. A word of a
bucket gets its own share of it on top: by its count if it is among the SHARED most frequent of them, else
an equal part of what the others of its bucket have together.

Tasks train copies of the network on every token of all their documents, and copies are averaged, weighted by tokens,
in a tree of tasks. This is done in rounds: a document is learned from in one of them, by a hash of its id and text, and each round
starts where the average of the one before ended.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, frequent, release, stored, text_of, word_counts

#: Branches of each of the three steps, and buckets of rare words.
BRANCH, CLASSES = 16, 64
VOCABULARY = BRANCH**3
#: The last ids are buckets for words that are not tokens; one more id stands for what lies beyond a text's ends.
RARE, OUTSIDE = VOCABULARY - CLASSES, VOCABULARY
OFFSETS, WIDTH = (-2, -1, 1, 2), 32
#: Batches grow from the first to the second size, to one part in GROWTH of what a task has learned; copies that a task averages; rounds.
BATCHES, GROWTH, RATE, SEED, FAN, ROUNDS = (256, 2048), 1024, 0.3, 11, 8, 3
#: A copy takes some 5 MB; a task gets at least so many bytes of input, unless cores would be idle.
TASK_BYTES = 16 << 20
#: Tokens that are scored at once, rare words whose own share is known, and words that a worker remembers.
CHUNK, SHARED, CACHE_WORDS, CACHE_BYTES = 8192, 100_000, 200_000, 64
SHAPES = {
    "e": (len(OFFSETS), VOCABULARY + 1, WIDTH), "b": (WIDTH,), "w0": (1, WIDTH, BRANCH), "b0": (1, BRANCH),
    "w1": (BRANCH, WIDTH, BRANCH), "b1": (BRANCH, BRANCH), "w2": (BRANCH**2, WIDTH, BRANCH), "b2": (BRANCH**2, BRANCH),
}


def split(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()  # bytes.split knows ASCII white space alone


def bucket_of(word: bytes) -> int:
    """Of a word that is no token, by its last three bytes without points and commas."""
    return zlib.crc32((word.rstrip(b".,;:!?)\"'") or word)[-3:]) % CLASSES


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents, words as UTF-8."""
    rows = dealt(docs.select(text_of().alias("text")))
    lists = lambda batches: (split(t.as_py()) for b in batches for t in b.column(0))
    return rows.mapInArrow(lambda batches: word_counts(lists(batches)), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(rows: DataFrame) -> dict[str, int]:
    """The most frequent words, by falling count and then code points, to ids; at most RARE words. rows: documents, or (word, n)."""
    found = frequent(rows if rows.columns == ["word", "n"] else stored(count_words(rows), "lm-words"), "word", "n", RARE)
    order = sorted(found, key=lambda w: (-found[w], bytes(w)))
    return {bytes(w).decode("utf-8", "surrogatepass"): i for i, w in enumerate(order)}


class Ids(dict):
    """From words, as UTF-8, to ids; those of rare words are worked out when first met and kept up to a bound."""

    def __init__(self, words: dict[str, int]) -> None:
        super().__init__((w.encode("utf-8", "surrogatepass"), i) for w, i in words.items())

    def __missing__(self, word: bytes) -> int:
        own = RARE + bucket_of(word)
        if len(self) < CACHE_WORDS and len(word) <= CACHE_BYTES:
            self[word] = own
        return own


class Shares:
    """log of a rare word's part of its bucket: of known words their own, of others their bucket's equal part."""

    def __init__(self, known: dict[bytes, float], others: np.ndarray) -> None:
        self.known, self.others = known, others

    def total(self, words: list[bytes], tokens: np.ndarray) -> float:
        rare = np.flatnonzero(tokens >= RARE)
        if not len(rare):
            return 0.0
        rest = self.others[tokens[rare] - RARE].tolist()
        known = self.known
        return float(sum(known.get(words[k], r) for k, r in zip(rare.tolist(), rest, strict=True)))


def shares(counts: DataFrame, words: dict[str, int]) -> Shares:
    """From (word, n): nothing but SHARED words and CLASSES sums reach the driver."""
    shared = counts.sparkSession.sparkContext.broadcast(frozenset(w.encode("utf-8", "surrogatepass") for w in words))  # at most RARE words

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(w, n, bucket_of(w)) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w not in shared.value]
            columns = list(zip(*own, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int32()), strict=True)], names=["word", "n", "bucket"])

    rows = stored(counts.mapInArrow(rare, "word binary, n long, bucket int"), "lm-rare")
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():  # at most CLASSES rows
        mass[r["bucket"]], kinds[r["bucket"]] = r["n"], r["k"]
    top = {bytes(w): n for w, n in frequent(rows, "word", "n", SHARED).items()}
    release(rows)
    rest_mass, rest_kinds = mass.copy(), kinds.copy()
    for w, n in top.items():
        rest_mass[bucket_of(w)] -= n
        rest_kinds[bucket_of(w)] -= 1
    part = np.where(rest_kinds > 0, rest_mass / np.maximum(rest_kinds, 1), 1.0)
    return Shares({w: float(np.log(n / mass[bucket_of(w)])) for w, n in top.items()}, np.log(part / np.maximum(mass, 1.0)))


def ids_of(text: str, ids: Ids) -> np.ndarray:
    words = split(text)
    return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))


def contexts(tokens: np.ndarray) -> np.ndarray:
    """(tokens, offsets): the ids around each token."""
    padded = np.concatenate([np.full(2, OUTSIDE), tokens, np.full(2, OUTSIDE)])
    n = len(tokens)
    return np.stack([padded[2 + o : 2 + o + n] for o in OFFSETS], axis=1)


def start() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    out = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    for k in ("e", "w0", "w1", "w2"):
        out[k] = (rng.standard_normal(SHAPES[k]) * 0.1).astype(np.float32)
    return out


def places(around: np.ndarray) -> np.ndarray:
    """Where the embeddings of surroundings stand among those of all offsets."""
    return around + np.arange(len(OFFSETS)) * (VOCABULARY + 1)


def hidden(model: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    e, at = model["e"].reshape(-1, WIDTH), places(around)
    h = e.take(at[:, 0], axis=0)
    for k in range(1, len(OFFSETS)):
        h += e.take(at[:, k], axis=0)
    h += model["b"]
    return np.tanh(h, out=h)


def steps(tokens: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(step, node, branch) of sorted tokens: the node that each is in before the step, and the branch it takes."""
    return [(s, tokens // BRANCH ** (3 - s), tokens // BRANCH ** (2 - s) % BRANCH) for s in range(3)]


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys in order: the distinct ones, where each begins, and how often it is there."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], first, np.diff(np.append(first, len(keys)))


def side_by_side(first: np.ndarray, size: np.ndarray, n: int) -> Iterator[tuple]:
    """(some runs, their rows as a table), so that runs of like sizes are one product; row n fills short ones up. Long runs come one by one."""
    low = 0
    for high in (1, 4, 16, 64):
        own = np.flatnonzero((size > low) & (size <= high))
        if len(own):
            k = np.arange(high)
            yield own, np.where(k < size[own][:, None], first[own][:, None] + k, n)
        low = high
    for p in np.flatnonzero(size > low).tolist():
        yield p, slice(int(first[p]), int(first[p] + size[p]))


def sums_of_runs(rows: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs by falling size, and the sum of rows[order] over each."""
    falling = np.argsort(-size, kind="stable")
    begin, less = first[falling], -size[falling]
    out = np.empty((len(first), rows.shape[1]), rows.dtype)
    long = int(np.searchsorted(less, -16))  # those of more than 16 are added up one by one, others all at once
    for k in range(long):
        rows.take(order[begin[k] : begin[k] - less[k]], axis=0).sum(axis=0, out=out[k])
    out[long:] = rows.take(order[begin[long:]], axis=0)
    for k in range(1, int(-less[long]) if long < len(less) else 0):
        end = int(np.searchsorted(less, -k))  # those of more than k
        out[long:end] += rows.take(order[begin[long:end] + k], axis=0)
    return falling, out


def softmax(z: np.ndarray) -> tuple[np.ndarray | float, np.ndarray]:
    """exp of rows of BRANCH, in place, less their largest where it might overflow: what was taken off, and the sums."""
    top = 0.0
    if z.max() > 60 or z.min() < -60:
        top = z.max(axis=-1)
        z -= top[..., None]
    np.exp(z, out=z)
    return top, z @ np.ones(BRANCH, np.float32)


class Pass:
    """The branches' shares of sorted tokens in all steps, forward; what is kept serves the way back."""

    def __init__(self, model: dict[str, np.ndarray], tokens: np.ndarray, around: np.ndarray) -> None:
        n = self.n = len(tokens)
        self.h = np.zeros((n + 1, WIDTH), np.float32)  # one row more fills runs up
        self.h[:n] = hidden(model, around)
        self.z = np.zeros((3, n + 1, BRANCH), np.float32)
        self.steps = []
        self.chosen = np.empty((3, n), np.int64)  # where the branches that are taken stand in z
        for s, nodes, branches in steps(tokens):
            at, first, size = runs(nodes)
            w, z = model[f"w{s}"].take(at, axis=0), self.z[s]
            parts = [(own, rows, self.h[rows] if isinstance(own, int) else self.h.take(rows, axis=0), w[own]) for own, rows in side_by_side(first, size, n)]
            for _, rows, h, own in parts:
                z[rows] = h @ own
            z[:n] += model[f"b{s}"].take(nodes, axis=0)
            z[n] = 0
            self.chosen[s] = (s * (n + 1) + np.arange(n)) * BRANCH + branches
            self.steps.append((at, w, parts))


def log_probabilities(model: dict[str, np.ndarray], tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Of each token given its surroundings; tokens are taken in order, so that a node of a step is one product."""
    order = np.argsort(tokens.astype(np.int16), kind="stable")
    out = np.empty(len(tokens), np.float32)
    if len(tokens):
        run = Pass(model, tokens[order], around[order])
        own = run.z.take(run.chosen)
        top, sums = softmax(run.z)
        out[order] = (own - (top + np.log(sums))[:, :-1]).sum(axis=0)
    return out


class Trainer:
    """Adagrad on mini-batches of tokens, from a network and its sums of squares."""

    def __init__(self, model: dict[str, np.ndarray] | None = None, sums: dict[str, np.ndarray] | None = None) -> None:
        self.model = model or start()
        self.sums = sums or {k: np.full(s, 1e-3, np.float32) for k, s in SHAPES.items()}
        self.seen, self.waiting = 0, 0
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    @property
    def batch(self) -> int:
        return min(max(self.seen // GROWTH, BATCHES[0]), BATCHES[1])

    def add(self, tokens: np.ndarray, around: np.ndarray) -> None:
        self.kept.append((tokens, around))
        self.waiting += len(tokens)
        if self.waiting >= self.batch:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            tokens, around = (np.concatenate(x) for x in zip(*self.kept, strict=True))
            k = 0
            while k < len(tokens):
                n = self.batch
                self.step(tokens[k : k + n], around[k : k + n])
                k += n
            self.kept, self.waiting = [], 0

    def move(self, name: str, rows: np.ndarray, grad: np.ndarray, held: np.ndarray | None = None) -> None:
        """grad is of some rows of a table of the network; held: what it has there."""
        model, sums = (x[name].reshape(-1, *grad.shape[1:]) for x in (self.model, self.sums))
        new = grad * grad
        new += sums.take(rows, axis=0)
        sums[rows] = new
        np.sqrt(new, out=new)
        np.divide(grad, new, out=new)
        new *= RATE
        model[rows] = np.subtract(model.take(rows, axis=0) if held is None else held, new, out=new)

    def step(self, tokens: np.ndarray, around: np.ndarray) -> None:
        m, n = self.model, len(tokens)
        order = np.argsort(tokens.astype(np.int16), kind="stable")
        around = around[order]
        run = Pass(m, tokens[order], around)
        g, (_, sums) = run.z, softmax(run.z)
        g /= sums[..., None]
        g.reshape(-1)[run.chosen] -= 1
        g[:, n] = 0  # what fills runs up counts for nothing
        g /= n
        gh = np.zeros_like(run.h)
        for s, (at, w, parts) in enumerate(run.steps):
            gw, gb = np.empty_like(w), np.empty((len(at), BRANCH), np.float32)
            for own, rows, h, w_own in parts:
                part = g[s][rows] if isinstance(own, int) else g[s].take(rows, axis=0)
                gh[rows] += part @ w_own.swapaxes(-1, -2)
                gw[own] = h.swapaxes(-1, -2) @ part
                gb[own] = part.sum(axis=-2)
            self.move(f"w{s}", at, gw, w)
            self.move(f"b{s}", at, gb)
        gh, h = gh[:n], run.h[:n]
        gh *= 1 - h * h
        self.move("b", np.zeros(1, np.int64), gh.sum(axis=0)[None])
        keys = places(around).T.astype(np.int16).ravel()  # all offsets in a row
        order = np.argsort(keys, kind="stable")
        at, first, size = runs(keys[order])
        falling, ge = sums_of_runs(gh, order % n, first, size)
        self.move("e", at[falling].astype(np.int64), ge)
        self.seen += n


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


COPY_SCHEMA = "node long, weight long, total binary"
_COPY_NAMES, _COPY_TYPES = ["node", "weight", "total"], (pa.int64(), pa.int64(), pa.binary())


def _copy(node: int, weight: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((node, weight, total.astype(np.float32).tobytes()), _COPY_TYPES, strict=True)], names=_COPY_NAMES)


def one_round(texts: DataFrame, words, held: np.ndarray, stride: int) -> np.ndarray:  # noqa: ANN001
    """held (a network and its sums) after learning from texts; itself where there is nothing to learn from."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(held)  # of the network's size

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        half = len(shared.value) // 2
        trainer, ids = Trainer(shaped(shared.value[:half]), shaped(shared.value[half:])), Ids(words.value)
        for batch in batches:
            for text in batch.column(0):
                tokens = ids_of(text.as_py(), ids)
                some = slice(int(tokens[0]) % stride if len(tokens) > stride else 0, None, stride) if len(tokens) else slice(0, 0)
                if len(tokens[some]):
                    trainer.add(tokens[some], contexts(tokens)[some])
        trainer.flush()
        if trainer.seen:
            yield _copy(TaskContext.get().partitionId(), trainer.seen, np.concatenate([flat(trainer.model), flat(trainer.sums)]).astype(np.float64) * trainer.seen)

    def add(key: tuple, copies: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0, None
        for batch in copies:
            for w, x in zip(batch.column("weight").to_pylist(), batch.column("total"), strict=True):
                own = np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
                weight, total = weight + w, own if total is None else total + own
        yield _copy(key[0].as_py(), weight, total)

    parts = texts.rdd.getNumPartitions()
    kept = copies = stored(texts.mapInArrow(train, COPY_SCHEMA), "lm-copies")
    while parts > 1:
        parts = -(-parts // FAN)
        copies = copies.select((F.floor(F.col("node") / FAN)).cast("long").alias("node"), "weight", "total").groupBy("node").applyInArrow(add, COPY_SCHEMA)
    last = copies.collect()  # one row
    release(kept)
    if not last:
        return held
    return (sum(np.frombuffer(r["total"], np.float32).astype(np.float64) for r in last) / sum(r["weight"] for r in last)).astype(np.float32)


def trained(docs: DataFrame, words: dict[str, int], stride: int) -> dict[str, np.ndarray]:
    """The network after all rounds; the start itself where there is nothing to learn from."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # at most RARE words
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)).alias("turn")  # copies of a text are spread over all rounds
    texts = dealt(docs.select(text_of().alias("text"), turn).where("text <> ''"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # Spark's estimate; of an unknown size it is large
    texts = texts.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, min(size // TASK_BYTES, 1 << 20)))
    held = np.concatenate([flat(start()), flat(Trainer().sums)])
    for k in range(ROUNDS):
        held = one_round(texts.where(F.col("turn") == k).select("text"), shared, held, stride)
    return shaped(held[: len(held) // 2])


SCORE_SCHEMA = "doc_id long, n_tokens long, log_prob double, mean_log_prob double"


def score(docs: DataFrame, words: dict[str, int], model: dict[str, np.ndarray], own: Shares | None = None) -> DataFrame:
    """SCORE_SCHEMA of every row, with buckets in place of rare words unless their shares are given."""
    shared = docs.sparkSession.sparkContext.broadcast((words, model, own))  # bounded by the vocabulary, the network and SHARED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, network, parts = Ids(shared.value[0]), shared.value[1], shared.value[2]
        for batch in batches:
            sizes, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            waiting = 0

            def flush(held: list, sums: np.ndarray) -> None:
                if held:
                    rows = np.concatenate([np.full(len(t), i) for i, t, _ in held])
                    tokens, around = np.concatenate([t for _, t, _ in held]), np.concatenate([a for *_, a in held])
                    for k in range(0, len(tokens), CHUNK):
                        some = slice(k, k + CHUNK)
                        sums += np.bincount(rows[some], log_probabilities(network, tokens[some], around[some]), minlength=len(sums))
                    held.clear()

            for i, text in enumerate(batch.column(1)):
                found = split(text.as_py())
                tokens = np.fromiter(map(ids.__getitem__, found), dtype=np.int64, count=len(found))
                sizes[i] = len(tokens)
                if parts:
                    sums[i] += parts.total(found, tokens)
                if len(tokens):
                    held.append((i, tokens, contexts(tokens)))
                    waiting += len(tokens)
                if waiting >= CHUNK:
                    flush(held, sums)
                    waiting = 0
            flush(held, sums)
            mean = pa.array(np.where(sizes > 0, sums / np.maximum(sizes, 1), np.nan), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes), pa.array(sums), mean], names=[x.strip().split(" ")[0] for x in SCORE_SCHEMA.split(",")])

    return dealt(docs.select("doc_id", text_of().alias("text"))).mapInArrow(run, SCORE_SCHEMA)


def masked_lm(docs: DataFrame, stride: int = 1) -> DataFrame:
    """doc_id, n_tokens, log_prob (summed), mean_log_prob of every row, by a network trained on docs.

    A null text counts as empty: no tokens, log_prob 0, mean null. Rows of a null or repeated doc_id are
    scored one by one. Other columns are not read. An empty table gives an empty result.
    """
    counts = stored(count_words(docs), "lm-words")
    words = vocabulary(counts)
    own = shares(counts, words)
    release(counts)
    return score(docs, words, trained(docs, words, stride), own)
