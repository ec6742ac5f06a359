"""The whole job, where a part of it was once left out."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest
from helpers import LOWER, ODD, WORDS, documents
from pyspark.sql import functions as F

from driftloom.llm import langid, masked_lm, mixing, ngram_join, quality, secrets, warc


def grams(text: str, width: int) -> set[tuple]:
    w = WORDS.findall(text.translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def alike(a: str, b: str, width: int, share: int) -> bool:
    x, y = grams(a, width), grams(b, width)
    return 100 * len(x & y) >= share * len(x | y)


def test_pipeline_drops_near_copies_by_five_words_and_four_fifths(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    texts = []
    for f in range(12):
        words = [f"f{f}x{k}" for k in range(100)]
        texts.append(" ".join(words))
        for changes in (1, 2, 3, 5):
            other = list(words)
            for k in rng.sample(range(100), changes):
                other[k] = f"y{rng.randint(0, 10**6)}"
            texts.append(" ".join(other))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j], 5, 80)]
    assert any(not alike(texts[i], texts[j], 3, 90) for i, j in pairs)
    name = list(range(len(texts)))
    for _ in texts:
        for i, j in pairs:
            name[i] = name[j] = min(name[i], name[j])
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, n in enumerate(name) if i == n}


def guessed(text: str) -> list[str]:
    return [text[s:e] for s, k, e in secrets.scan(text) if k == 3]


def test_a_credential_is_dear_wherever_its_text_has_it():
    rng = random.Random(7)
    letters = "".join
    prose = " ".join(letters(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(200))
    first, second = "zkqwvbnx-tprlgh-9", "Vhqzjwkp-xgdmfb-4"
    assert guessed(f"{prose} pwd: {first} and pwd: {second} end") == [first, second]
    assert guessed(f"{prose} pwd: {second} and pwd: {first} end") == [second, first]
    assert guessed(f"{first} {prose} pwd: {first}. So ({first}) or x={first} then login: {first}") == [first, first]
    words = prose.split()
    assert guessed(f"{prose} pwd: {words[0]}-{words[1]}") == []  # the text's own words stay cheap


def test_values_of_letters_or_digits_alone_are_costed():
    assert guessed("passphrase: qzkfjwplmxvr") == ["qzkfjwplmxvr"]
    assert guessed("pwd: 84739201847362 and pwd is 84739201847362") == ["84739201847362"] * 2
    assert secrets.redacted("passphrase: qzkfjwplmxvr") == "passphrase: [guess]"
    assert guessed("pwd: 19991231 login: qwertyuiop pwd: password") == []
    assert guessed("the password is wonderful") == []


def test_a_secret_is_no_dictionary_for_another():
    first, second = "Xkqjzvbnw8842Q", "Wmzrtplk9931Zc"
    assert guessed(f"password is {first}") == [first]
    assert guessed(f"password is {first} and login is {second}") == [first, second]
    assert guessed(f"password is {first} , again Xkqjzvbnw") == [first]
    assert guessed("password is kqzjxwvbnmtrplgh") == ["kqzjxwvbnmtrplgh"]
    assert guessed("pwd is 839201847362519") == ["839201847362519"]


def least_cost(value: str, ranks: dict[str, int]) -> float:
    """The guess cost by enumeration: the least sum over all ways to cut value into parts that may stand alone."""
    import math

    def part(x: str) -> list[float]:
        low, out = x.lower(), []
        if len(x) == 1:
            return [secrets.brute(x)]
        for form, extra in ((low, 0.0), (low.translate(secrets.LEET), 0.3)):
            if len(x) >= 3 and form in ranks:
                out.append(math.log10(ranks[form] + 1) + extra + (0.3 if x != low else 0.0))
        if len(x) >= 4 and secrets._DATE.fullmatch(x):
            out.append(math.log10(365 * (100 if len(x) > 4 else 1)))
        for unit in (1, 2, 3):
            n = len(x) // unit
            if x == x[:unit] * n and n > 1 and len(x) >= max(3, 2 * unit):
                out.append(sum(map(secrets.brute, x[:unit])) + math.log10(n))
        if len(x) >= 3 and all((a, b) in secrets._STEP for a, b in zip(low, low[1:], strict=False)):
            out.append(math.log10(47 * 2 * len(x)))
        return out

    if not value:
        return 0.0
    return min((c + least_cost(value[k:], ranks) for k in range(1, len(value) + 1) for c in part(value[:k])), default=math.inf)


def test_guess_costs_equal_an_enumeration_of_all_cuts():
    rng, ranks = random.Random(11), {"pass": 1, "word": 5, "cat": 40, "dog": 7, "secret": 3}
    bits = ["pass", "P4ss", "word", "cat", "d0g", "a", "7", "-", "qwe", "asd", "123", "aaa", "abab", "1999", "2001-12"]
    for _ in range(400):
        value = "".join(rng.choice(bits) for _ in range(rng.randint(1, 4)))[:11]
        assert abs(secrets.guess_cost(value, ranks) - least_cost(value, ranks)) < 1e-9, value


def test_words_of_all_documents_are_ranked_without_credentials(spark):
    rows = [(i, "tarim velo " * 3 + f"kesto pwd: Xkqjzvbnw8842Q Xkqjzvbnw8842Q {i}", "en", "s") for i in range(5)] + [(9, None, None, None)]
    ranks = secrets.corpus_ranks(documents(spark, rows))
    assert ranks["tarim"] == 1 and ranks["velo"] == 2 and "kesto" in ranks and "pwd" in ranks and "xkqjzvbnw" not in ranks
    assert [r["n_guess"] for r in secrets.secrets(documents(spark, rows)).orderBy("doc_id").collect()] == [1] * 5 + [0]
    assert secrets.secrets(documents(spark, [])).count() == 0


def test_long_values_cost_time_in_proportion():
    import time

    began = time.process_time()
    assert len(guessed("password: !" + "k" * 400_000 + "x")) == 1
    assert time.process_time() - began < 5


def test_every_token_is_trained_on(spark, monkeypatch):
    seen = []
    plain = masked_lm.trained
    monkeypatch.setattr(masked_lm, "trained", lambda docs, words, stride: seen.append(stride) or plain(docs, words, stride))
    rows = [(i, f"left{i % 2} right{i % 2}", "en", "s") for i in range(20_000)] + [(-1, "left0 right1", "en", "s")]
    got = {r["doc_id"]: r for r in masked_lm.masked_lm(documents(spark, rows).coalesce(1)).where("doc_id < 2").collect()}
    assert seen == [1]
    assert got[0]["log_prob"] > got[-1]["log_prob"] + 1
    assert got[0]["log_prob"] > -2.5  # both words are learned


def test_rare_words_get_their_share_of_a_bucket(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(masked_lm, "vocabulary", lambda docs: {"common": 0})
    texts = ["common " + " ".join(rng.choices(["Often", "seldom", "Ünï", *(f"r{k}" for k in range(200))], [60, 9, 9, *[1] * 200], k=rng.randint(0, 30))) for _ in range(150)]
    rows = [(None if i % 50 == 0 else i % 140, t, "en", "s") for i, t in enumerate(texts)] + [(900, None, "en", "s")]
    docs = documents(spark, rows).coalesce(1)
    words = masked_lm.vocabulary(docs)
    model = masked_lm.start()
    monkeypatch.setattr(masked_lm, "trained", lambda docs, words, stride: model)
    counts = Counter(w for t in texts for w in t.lower().split() if w not in words)
    bucket = lambda w: masked_lm.bucket_of(w.encode())
    totals = Counter()
    for w, n in counts.items():
        totals[bucket(w)] += n
    share = lambda t: sum(math.log(counts[w] / totals[bucket(w)]) for w in (t or "").lower().split() if w in counts)
    ids = masked_lm.Ids(words)

    def plain(text):
        tokens = masked_lm.ids_of(text or "", ids)
        return len(tokens), float(masked_lm.log_probabilities(model, tokens, masked_lm.contexts(tokens)).astype(float).sum()) if len(tokens) else 0.0

    want = sorted((str(i), plain(t)[0], plain(t)[1] + share(t)) for i, t, *_ in rows)
    got = masked_lm.masked_lm(docs).collect()
    for r, w in zip(sorted((str(r["doc_id"]), r["n_tokens"], r["log_prob"]) for r in got), want, strict=True):
        assert r[:2] == w[:2] and abs(r[2] - w[2]) < 1e-3, (r, w)
    assert {r["mean_log_prob"] for r in got if r["doc_id"] == 900} == {None}


def test_warc_records_with_very_long_urls_come_back(spark):
    rng = random.Random(2)
    far = "http://a/" + "".join(rng.choices("abcdef /", k=2 << 20))
    rows = [(1, "http://b/", "one"), (2, far, "two"), (3, "http://c/", "three"), (4, far, "three")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for compress in (True, False):
        got = warc.round_trip(pages, compress=compress).collect()
        assert {(r["page_id"], r["payload_bytes"], r["record_type"]) for r in got} == {(1, 3, "response"), (2, 3, "response"), (3, 5, "revisit"), (4, 5, "response")}


def test_warc_records_that_are_lost_are_an_error(spark, monkeypatch):
    plain = warc.read
    monkeypatch.setattr(warc, "read", lambda archives, range_bytes: plain(archives, range_bytes).where("page_id <> 2"))
    with pytest.raises(RuntimeError, match="2 records were written, 1"):
        warc.round_trip(spark.createDataFrame([(1, "u", "x"), (2, "v", "y")], "page_id long, url string, html string"))


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
def test_warc_headers_are_taken_in_any_pieces(step):
    data = warc.record_bytes(5, "http://x/" + "y" * 9000, b"<p>", "D" * 32, "response", None)
    parser = warc.Parser()
    for k in range(0, len(data), step):
        parser.feed(data[k : k + step])
    assert parser.whole and parser.size == len(data) and len(parser.line) <= warc.LINE_BYTES
    assert parser.row()[:2] == (5, "response")


def test_the_network_beats_counts_on_texts_it_has_not_seen():
    """Held out: documents of four languages, of which words alone say less than their surroundings do."""
    import numpy as np
    import pyarrow.parquet as pq

    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    train, held = texts[:800], texts[800:]
    counts = Counter(w for t in train for w in masked_lm.split(t))
    order = sorted(counts, key=lambda w: (-counts[w], w))[: masked_lm.RARE]
    ids = masked_lm.Ids({w.decode("utf-8", "surrogatepass"): i for i, w in enumerate(order)})
    trainer = masked_lm.Trainer()
    for _ in range(2):
        for t in train:
            if len(k := masked_lm.ids_of(t, ids)):
                trainer.add(k, masked_lm.contexts(k))
    trainer.flush()
    own = [k for t in held if len(k := masked_lm.ids_of(t, ids))]
    plain = np.bincount(np.concatenate([masked_lm.ids_of(t, ids) for t in train]), minlength=masked_lm.VOCABULARY) + 0.5
    plain = np.log(plain / plain.sum())
    tokens = np.concatenate(own)
    got = masked_lm.log_probabilities(trainer.model, tokens, np.concatenate([masked_lm.contexts(k) for k in own]))
    assert got.astype(float).mean() > plain[tokens].mean() + 0.4


def test_scores_equal_those_worked_out_one_token_at_a_time(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    model = {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in masked_lm.SHAPES.items()}
    words = {f"w{i}": i for i in range(300)}
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 340, n)) for n in (1, 2, 5, 40)]

    def softmax(h, w, b):
        z = h @ w + b
        return z - np.log(np.exp(z).sum())

    def plain(text):
        ids = [words.get(w, masked_lm.RARE + masked_lm.bucket_of(w.encode())) for w in text.split()]
        total = 0.0
        for i, t in enumerate(ids):
            near = [ids[i + o] if 0 <= i + o < len(ids) else masked_lm.OUTSIDE for o in masked_lm.OFFSETS]
            h = np.tanh(sum(model["e"][k, x] for k, x in enumerate(near)) + model["b"])
            total += sum(softmax(h, model[f"w{s}"][t // 16 ** (3 - s)], model[f"b{s}"][t // 16 ** (3 - s)])[t // 16 ** (2 - s) % 16] for s in range(3))
        return total

    got = masked_lm.score(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), words, model).orderBy("doc_id").collect()
    assert all(abs(r["log_prob"] - plain(t)) < 1e-3 * (1 + abs(plain(t))) for r, t in zip(got, texts, strict=True))


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, `row` string, hit boolean, failed boolean, `rows` long, size long, copies long, `of_doc` long, bits string, `a.b` string, node string"


def clashing(spark, rows):
    """Rows of (doc_id, text, lang, source) with columns of the names that stages use within."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "r", True, True, 9, 8, 7, 6, "b", "d", "n") for i, t, lang, s in rows], CLASHING)


STAGE_FORMS = {
    "keep": lambda docs: quality.keep(docs),
    "one_of_each": lambda docs: ngram_join.one_of_each(docs),
    "redact": lambda docs: secrets.redact(docs),
    "emit": lambda docs: mixing.emit(docs),
}


@pytest.mark.parametrize("name", list(STAGE_FORMS))
def test_stage_forms_take_odd_rows_columns_of_any_name_and_no_rows(spark, name):
    docs = clashing(spark, ODD)
    got = STAGE_FORMS[name](docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r["row"] == "r" and r["a.b"] == "d" and r["size"] == 8 and r["node"] == "n" for r in rows)
    ids = Counter(r["doc_id"] for r in rows)
    if name == "keep":
        assert set(ids) == {4, 5} or set(ids) <= {4, 5}  # the others have under ten words or are repeats
    elif name == "one_of_each":
        assert ids[4] == 1 and ids[5] == 0 and ids[None] == 1 and ids[1] == ids[2] == ids[3] == 1
    elif name == "redact":
        assert len(rows) == len(ODD) and [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    assert STAGE_FORMS[name](docs.limit(0)).count() == 0


def test_a_repeated_id_is_judged_by_its_own_texts(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(7, text(1), "en", "s"), (7, text(2), "en", "s"), (3, text(2), "en", "s"), (7, text(1), "en", "s")]
    got = ngram_join.one_of_each(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(3, text(2)), (7, text(1))]


def test_filters_never_miss(spark):
    from driftloom.llm.common import may_hold, membership

    held = spark.range(0, 3000, 3)
    tested = may_hold(spark.range(-100, 3000).withColumnRenamed("id", "k"), F.col("k"), membership(held)).collect()
    assert all(r["hit"] for r in tested if 0 <= r["k"] and r["k"] % 3 == 0)
    assert sum(r["hit"] for r in tested) < 1000 + 20


def test_the_pipeline_runs_over_odd_rows_and_none(spark, tmp_path):
    import corpus_pipeline

    good = [(100 + k, " ".join(f"d{k}w{i}" for i in range(30)), "en", "a") for k in range(6)] + [(200, " ".join(f"d0w{i}" for i in range(30)), "en", "b")]
    docs = documents(spark, [*ODD, *good, (300, "password: hunter2hunter " + " ".join(f"s{i}" for i in range(30)), "en", "a")]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "one" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "one")).collect()
    ids = {r["doc_id"] for r in rows}
    assert {100 + k for k in range(6)} <= ids and 200 not in ids and not ids & {1, 2, 3, 6, 7}
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 1024 and sorted(x)[0][0] == 0 for x in used.values())
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_many_distinct_triples_take_bounded_memory():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    found = [langid.grams_of("".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 4000))) for _ in range(16)]
    tracemalloc.start()
    got = langid.text_vectors(found)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got.shape == (16, langid.DIMENSIONS) and peak < 150e6


def test_a_worker_keeps_the_cache_of_one_operator(spark):
    """Stages of the pipeline share their workers: what one has cached is gone when the next one runs."""
    import pyarrow as pa

    from driftloom.llm import common, packing

    text = " ".join(f"word{k}" for k in range(3000))
    before = ngram_join.shingles(text)
    assert len(common.worker_cache(ngram_join.WORDS, dict)) >= 3000
    ids = packing._encoder("byte_bpe_50k.json")(text)
    assert list(common._WORKER) == ["byte_bpe_50k.json"]
    assert (ngram_join.shingles(text) == before).all() and list(common._WORKER) == [ngram_join.WORDS]
    assert packing._encoder("byte_bpe_50k.json")(text) == ids
    assert list(common.lean(lambda batches: (sorted(common._WORKER) for _ in batches))([1])) == [[]]
    docs = documents(spark, [(k, text, "en", "s") for k in range(3)]).coalesce(1)

    def names(batches):
        for batch in batches:
            ngram_join.shingles(batch.column(0)[0].as_py())
            packing._encoder("byte_bpe_50k.json")
            yield pa.RecordBatch.from_arrays([pa.array([",".join(common._WORKER)])], names=["held"])

    assert {r["held"] for r in docs.select("text").mapInArrow(names, "held string").collect()} == {"byte_bpe_50k.json"}
