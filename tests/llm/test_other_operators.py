"""Search, joins, scoring, archives and the pipeline, each against a plain version or a round trip."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LOWER, ODD, WORDS, documents

from driftloom.llm import components, masked_lm, ngram_join, topk, warc


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, score double")


def plain_top(rows, asked, k):
    ok = {}
    for i, v in sorted((i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)):
        ok.setdefault(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int))
    out = []
    for q in sorted(set(asked) & set(ok)):
        found = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    rows += [(300 + i, rows[5][1]) for i in range(8)]  # ties
    rows += [(400, None), (401, [None] + [1.0] * 7), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (404, [1.0, 2.0]), (405, [3.0, -1.0]), (7, rows[7][1])]
    asked = list(range(0, 200, 10)) + [404]
    df = vectors(spark, rows)
    got = topk.top_k(df, df.where(df.vec_id.isin(asked))).collect()
    assert sorted(map(tuple, got)) == plain_top(rows, asked, 5)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_bounds_leave_out_no_winner():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(2000, 16)) * 100)
    q = x[:20] + np.floor(rng.normal(size=(20, 16)) * 5)
    lists, alive = topk.Lists(x), np.zeros((20, 2000), bool)
    for i in range(20):
        alive[i, lists.survivors(q[i], np.arange(2000), 5)] = True
    for i, scores in enumerate(q @ x.T):
        assert alive[i][scores >= np.sort(scores)[-5]].all()
    assert alive.mean() < 0.6


def test_bounds_hold_and_prune_vectors_without_near_neighbours():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(3000, 64)) * 40)
    lists, rows, resolved = topk.Lists(x), np.arange(3000), []
    for q in np.floor(rng.normal(size=(12, 64)) * 40):
        scores = x @ q
        for reach in topk.ROUNDS:
            lower, upper = lists.bounds(q, rows, reach)
            assert (lower <= scores).all() and (scores <= upper).all()
        left = lists.survivors(q, rows, 5)
        assert set(np.argsort(-scores, kind="stable")[:5]) <= set(left.tolist())
        resolved.append(len(left) / len(x))
    assert np.mean(resolved) < 0.2


@pytest.mark.parametrize("kind", ["even", "skewed", "ties", "zeros"])
def test_first_bounds_hold_and_leave_few(kind, monkeypatch):
    alone, bounds = [], topk.Lists.bounds
    monkeypatch.setattr(topk.Lists, "bounds", lambda *a: alone.append(1) or bounds(*a))
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(12_000, 64)) * 40).astype(np.int64)
    if kind == "skewed":
        x[:, 3:] //= 8
    elif kind == "ties":
        x[1000:2000] = x[5]
    elif kind == "zeros":
        x[:, 20:] = 0
        x[50] = 0
    ids, lists = rng.permutation(12_000) * 3, topk.Lists(x)
    lower, upper = lists.first_bounds(x[::200].astype(float))
    scores = x[::200] @ x.T
    assert (lower <= scores).all() and (scores <= upper).all()
    resolved = []
    got = topk.search(ids[::200], x[::200], ids, x, 5, resolved)
    for name, row, (found, of) in zip(ids[::200], scores, zip(got[1], got[2], strict=True), strict=True):
        best = [i for i in np.lexsort((ids, -row)) if ids[i] != name][:5]
        assert found.tolist() == ids[best].tolist() and of.tolist() == row[best].tolist()
    if kind == "even":
        assert np.mean(resolved) < 0.1 * len(x)
        assert len(alone) < 0.5 * len(resolved)  # most queries are not read by themselves


def test_only_shingles_of_two_prefixes_make_rows(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(60)) for _ in range(80)]
    near = texts[0].split()
    near[30] = "other"
    texts += [" ".join(near), *texts[1:41]]  # copies, which are no second prefix
    df = documents(spark, [(i, t, "en", "a") for i, t in enumerate([*texts, None, ""])])
    rows, table = ngram_join.described(df, 3)
    order = ngram_join.Order(spark, table, (90, 100))
    got = ngram_join.prefixes(df, ngram_join.nodes_of(rows), order, 3).collect()
    own = {ngram_join.node_of(x): order.prefix(x)[0] for x in (ngram_join.shingles(t, 3) for t in texts)}
    held = Counter(x for p in own.values() for x in p.tolist())
    found = [(np.array([r["shingle"]]).view(np.uint64)[0].item(), bytes(r["node"])) for r in got]
    assert set(found) == {(x, node) for node, p in own.items() for x in p.tolist() if held[x] > 1} and found
    assert len(found) == len(set(found))


def test_no_shared_shingle_is_left_out():
    rng = np.random.default_rng(2)
    found = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    part, digest = ngram_join.seen_places(found)
    bits = np.zeros(1 << ngram_join.SEEN_BITS, bool)
    at = part * ((1 << ngram_join.SEEN_BITS) // ngram_join.SEEN_PARTS) + ngram_join.in_part(digest)
    assert part.max() < ngram_join.SEEN_PARTS and at.max() < len(bits)
    bits[at[:10_000]] = True
    told = ngram_join.may_be_shared(found, np.packbits(bits))
    assert told[:10_000].all() and told[10_000:].mean() < 0.01


def plain_components(rows):
    sets = defaultdict(set)
    for i, t, *_ in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    name = {i: i for i in sets}
    done = False
    while not done:
        done = True
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and name[b] < name[a]:
                    name[a], done = name[b], False
    return {i: (len(sets[i]), name[i]) for i in sets}


def near_copies(n: int) -> list[tuple]:
    rng = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(n):
        family = rng.randint(0, 4)
        text = [f"f{family}x{k}" for k in range(90)]
        for _ in range(rng.randint(0, 3)):
            text[rng.randint(0, 89)] = rng.choice(words)
        rows.append((10 + i, " ".join(text), "en", "s"))
    return rows + [(1000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + " a passage that many texts have in common", "en", "s") for i in range(40)]


@pytest.mark.parametrize("few", [0, 3, 8])
def test_ngram_join(spark, few, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 10)
    rows = [r for r in ODD if r[0] is not None] + near_copies(90) + [(2000, "Same Words here", "en", "s"), (2001, "same words HERE", "en", "s"), (2002, "É b c", "en", "s"), (2003, "é b c", "en", "s")]
    got = ngram_join.ngram_join(documents(spark, rows)).collect()
    want = plain_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len(got) == len(rows)


def test_ngram_join_of_odd_rows(spark):
    got = ngram_join.ngram_join(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    assert ngram_join.ngram_join(documents(spark, [])).count() == 0
    kept = [r["doc_id"] for r in ngram_join.one_of_each(documents(spark, ODD)).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, None, 4, 6, 7, 8], key=str)


def test_prefixes_share_matches():
    rng = np.random.default_rng(0)
    table = rng.integers(1, 50, 1 << 10).astype(np.int32)
    for _ in range(200):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, 1 + n // 15))):
            b[rng.integers(0, len(b))] = rng.integers(0, 1 << 62, dtype=np.uint64)
        b = np.unique(b)
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 90 * (len(a) + len(b) - shared):
            (p, m), (q, k) = ngram_join.prefix(a, table, 0.0), ngram_join.prefix(b, table, 0.0)
            assert len(np.intersect1d(p, q)) >= min(m, k)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5)]
    name = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in name:
        for a, b in edges:
            if a != b:
                name[a] = name[b] = min(name[a], name[b])
    got = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == name and len(got) == len(name)


def test_masked_lm_prefers_the_order_it_has_seen(spark):
    rng = random.Random(6)
    chains = [["red", "green", "blue", "white", "black"], ["one", "two", "three", "four", "five"]]
    text = lambda: " ".join(w for _ in range(40) for w in rng.choice(chains))
    rows = [(i, text(), "en", "s") for i in range(120)]
    shuffled = []
    for i in range(20):
        w = text().split()
        rng.shuffle(w)
        shuffled.append((1000 + i, " ".join(w), "en", "s"))
    docs = documents(spark, rows)
    words = masked_lm.vocabulary(docs)
    model = masked_lm.trained(docs.repartition(3), words, 1)
    odd = [(None if i is None else 2000 + i, *rest) for i, *rest in ODD]
    got = {r["doc_id"]: r for r in masked_lm.score(documents(spark, rows[:20] + shuffled + odd), words, model).collect()}
    seen = np.mean([got[i]["mean_log_prob"] for i in range(20)])
    assert seen > np.mean([got[1000 + i]["mean_log_prob"] for i in range(20)]) + 0.3
    assert seen > -np.log(10) + 0.3
    assert all((got[i]["n_tokens"], got[i]["log_prob"], got[i]["mean_log_prob"]) == (0, 0.0, None) for i in (2001, 2002, 2003))
    assert got[2006]["n_tokens"] == 3001
    assert masked_lm.masked_lm(documents(spark, [])).count() == 0


def test_log_probabilities_are_of_a_distribution():
    model = masked_lm.start()
    around = np.array([[1, 2, 3, 4]] * masked_lm.VOCABULARY)
    p = masked_lm.log_probabilities(model, np.arange(masked_lm.VOCABULARY), around)
    assert abs(np.exp(p.astype(float)).sum() - 1) < 1e-3


def test_network_steps_go_downhill():
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, 50, 4000)
    tokens[1::2] = tokens[::2] + 50
    around = masked_lm.contexts(tokens)
    trainer = masked_lm.Trainer()
    before = masked_lm.log_probabilities(trainer.model, tokens, around).mean()
    for _ in range(6):
        trainer.add(tokens, around)
    trainer.flush()
    assert masked_lm.log_probabilities(trainer.model, tokens, around).mean() > before + 2


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, range int")


def b32(text: str) -> str:
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


TRICKY = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nxy\r\n\r\n"
PAGES = [
    (1, "http://a/", "<p>one</p>"),
    (2, "http://b/ x\r\ny", "<p>one</p>"),
    (3, None, None),
    (4, "http://c/", ""),
    (5, "http://d/", TRICKY * 3),
    (6, "http://e/", "é\r\n\r\n" * 500),
    (7, "http://f/", "x" + TRICKY + "WARC/1.1\r\n" + "z" * 3000),
    (8, "http://g/", "<p>one</p>"),
]


@pytest.mark.parametrize(("compress", "range_bytes"), [(True, 1 << 24), (True, 300), (False, 1 << 24), (False, 400)])
def test_warc_round_trip(spark, compress, range_bytes):
    got = warc.round_trip(pages(spark, PAGES).repartition(2), compress=compress, range_bytes=range_bytes).collect()
    last = {h or "": i for i, _, h in PAGES}
    want = {(i, len((h or "").encode()), b32(h or ""), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]) for i, _, h in PAGES}
    assert Counter(map(tuple, got)) == Counter(want)


def test_warc_members_inside_payloads(spark, tmp_path):
    inner = warc.record_bytes(9, "http://x/", b"inner", b32("inner"), "response", None)
    outer = warc.record_bytes(1, "http://y/", b"<p>" + inner + b"</p>" + inner, b32("?"), "response", None)
    last = warc.record_bytes(2, "http://z/", b"end", b32("end"), "response", None)
    (tmp_path / "a.warc").write_bytes(outer + last)
    archives = spark.createDataFrame([(f"file://{tmp_path}/a.warc", len(outer + last), 2)], "archive string, bytes long, records long")
    found = warc.scan(archives, 64)
    assert found.where("page_id = 9").count() == 2
    for size in (64, 200, 1 << 20):
        assert sorted(r["page_id"] for r in warc.read(archives, size).collect()) == [1, 2]


def test_warc_empty_and_odd(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
    odd = [(None, "u", "same"), (5, "u", "same"), (5, "u", "same"), (6, "u", "other")]
    got = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages(spark, odd)).collect())
    assert got == Counter({(None, "revisit", 5): 1, (5, "response", None): 2, (6, "response", None): 1})
    small = Counter((r["page_id"], r["record_type"]) for r in warc.round_trip(pages(spark, PAGES), least_bytes=5).collect())
    assert small[3, "response"] == small[4, "response"] == 1 and small[1, "revisit"] == 1


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    clean = [(i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(120)), "en", f"s{i % 3}") for i in range(60)]
    secret = (70, clean[0][1] + " and then password=abcdef123456 " + " ".join(f"v{k}" for k in range(200)), "en", "s0")
    rows = [*clean, (60, clean[3][1], "en", "s1"), (61, "too short", "en", "s2"), secret]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = {r["doc_id"]: r for r in docs.collect()}
    assert set(left) == {i for i, *_ in clean} | {70}
    assert "abcdef123456" not in left[70]["text"] and left[70]["n_chars"] == len(left[70]["text"])
    assert all(left[i]["text"] == t for i, t, *_ in clean)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024


def test_network_steps_equal_plain_ones(monkeypatch):
    """One step moves the network as sums over single tokens do, for runs of any size; and it makes no product for each node."""
    rng = np.random.default_rng(3)
    tokens = np.concatenate([rng.integers(0, 4096, 300), np.full(90, 7), np.full(20, 4095), np.full(3, 2000)])
    rng.shuffle(tokens)
    around = masked_lm.contexts(tokens)
    trainer, m = masked_lm.Trainer(), masked_lm.start()
    grad = {k: np.zeros(v.shape) for k, v in m.items()}
    for t, near in zip(tokens, around, strict=True):
        h = np.tanh(sum(m["e"][k, x].astype(float) for k, x in enumerate(near)) + m["b"])
        gh = np.zeros(masked_lm.WIDTH)
        for s in range(3):
            node, branch = t // 16 ** (3 - s), t // 16 ** (2 - s) % 16
            z = h @ m[f"w{s}"][node] + m[f"b{s}"][node]
            g = np.exp(z - z.max())
            g = (g / g.sum() - (np.arange(16) == branch)) / len(tokens)
            grad[f"w{s}"][node] += np.outer(h, g)
            grad[f"b{s}"][node] += g
            gh += m[f"w{s}"][node] @ g
        gh *= 1 - h * h
        grad["b"] += gh
        for k, x in enumerate(near):
            grad["e"][k, x] += gh
    taken, plain = [], masked_lm.side_by_side
    monkeypatch.setattr(masked_lm, "side_by_side", lambda *x: [taken.append(1) or y for y in plain(*x)])
    trainer.step(tokens, around)
    assert len(taken) < 30  # there are more than 100 nodes
    for k, v in m.items():
        want = v - masked_lm.RATE * grad[k] / np.sqrt(1e-3 + grad[k] ** 2)
        assert np.abs(trainer.model[k] - want).max() < 1e-4, k
        assert np.allclose(trainer.sums[k], 1e-3 + grad[k] ** 2, atol=1e-6), k
    big = {k: v * 3000 for k, v in m.items()}  # logits beyond what exp can hold
    assert np.isfinite(masked_lm.log_probabilities(big, tokens, around)).all()
    assert len(masked_lm.log_probabilities(m, tokens[:0], around[:0])) == 0


def test_many_small_parts_do_not_make_as_many_copies(spark, tmp_path, monkeypatch):
    rows = [(i, f"some words of text {i}", "en", "s") for i in range(400)]
    documents(spark, rows).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs")).repartition(90)
    held = []
    monkeypatch.setattr(masked_lm, "release", lambda *tables: held.extend((df.count(), df.agg({"weight": "sum"}).first()[0]) for df in tables))
    masked_lm.trained(docs, {"some": 0, "words": 1}, 1)
    assert len(held) == masked_lm.ROUNDS and sum(w for _, w in held) == 400 * 5  # every token is learned from
    assert all(n <= max(spark.sparkContext.defaultParallelism, 1) for n, _ in held)
