"""Sharding, spelling variants and phrases, each against a plain version."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LOWER, ODD, documents

from driftloom.llm import phrases, sharding, spelling


def sharded(df, shards=40):
    return [r.asDict() for r in sharding.shard(df, shards).collect()]


def check_law(rows, got, shards=40):
    """Counts at most one apart, slots without gaps, sizes and digests of whole texts."""
    per = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and all(0 <= s < shards for s in per)
    assert max(per.values(), default=0) - (min(per.values()) if len(per) == shards else 0) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_shards_match_the_mixture(spark):
    rng = random.Random(5)
    source = lambda i: "big" if i % 3 == 0 else None if i % 50 == 1 else f"s{i % 7}"
    rows = [(i, "copy" if i % 4 == 0 else f"text {rng.random()}", "en", source(i)) for i in range(3000)]
    got = sharded(documents(spark, rows))
    check_law(rows, got)
    of = {i: s for i, _, _, s in rows}
    per = Counter((r["shard"], of[r["doc_id"]]) for r in got)
    for name, n in Counter(of.values()).items():
        assert all(abs(per[(s, name)] - n / 40) <= 2 for s in range(40)), name
    again = sharded(documents(spark, rows).repartition(7))
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if of[r["doc_id"]] == "big"]
    assert sum(a < b for a, b in zip(order, order[1:], strict=False)) < 0.6 * len(order)  # shuffled


@pytest.mark.parametrize("rows", [ODD, ODD * 30, [], [(None, "same", None, None)] * 500, [(7, None, "en", "a")] * 41])
def test_shards_of_odd_rows(spark, rows):
    check_law(rows, sharded(documents(spark, rows)))


def test_shards_of_very_many_sources(spark):
    rows = [(i, "x", "en", f"source {i}") for i in range(2000)]
    got = sharded(documents(spark, rows), 8)
    check_law(rows, got, 8)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order != sorted(order)


def plain_words(rows):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 6
    return {w: n for w, n in counts.items() if n >= 5}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v.encode())) if vs else None for w, vs in near.items()}
    form = {w: f if f and words[f] >= 5 * words[w] else None for w, f in form.items()}
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def test_variants_equal_a_comparison_of_all_words(spark):
    rng = random.Random(2)
    bases = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(25)]
    words = list(bases)
    for b in bases:
        for _ in range(6):
            k = rng.randrange(len(b))
            words.append(rng.choice([b[:k] + b[k + 1 :], b[:k] + "é" + b[k:], b[:k] + "b" + b[k + 1 :], b[:k] + b[k + 1 : k + 2] + b[k] + b[k + 2 :]]))
    rows = []
    for i in range(300):
        picked = [words[min(int(rng.expovariate(0.04)), len(words) - 1)] for _ in range(80)]
        rows.append((None if i % 9 == 0 else i, rng.choice([" ", ", ", "\n", "1"]).join(w.upper() if rng.random() < 0.1 else w for w in picked), "en", "s"))
    want = plain_variants(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] and r[1] for r in want)
    got = spelling.variants(documents(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == want


def test_variants_of_odd_rows_and_very_long_words(spark):
    long = "ab" * 60_000
    rows = ODD * 3 + [(100 + k, f"{long} {long[:777]}x{long[778:]} Zeichen zeichenÀ×÷", "de", "s") for k in range(6)] + [(200, f"{long} " * 30, "de", "s")]
    got = {r["word"]: r for r in spelling.variants(documents(spark, rows)).collect()}
    words = plain_words(rows)
    assert {w: r["n"] for w, r in got.items()} == words
    other = f"{long[:777]}x{long[778:]}"
    assert got[other]["form"] == got[other]["root"] == long and got[long]["form"] is None and got[long]["n_near"] == 1
    assert spelling.variants(documents(spark, [])).count() == 0 and spelling.variants(documents(spark, ODD[:3])).count() == 0


def test_long_texts_are_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "_SLICE", 50)
    text = " ".join("wordÉ" * (k % 7 + 1) + "-" * (k % 3) for k in range(300)) + "é" * 200
    assert spelling.runs(text.encode()) == Counter(r.translate(LOWER).encode() for r in re.findall("[A-Za-zÀ-ÿ]+", text))


def test_keys_are_those_of_the_distinct_deletions():
    digest = {w: next(spelling.keys_of(w))[0] for w in ("aab", "ab", "aa", "b", "")}
    keys = list(spelling.keys_of("aab"))
    assert keys == [(digest["aab"], -1, -1), (digest["ab"], 0, 1), (digest["aa"], 2, 2)]
    assert [k for k, *_ in spelling.keys_of("b")] == [digest["b"], digest[""]]


def plain_phrases(rows, least=30, best=2000):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, 5):
                for k in range(len(w) - n + 1):
                    f[lang or "und"][tuple(w[k : k + n])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((p, a, counts[p[:k]], counts[p[k:]], score))
        held: dict = {}
        for q, b, *_ in found:
            for n in range(2, len(q)):
                for k in range(len(q) - n + 1):
                    held[q[k : k + n]] = max(held.get(q[k : k + n], 0), b)
        kept = [x for x in found if 100 * held.get(x[0], 0) < 80 * x[1]]
        kept.sort(key=lambda x: (-x[4], -x[1], " ".join(x[0]).encode()))
        out += [(lang, r, " ".join(p), a, left, right, total[lang], s) for r, (p, a, left, right, s) in enumerate(kept[:best], 1)]
    return sorted(out)


def spoken(rng, words, n):
    gap = lambda: rng.choice([" ", " ", " ", "  ", "\t", " \t ", ", ", ".", "\n", "\r\n", "\xa0"])
    return "".join(rng.choice(words) + gap() for _ in range(n))


@pytest.mark.parametrize("chunk", [1 << 23, 400])
def test_phrases_equal_a_count_of_all_n_grams(spark, monkeypatch, chunk):
    monkeypatch.setattr(phrases, "_CHUNK", chunk)
    rng = random.Random(chunk)
    words = ["New", "york", "new", "of", "the", "Über", "state", "x" * 40] + [f"w{k}" for k in range(20)]
    rows = [(k, spoken(rng, words[:12], 400) + "the state of new york " * (k % 3) + "of the the of", rng.choice(["en", "de", None]), "s") for k in range(90)]
    rows += [(500, None, "en", "s"), (501, "", None, "s"), (502, ". , ;", "fr", "s"), (503, "hapax", "fr", "s")]
    want = plain_phrases(rows)
    assert len(want) > 50 and any(len(r[2].split(" ")) == 4 for r in want)
    got = phrases.collocations(documents(spark, rows)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == want
    few = phrases.collocations(documents(spark, rows), best=7).select("lang", "rank", "phrase").collect()
    assert sorted(map(tuple, few)) == sorted(r[:3] for r in want if r[1] <= 7)


def test_phrases_of_odd_rows_and_very_long_words(spark):
    long = "z" * (phrases._BLOCK + 100)
    rows = ODD * 12 + [(100 + k, f"{long} and {long} and", "en", "s") for k in range(31)]
    got = phrases.collocations(documents(spark, rows)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows)
    assert phrases.collocations(documents(spark, [])).count() == 0


class Colliding(phrases.Words):
    def grams(self, n):
        at, (one, two) = super().grams(n)
        return at, [one & np.uint64(7), two]


def test_n_grams_of_one_digest_are_told_apart():
    raw = b"a b c d e f g h a b c d x y z a b"
    lang, ends = np.zeros(1, np.uint64), np.array([len(raw) + 1])
    words, odd = phrases.Words(raw, lang, ends), Colliding(raw, lang, ends)


    def counts(w):
        at, n = phrases.told(w, 2, None)
        return dict(zip(w.phrases(at, 2), n.tolist(), strict=True))

    assert counts(words) == counts(odd) and counts(words)[b"a b"] == 3
