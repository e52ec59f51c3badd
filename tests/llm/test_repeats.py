"""Periodic runs, repeated strings and collocations against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from orthoflow.llm import collocations, periods, queries, suffixes

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t "), (None, "a b"), (None, None), (5, "x" * 50_000), (6, "é ü 日本 😀 " * 30), (6, "é ü 日本 😀 " * 30), (7, "one"), (10, "a\x1cb\x0bc " * 40)]


# periodic runs


def smallest_period(w):
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def plain_runs(w):
    found = set()
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p) and smallest_period(w[i : j + p]) == p:
                found.add((i, j + p - i, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and best[1] * 1000 // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(),
    )


def odd_texts(rng):
    for k in range(60):
        letters = "ab" if k % 3 else "abcdefghij"
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 40))]
        w = []
        while len(w) < rng.randrange(10, 400):
            w += rng.choice([unit * rng.randrange(1, 9), [rng.choice(letters) for _ in range(rng.randrange(60))], [rng.choice("ab")] * rng.randrange(30)])
        yield " ".join(w)
    yield " ".join("a" for _ in range(1000))
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    yield " ".join(fibonacci[-1])
    yield " ".join("ab"[bin(i).count("1") % 2] for i in range(1024))


def test_runs_against_brute_force(documents, monkeypatch):
    monkeypatch.setattr(periods, "CHUNK_WORDS", 500)
    monkeypatch.setattr(periods, "CHUNK_PAIRS", 100)
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(odd_texts(random.Random(3))))]
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in rows]
    got = periods.report(periods.periodic_runs(documents(rows, extra=True), planted=True)).collect()
    assert [tuple(r) for r in got] == [plain_report(*r) for r in rows]
    assert sum(r["n_runs"] > 0 for r in got) > 30


def test_runs_of_the_table(spark):
    docs = queries.table(spark, SF, "documents")
    got = {tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    short = [r for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 6000]
    assert {plain_report(*r) for r in short} <= got and len(got) == docs.count()


def test_collisions_make_no_run(monkeypatch):
    texts = [t.encode().split() for t in odd_texts(random.Random(5))]
    words, ends = periods.numbered(texts)
    right = periods.find_runs(words, ends)
    made = periods.PrefixHashes
    seeds = []

    class Weak(made):  # with the first seed all words look alike
        def __init__(self, words, seed):
            seeds.append(seed)
            super().__init__(words * (seed > 1), seed)

    monkeypatch.setattr(periods, "PrefixHashes", Weak)
    assert (periods.find_runs(words, ends) == right).all() and seeds == [1, 2]


def test_products_modulo_a_mersenne_prime():
    rng, p = random.Random(1), (1 << 61) - 1
    a = [0, 1, p - 1, p - 1, *(rng.randrange(p) for _ in range(500))]
    b = [p - 1, p - 1, p - 1, 0, *(rng.randrange(p) for _ in range(500))]
    assert periods._times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % p for x, y in zip(a, b)]


# repeated strings


def plain_repeats(texts, span):
    places = Counter(t[x : x + span] for t in texts for x in range(len(t) - span + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for x in range(len(t) - span + 1):
            if places[t[x : x + span]] > 1:
                gone[x : x + span] = True
        n = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        yield len(t), int(gone.sum()), n, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()


def overlapping(rng, n):
    letters = "abcdefgh "
    stock = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 200))) for _ in range(12)]
    head = "".join(rng.choice(letters) for _ in range(60))
    for k in range(n):
        t = "".join(rng.choice(stock) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(rng.randrange(1, 7)))
        if rng.random() < 0.3:
            t = head + t  # one head of many texts
        if rng.random() < 0.3 and t:
            i = rng.randrange(len(t))
            t = t[:i] + "é" + t[i:]
        yield t


@pytest.mark.parametrize("seed,bucket_bytes,broadcast", [(1, 1 << 20, 1_000_000), (2, 2000, 1_000_000), (3, 500, 0)])
def test_repeats_against_brute_force(documents, seed, bucket_bytes, broadcast, monkeypatch):
    monkeypatch.setattr(suffixes, "BROADCAST_ROWS", broadcast)
    if seed == 2:
        monkeypatch.setattr(suffixes, "RANGES", 5)
    if seed == 3:
        monkeypatch.setattr(suffixes, "SEGMENT", 64)
    rng = random.Random(seed)
    rows = [(i, t) for i, t in enumerate(overlapping(rng, 150))]
    rows += [(None, rows[3][1]), (4, rows[4][1]), (900, None), (901, ""), (902, "z" * 500), (903, "zy\0" * 90), (904, rows[7][1] * 2)]
    got = suffixes.report(suffixes.kept_texts(documents(rows, extra=True), span=40, window=24, bucket_bytes=bucket_bytes)).collect()
    want = [(i, *r) for (i, _), r in zip(rows, plain_repeats([(t or "").encode() for _, t in rows], 40))]
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(r["n_removed"] > 0 for r in got) > 50


def test_a_lead_beyond_its_bucket_is_counted(documents, monkeypatch):
    asked = []
    counted = suffixes._counted_starts
    monkeypatch.setattr(suffixes, "_counted_starts", lambda *a: asked.append(1) or counted(*a))
    rng = random.Random(9)
    letters = "abcdefghijkl"
    head = "".join(rng.choice(letters) for _ in range(90))
    rows = [(i, head + "".join(rng.choice(letters) for _ in range(50))) for i in range(400)]
    got = suffixes.report(suffixes.kept_texts(documents(rows), span=40, window=24, bucket_bytes=4000)).collect()
    want = [(i, *r) for (i, _), r in zip(rows, plain_repeats([t.encode() for _, t in rows], 40))]
    assert asked and Counter(map(tuple, got)) == Counter(want)


def test_anchors_of_equal_strings_are_equal():
    rng = random.Random(4)
    same = bytes(rng.choice(b"ab") for _ in range(400))
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) + same + bytes(rng.choice(b"ab") for _ in range(300 - n)) for n in (3, 77, 250)]
    found = []
    for n, t in zip((3, 77, 250), texts):
        at, first, last = suffixes.anchors(t)
        assert first[0] == 0 and last[-1] == len(t) - 400 and (first[1:] == last[:-1] + 1).all() and ((first <= last) & (last <= at)).all()
        found.append(int(at[(first <= n) & (n <= last)][0]) - n)
    assert len(set(found)) == 1


def test_multikey_order_is_the_order_of_strings():
    rng = random.Random(8)
    strings = [bytes(rng.choice(b"ab\xff") for _ in range(rng.randrange(40))) for _ in range(500)]
    order, shared = suffixes.multikey_order(strings, 40)
    placed = [strings[i].ljust(40, b"\0") for i in order]
    assert placed == sorted(placed)
    assert [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), 40) for a, b in zip(placed, placed[1:])] == shared[1:].tolist()


# collocations


def plain_collocations(rows, least, best):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = []
        for p, a in own.items():
            if len(p) > 1 and a >= least:
                cuts = [(2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((p, a, own[p[:k]], own[p[k:]], score))
        longer = [(p, a) for p, a, *_ in found]
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = [x for x in found if not any(len(q) > len(x[0]) and 100 * b >= 80 * x[1] and inside(x[0], q) for q, b in longer)]
        kept.sort(key=lambda x: (-x[4], -x[1], " ".join(x[0]).encode()))
        out += [(lang, i + 1, " ".join(p), a, l, r, n[lang], s) for i, (p, a, l, r, s) in enumerate(kept[:best])]
    return out


@pytest.mark.parametrize("least,best,shard,size", [(3, 2000, 1 << 22, 1 << 20), (2, 20, 50, 300), (4, 2000, 300, 2000)])
def test_collocations_against_brute_force(documents, least, best, shard, size):
    rng = random.Random(least)
    vocabulary = [*"abcdefghijk", "É", "the", "The", "日本"]
    texts = []
    for i in range(120):
        w = [rng.choice(vocabulary[: rng.randrange(2, 15)]) for _ in range(rng.randrange(40))]
        text = "".join(x + rng.choice([" ", " ", " ", "\t", " \t ", ", ", ".", "\r\n", "\x0b"]) for x in w)
        texts.append((i, text, rng.choice(["en", "en", "en", "fr", None])))
    texts += [(i, t, "en") for i, t in ODD] + [(1, "the the the the the the " * 20, "xx"), (2, "... ,,", "yy"), (3, "a\x00b é " * 9, "zz")]
    got = collocations.collocations(documents(texts, extra=True), least, best, shard, size).collect()
    assert sorted(map(tuple, got)) == sorted(plain_collocations([(lang, t) for _, t, lang in texts], least, best))
    assert len(got) > 20


def test_products_beyond_64_bits(spark):
    big = 9 * 10**17
    counts = spark.createDataFrame(
        [("x", "a b", 2, big, 1), ("x", "a", 1, big + 5, 1), ("x", "b", 1, big + 9, 1)], "lang string, phrase string, words int, f long, n long"
    )
    assert [r["score"] for r in collocations.scored(counts).collect()] == [2_000_000 * big // (2 * big + 14)]


def test_tries_merge_to_the_trie_of_all():
    rng = random.Random(2)
    texts = [[rng.choice([b"a", b"b", b"cc", b"."]) for _ in range(rng.randrange(30))] + [b"."] for _ in range(40)]
    whole = collocations.Trie.of_texts(texts)
    shards = [collocations.Trie.of_texts(texts[i::3]) for i in range(3)]
    merged = collocations.Trie.merged([t.serialised(0, len(t.paths)) for t in shards])
    assert merged.words == whole.words and (merged.paths == whole.paths).all() and (merged.counts == whole.counts).all()
    splitters = [(b"en", b"b", b"a", b"", b""), (b"en", b"cc", b"", b"", b""), (b"fr", b"a", b"", b"", b"")]
    parts = whole.cut(b"en", splitters)
    assert [p[0] for p in parts] == [0, 1, 2] and parts[0][1] == 0 and parts[-1][2] == len(whole.paths)
    assert all(whole.path(a) >= splitters[k - 1][1:] for k, a, _ in parts[1:]) and all(whole.path(b - 1) < splitters[k][1:] for k, _, b in parts[:-1])


def test_empty_tables_of_repeats(documents):
    for rows in ([], [(1, None), (2, "")]):
        docs = documents(rows)
        assert periods.periodic_runs(docs).count() == len(rows)
        assert suffixes.kept_texts(docs).count() == len(rows)
        assert collocations.collocations(docs).count() == 0


@pytest.mark.parametrize("name", ["op12_suffix_dedup", "op13_collocations"])
def test_sql_of_repeats(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
