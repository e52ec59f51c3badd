"""Exact and near duplicates, decontamination, sharding and packing against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orthoflow.llm import exact_dedup, packing, queries, scratch, sharding, simhash
from orthoflow.llm.decontamination import contamination, drop_contaminated, matches
from orthoflow.llm.exact_dedup import drop_duplicates, exact_duplicates

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho sigma tau ups".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t "), (4, "a  b"), (5, "a\nb"), (6, "a b"), (6, "a b"), (None, "a b"), (None, None), (7, "x" * 300_000), (8, "é ü 日本 😀")]


def test_exact_duplicates_of_odd_rows(documents):
    rows = {}
    for r in exact_duplicates(documents(ODD, extra=True)).collect():
        rows.setdefault(r["text_sha256"], []).append(r)
    assert sum(map(len, rows.values())) == len(ODD)
    want = {}
    for i, t in ODD:
        want.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    for text, ids in want.items():
        group = rows[hashlib.sha256(text.encode()).hexdigest()]
        keep = min((i for i in ids if i is not None), default=None)
        assert {r["group_size"] for r in group} == {len(ids)} and {r["keep_id"] for r in group} == {keep}
        assert sum(r["kept"] for r in group) == 1


def test_hot_group_and_pipeline_stage(documents):
    rows = [(i, "same  text" if i % 3 == 0 else f"text {i}") for i in range(900)]
    found = exact_duplicates(documents(rows), salts=4).collect()
    hot = [r for r in found if r["group_size"] > 1]
    assert len(hot) == 300 and {r["keep_id"] for r in hot} == {0} and sum(r["kept"] for r in found) == 601
    kept = drop_duplicates(documents([*rows, (1, "text 1")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({0, *(i for i in range(900) if i % 3)})


def test_contents_that_share_a_digest_stay_apart(documents):
    rows = [(i, f"text {i % 7}" if i % 2 else None) for i in range(60)] + [(None, "text 1"), (3, "text  3"), (3, "text 3")]
    key = lambda r: (str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"])
    want = sorted(map(key, exact_duplicates(documents(rows)).collect()))
    for weak in (lambda c: F.substring(F.sha2(c, 256), 1, 0), lambda c: F.length(c).cast("string")):
        assert sorted(map(key, exact_duplicates(documents(rows), digest=weak).collect())) == want


def test_repeated_rows_are_numbered_in_chunks(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CHUNK", 10)
    rows = [(None, "a b")] * 95 + [(1, "a  b")] * 20 + [(2, "c")] * 3 + [(3, None)]
    for digest in (exact_dedup.sha256, lambda c: F.substring(c, 1, 0)):
        got = exact_duplicates(documents(rows), digest=digest).collect()
        copies = sorted((r["group_size"], r["doc_id"] or 0, r["copy"]) for r in got)
        assert copies == [(1, 3, 1)] + [(3, 2, k + 1) for k in range(3)] + [(115, 0, k + 1) for k in range(95)] + [(115, 1, k + 1) for k in range(20)]
        assert sorted((r["doc_id"], r["copy"]) for r in got if r["kept"]) == [(1, 1), (2, 1), (3, 1)]


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def closure(codes, bucket=None):
    lab = np.arange(len(codes))
    same = np.ones(len(codes), bool) if bucket is None else None
    while True:
        new = np.array([lab[(np.bitwise_count(codes ^ codes[i]) <= 3) & (same if bucket is None else bucket == bucket[i])].min() for i in range(len(codes))])
        if (new == lab).all():
            return lab
        lab = new


def test_simhash_against_brute_force(documents):
    rng = random.Random(1)
    base = [sentence(rng, 300) for _ in range(12)]
    rows = []
    for k, text in enumerate(base):
        for j in range(5):
            words = text.split()
            for _ in range(j):
                words[rng.randrange(len(words))] = "changed"
            rows.append((100 * k + j, " ".join(words)))
    rows += ODD + [(900, "One"), (901, "one two"), (902, "one two THREE"), (903, "one two\x0bthree")]
    got = simhash.near_duplicates(documents(rows, extra=True), bucket_rows=20).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append("%016x" % fingerprint(t))
    for r in got:
        assert r["fingerprint"] in texts[r["doc_id"]]
    codes = np.array([int(r["fingerprint"], 16) for r in got], np.uint64)
    lab = closure(codes)
    for k in set(lab.tolist()):
        members = [got[i] for i in np.flatnonzero(lab == k)]
        assert {m["component_id"] for m in members} == {min((m["doc_id"] for m in members if m["doc_id"] is not None), default=None)}
    assert len(set(lab.tolist())) < len(rows) - 20


@pytest.mark.parametrize("seed", range(3))
def test_gray_index_finds_all_components(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 15, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (500, 3)).astype(np.uint64), axis=1)
    codes = np.unique(np.r_[centres[rng.integers(0, 15, 500)] ^ flips, rng.integers(0, 2**63, 200, dtype=np.uint64)])
    bucket = rng.integers(0, 3, len(codes))
    i, j = simhash.spanning_links(bucket, codes)
    lab = np.arange(len(codes))
    for _ in range(50):
        np.minimum.at(lab, i, lab[j])
        np.minimum.at(lab, j, lab[i])
    want = closure(codes, bucket)
    assert len(set(zip(lab.tolist(), want.tolist()))) == len(set(want.tolist())) == len(set(lab.tolist()))
    assert len(i) == len(codes) - len(set(want.tolist()))


def test_tree_prunes_what_pairs_would_compare():
    codes = np.unique(np.random.default_rng(8).integers(0, 2**64, 40_000, dtype=np.uint64))
    seen = {}
    simhash.spanning_links(np.zeros(len(codes), np.int64), codes, seen=seen)
    pairs = len(codes) * (len(codes) - 1) // 2
    assert seen["fingerprints"] < pairs / 1000 and seen["nodes"] < pairs / 25 and seen["pruned"] > seen["nodes"] / 2


def test_divisions_lose_no_pair():
    rng, levels = random.Random(9), simhash.divisions()
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), 3))
        masks = [0]
        for level in levels:
            masks = [m for old in masks for m in level[old] if not (a ^ b) & m]
            assert masks


def test_gray_rank_sorts_the_gray_code():
    codes = np.arange(64, dtype=np.uint64)
    gray = codes ^ (codes >> np.uint64(1))
    assert np.array_equal(simhash.gray_rank(gray), codes)


def test_large_buckets_are_split_without_losing_links(spark):
    rng = np.random.default_rng(4)
    codes = np.unique(np.uint64(99) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, 2)).astype(np.uint64), axis=1)).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in codes], "fp long")
    whole, split = simhash.components(simhash.bucket_links(df)), simhash.components(simhash.bucket_links(df, bucket_rows=30))
    deep = simhash.components(simhash.bucket_links(df, bucket_rows=3))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect())) == sorted(map(tuple, deep.collect()))
    assert whole.select("root").distinct().count() == 1 and whole.count() == len(codes) - 1


def test_long_chain_of_links(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    got = simhash.components(chain).collect()
    assert len(got) == 200 and {r["root"] for r in got} == {0}


def test_near_duplicates_stage_keeps_one(documents):
    text = sentence(random.Random(2), 400)
    rows = [(5, text), (3, text + " end"), (9, "other words here"), (9, None)]
    kept = simhash.drop_near_duplicates(documents(rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 in ids and 5 not in ids and ids.count(9) == 1


def test_near_duplicates_stage_tells_rows_apart(documents):
    rng = random.Random(4)
    a, b, c, d = (sentence(rng, 400) for _ in range(4))
    rows = [(0, a), (1, a + " end"), (1, b), (None, a + " last"), (None, c), (None, c + " end"), (None, d), (None, d), (7, "")]
    kept = simhash.drop_near_duplicates(documents(rows).withColumn("_hash", F.lit("clash")))
    assert kept.columns[-1] == "_hash"
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in kept.collect())
    fp = {t: f for t, f in ((r["text"], r["fp"]) for r in simhash.fingerprints(documents([(i, x[1]) for i, x in enumerate(rows)])).join(
        documents([(i, x[1]) for i, x in enumerate(rows)]).select("doc_id", "text"), "doc_id").collect())}
    assert bin((fp[c] ^ fp[c + " end"]) & (2**64 - 1)).count("1") <= 3  # the fixture's own premise
    assert len(got) == 5 and {t for i, t in got if i == -1} in ({c, d}, {c + " end", d})
    assert [(i, t) for i, t in got if i >= 0] == sorted([(0, a), (1, b), (7, "")])


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def expected(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for s in range(max(1, len(v) - 9) if v else 0):
            win = v[s : s + 10]
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_against_brute_force(spark, documents):
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.choice([4, 9, 10, 11, 30]))) for i in range(12)]
    items += [(50, items[4][1]), (51, "the the the the the the the the the the the the"), (52, "Short ITEM"), (53, ""), (54, None), (None, "null id item"), (10, items[0][1])]
    rows = list(ODD)
    for i in range(20, 80):
        parts = [sentence(rng, rng.randrange(20))]
        for _ in range(rng.randrange(3)):
            v = words(rng.choice(items)[1])
            if v:
                a = rng.randrange(len(v))
                parts += [" ".join(v[a : a + rng.randrange(1, 25)]).upper(), sentence(rng, rng.randrange(4))]
        rows.append((i, ", ".join(parts)))
    rows += [(90, "the " * 25), (91, "x short item y"), (92, "Éa null id item"), (20, rows[-1][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(documents(rows, extra=True), table).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, set()).add(expected(t, items))
    for r in got:
        assert tuple(r)[1:6] in want[r["doc_id"]]
    assert 5 < sum(r["contaminated"] for r in got) < len(got)
    clean = drop_contaminated(documents(rows), table)
    assert clean.count() == sum(not expected(t, items)[4] for _, t in rows)


def test_proximity_matches(spark, documents):
    v = [f"word{i}" for i in range(12)]
    shuffled = [*v[:5][::-1], v[5], *v[6:][::-1]]
    table = spark.createDataFrame([(1, " ".join(v))], "item_id long, text string")
    got = matches(documents([(1, " ".join(shuffled)), (2, "far away")]), table).collect()
    assert got and not any(r["exact"] for r in got) and {r["doc_id"] for r in got} == {1}
    changed = [*v[:4], "another", *v[5:]]  # no window is whole, and the word that was there is in no document
    docs = documents([(1, " ".join(changed)), (2, "far away"), (3, " ".join(w for w in v if w != "word4") + " " + " ".join(v[:4])), (4, None)])
    rows = {r["doc_id"]: (r["n_hit"], r["n_items"], r["n_near"]) for r in contamination(docs, table).collect()}
    assert rows == {1: (0, 0, 1), 2: (0, 0, 0), 3: (0, 0, 1), 4: (0, 0, 0)}


def test_many_terms_are_shuffled_without_loss(spark, documents, monkeypatch):
    from orthoflow.llm import decontamination

    rng = random.Random(9)
    items = spark.createDataFrame([(i, sentence(rng, rng.choice([5, 12, 40]))) for i in range(8)], "item_id long, text string")
    parts = [r["text"] for r in items.collect()]
    docs = documents([(i, f"{sentence(rng, 5)} {parts[i % 8] if i % 3 else ''} {sentence(rng, 9)}") for i in range(40)] + [(None, parts[0]), (1, None)])
    key = lambda df: sorted(map(repr, df.collect()))
    want = key(contamination(docs, items))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert key(contamination(docs, items)) == want and any("contaminated=True" in r for r in want)


def test_empty_tables(spark, documents):
    none = documents([])
    empty_items = spark.createDataFrame([], "item_id long, text string")
    for df in (
        exact_duplicates(none), simhash.near_duplicates(none), contamination(none, empty_items), sharding.digest(sharding.shuffled(none, 4)),
        drop_duplicates(none), simhash.drop_near_duplicates(none), drop_contaminated(none, empty_items), packing.pack(none, queries.word_tokenizer()),
    ):
        assert df.count() == 0
    assert contamination(documents(ODD), empty_items).where("contaminated").count() == 0


def test_shuffle_is_a_balanced_permutation(documents):
    rows = [(i, "z" * (i % 50)) for i in range(20, 500)] + ODD
    out = sharding.shuffled(documents(rows, extra=True), 7, bucket_bytes=4000)
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted((str(i), t or "") for i, t in rows)
    shards = {}
    for r in got:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(shards) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    again = sharding.shuffled(documents(rows).repartition(5), 7, bucket_bytes=4000)
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["shard"], r["slot"])
    assert sorted(map(key, again.where("doc_id >= 9").collect())) == sorted(key(r) for r in got if r["doc_id"] is not None and r["doc_id"] >= 9)
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["slot"], r["shard"])) if r["doc_id"] is not None]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.2
    d = {r["doc_id"]: r for r in sharding.digest(out).collect()}
    assert d[1]["size"] == 8 and d[8]["size"] == 8 + len("é ü 日本 😀".encode()) and d[8]["text_crc32"] == zlib.crc32("é ü 日本 😀".encode())


def spark_hash(*values):
    """xxhash64() of Spark over longs, ints as (int,) and texts; None leaves the seed."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode()
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (seed >> 63 << 64)


def test_shuffle_is_the_permutation_that_plain_python_makes(documents):
    rows = [(i * 7, "z" * (i % 50)) for i in range(400)] + ODD + [(5, "again")] * 30
    got = sharding.shuffled(documents(rows), 7, bucket_bytes=2000, tasks=3, copies=10).collect()
    total = sum(len((t or "").encode()) + 8 for _, t in rows)
    buckets, held, again = -(-total // 2000), {}, 0
    for i, t in rows:
        key = [(sharding.SEED,), i, spark_hash(t)]
        if t == "again":
            key, again = [*key, again], again + 1
        held.setdefault(spark_hash(*key) % buckets, []).append((i, t))
    want, first = [], lambda x: (x[0] is not None, x[0] or 0, spark_hash(x[1]))
    for b in sorted(held):
        members = sorted(held[b], key=first)
        want += [members[k] for k in sharding.fisher_yates(len(members), sharding.SEED * 1_000_003 + b)]
    place = {(r["slot"] * 7 + r["shard"]): (r["doc_id"], r["text"]) for r in got}
    assert [place[k] for k in range(len(rows))] == want


def test_one_repeated_row_spreads_over_the_buckets(documents, spark):
    rows = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit("the same text again").alias("text"), F.lit(None).alias("lang"))
    many = rows.unionByName(rows.limit(20_000).withColumn("doc_id", F.lit(None).cast("int")))
    sizes = [r["count"] for r in sharding.shuffled(many, 24, bucket_bytes=300_000).groupBy("bucket").count().collect()]
    assert sum(sizes) == 120_000 and len(sizes) == 11 and max(sizes) < 1.1 * sum(sizes) / len(sizes)


def test_fisher_yates_is_uniform():
    seen = np.zeros((5, 5))
    for seed in range(3000):
        for place, record in enumerate(sharding.fisher_yates(5, seed)):
            seen[place, record] += 1
    assert abs(seen / 3000 - 0.2).max() < 0.04 and len(sharding.fisher_yates(0, 1)) == 0


def test_written_shards(spark, documents, tmp_path):
    sharding.write_shards(documents([(i, f"t{i}") for i in range(40)]), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {k: 10 for k in range(4)}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


TEXTS = [
    "It's THE don't 'll 's '", "a_b__c 12,5 $$% 100", "Ünï ÇÉ ² ½ ª º µ x", "日本語 text é", "a\x1cb \xa0c d", "<|endoftext|> x", "İstanbul ﬁ ÿ ß", "", "  ",
    "tab\tnew\nline\r\n", "À́ combining é", "x" * 5000,
]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    from tokenizers import Tokenizer

    t, ids = Tokenizer.from_file(tokenizer), packing.Ids(tokenizer)
    rng = random.Random(5)
    letters = "abcXYZéÉßñ'.,!-_0123 \n\"#"
    for text in TEXTS + ["".join(rng.choice(letters) for _ in range(200)) for _ in range(60)]:
        assert ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("together", [1, 300, packing.TOGETHER])
def test_ids_of_many_texts_are_those_of_each(tokenizer, together, monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", together)
    ids, rng = packing.Ids(tokenizer), random.Random(8)
    letters = "abcXYZéÉßñ'.,!-_0123  \n\t\r\"#\u3000\x0b\xa0\x85"
    texts = TEXTS + ["", " ", "\n a", "<|endoftext|> x"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(80)]
    texts += ["".join(rng.choice(letters[:20]) for _ in range(rng.randrange(200))) for _ in range(80)]
    assert list(ids.many(texts)) == [ids(t) for t in texts]
    assert list(ids.many([])) == [] and list(packing.Ids(tokenizer, words=False).many(texts[:9])) == [ids(t) for t in texts[:9]]


def test_packing_holds_every_id_once(documents, tokenizer):
    rng = random.Random(6)
    rows = [(i, sentence(rng, rng.randrange(1, 120))) for i in range(200)] + [(i, t) for i, t in ODD if i != 7] + [(7, sentence(rng, 4000))]
    got = packing.pack(documents(rows, extra=True), tokenizer, keep_ids=True).collect()
    ids = packing.Ids(tokenizer)
    want = sorted((str(i), ids(t or "") + b"\0\0\0\0") for i, t in rows)
    docs, bins = {}, {}
    for r in got:
        assert r["length"] == len(r["ids"]) <= 2048 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(str(r["doc_id"]), []).append((r["piece"], r["start"], r["ids"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    once = {i for i, p in docs.items() if len({x[0] for x in p}) == len(p)}
    flat = sorted((i, np.array(sum((x[2] for x in sorted(docs[i])), []), "<u4").tobytes()) for i in once)
    assert flat == [w for w in want if w[0] in once] and len(flat) > 180
    total = sum(r["length"] for r in got)
    assert total == sum(len(b) // 4 for _, b in want)
    assert len(bins) <= -(-total // 2048) + 4 * 2


def best_fit(lengths, capacity, limit):
    """(bin, offset) of each piece, by a list of the open bins' free spaces; the bin that was left last wins ties."""
    left, out, bins = [], [], 0
    for n in lengths:
        fits = [x for x in left if x[0] >= n]
        if fits:
            least = min(f for f, _ in fits)
            free, b = next(x for x in reversed(left) if x[0] == least)
            left.remove((free, b))
        else:
            if len(left) == limit and n < capacity:
                full = min(f for f, _ in left)
                left.remove(next(x for x in reversed(left) if x[0] == full))
            free, b, bins = capacity, bins, bins + 1
        out.append((b, capacity - free))
        if free > n:
            left.append((free - n, b))
    return out


def test_open_bins_are_bounded_and_best_fitting():
    rng = random.Random(7)
    lengths = [rng.choice([100, rng.randrange(1, 101)]) for _ in range(3000)]
    bins, got = packing.Bins(100, 5), []
    for n in lengths:
        got.append(bins.place(n))
        assert bins.open <= 5 and bins.open == sum(map(len, bins.free))
    assert got == best_fit(lengths, 100, 5)


def test_a_full_piece_closes_no_bin():
    bins = packing.Bins(2048, 1)
    bins.place(1000)
    assert bins.place(2048) == (1, 0) and bins.open == 1 and bins.place(1048) == (0, 1000)


def test_packing_is_what_plain_python_makes(documents, tokenizer):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.choice([0, 3, 40, 300, 2500]))) for i in range(150)] + [(7, None), (7, ""), (None, "a b")]
    docs = documents(rows).coalesce(1)
    got = packing.pack(docs, tokenizer, capacity=512, open_bins=4).collect()
    ids, pieces = packing.Ids(tokenizer), []
    for i, t in (tuple(r) for r in docs.select("doc_id", "text").collect()):
        data = ids(t or "") + b"\0\0\0\0"
        for piece, start in enumerate(range(0, len(data) // 4, 512)):
            own = data[4 * start : 4 * (start + 512)]
            pieces.append((i, piece, start, len(own) // 4, zlib.crc32(own)))
    pieces.sort(key=lambda p: -p[3])
    want = [(*p, *at) for p, at in zip(pieces, best_fit([p[3] for p in pieces], 512, 4))]
    assert list(map(tuple, got)) == want


@pytest.mark.parametrize("drop", [drop_duplicates, simhash.drop_near_duplicates])
def test_ties_do_not_depend_on_the_partitioning(documents, drop):
    rows = [(1, "a b", "en", "s2", 3), (1, "a b", "en", "s1", 9), (1, "a b", None, "s1", 4), (2, "c d e", "fr", "s", 1), (None, "x", "b", "s", 1), (None, "x", "a", "s", 1)]
    rows += [(1, "a  b", "en", "s0", 3), (1, "a\tb", "en", "s0", 3)] * (drop is drop_duplicates)
    found = set()
    for parts in (1, 2, 3, 7):
        docs = documents(rows[::-1] if parts % 2 else rows, extra=True).repartition(parts)
        found.add(tuple(sorted(map(str, drop(docs).collect()))))
    assert len(found) == 1
    kept = {r for r in drop(documents(rows)).collect() if r["doc_id"] == 1}
    assert {(r["text"], r["lang"]) for r in kept} == {("a\tb", "en") if drop is drop_duplicates else ("a b", None)}


def test_scratch_tables_belong_to_their_block(spark):
    with scratch.Tables(spark) as outer:
        one = scratch.stored(spark.range(5), "five")
        with scratch.Tables(spark) as inner:
            assert scratch.stored(one, "five").count() == 5
        assert not inner.release() and one.count() == 5
    assert not outer.release()
    assert scratch.stored(spark.range(5), "five").count() == 5


def test_samples_are_sound_at_any_size(spark, documents):
    ids = spark.range(200_000_000)
    assert 10 < ids.where(scratch.hashed_below(scratch.train_fraction(10**11, 20_000), "id")).count() < 90
    nameless = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert 4_500 < nameless.where(scratch.hashed_below(0.25, "doc_id", "text")).count() < 5_500
    assert nameless.where(scratch.hashed_below(1.0, "doc_id", "text")).count() == 20_000
    # one id with many texts, and one row many times
    hot = documents([(1, f"t{i}") for i in range(900)] + [(2, "same")] * 500 + [(i, "x") for i in range(3, 100)])
    own = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, label int")
    found = scratch.labelled_sample(hot.select("doc_id", "text"), own, 100)
    assert 60 < found.count() < 140 and found.where("doc_id = 2").count() <= 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        conf, master = spark.conf, "spark://host:7077"
        sparkContext = property(lambda self: self)
        getConf = lambda self: {}

    monkeypatch.setattr(Cluster, "conf", type("Conf", (), {"get": staticmethod(lambda *a: None)}))
    with pytest.raises(RuntimeError):
        scratch.shared_dir(Cluster())
