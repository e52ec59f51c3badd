"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints within three bits agree on at least one of any four groups of bits.
So each distinct fingerprint goes to four buckets, by half of each 16-bit block;
a bucket with too many for one task is divided by the whole block, then by each
quarter of the bits that are left, and so on, so that copies are made only where
rows are counted to be many. A bucket is sorted by Gray rank and cut into runs of
FANOUT; each run becomes a node that holds the bits its members share, runs of
nodes become a node above, and so on. Pairs of nodes are followed downwards from
the roots, and a pair is pruned as soon as the bits that the two nodes fix differ
in over three places. A bucket returns a spanning forest of its links, never all
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoflow.llm.scratch import attach, least_of_ties, stored

BITS = 64
BLOCKS = 4
DISTANCE = 3
FANOUT = 2
#: A bucket of more fingerprints is divided by more bits; so many keys of such buckets are broadcast, more are shuffled.
BUCKET_ROWS, BROADCAST_ROWS = 100_000, 100_000


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    of_byte = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)

    def one(text: bytes | None) -> int:
        w = (text or b"").lower().split()
        if not w:
            return 0
        if len(w) < 4:
            shingles = [b" ".join(w)]
        else:
            line, ends, at = b" ".join(w), [], 0
            for x in w:
                at += len(x) + 1
                ends.append(at)
            shingles = [line[a : b - 1] for a, b in zip([0, *ends], ends[2:])]
        h = np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))
        each = h.view(np.uint8).reshape(-1, 8)
        if len(h) < 64:
            counts = np.unpackbits(each, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            counts = np.concatenate([np.bincount(each[:, k], minlength=256) @ of_byte for k in range(8)])
        return int((weights * (2 * counts > len(h))).sum(dtype=np.uint64))

    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        fp = np.fromiter(map(one, texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], ["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, its fingerprint fp as a signed long, and text_hash; null and wordless texts have fp zero."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long, text_hash long")


def gray_rank(codes):
    """Place of each 64-bit code in Gray order (NumPy uint64)."""
    import numpy as np

    for k in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(k))
    return codes


def spanning_links(bucket, codes, distance: int = DISTANCE, fanout: int = FANOUT, seen: dict | None = None):
    """Links within buckets: arrays i, root of rows of one connected group, i != root.

    bucket: int64 labels; codes: uint64, distinct within a bucket. Rows need no
    order. seen, if given, gets the numbers of pairs of nodes and of fingerprints
    that were looked at, and of pairs of nodes that were pruned.
    """
    import numpy as np

    n = len(codes)
    order = np.lexsort((gray_rank(codes), bucket))
    codes, bucket = codes[order], bucket[order]
    parent = np.arange(n)
    # levels[0]: the codes; above, nodes with the bits set in all (ones) or in any (some) of their members
    ones, some, label = [codes], [codes], bucket
    starts, sizes = [], []
    while True:
        new = np.r_[True, label[1:] != label[:-1]] if len(label) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        if len(first) == len(label) and starts:
            break
        place = np.arange(len(label)) - np.repeat(first, np.diff(np.r_[first, len(label)]))
        begin = np.flatnonzero(place % fanout == 0)
        if not len(begin):
            break
        ones.append(np.bitwise_and.reduceat(ones[-1], begin))
        some.append(np.bitwise_or.reduceat(some[-1], begin))
        starts.append(begin)
        sizes.append(np.diff(np.r_[begin, len(label)]))
        label = label[begin]

    def union(i, j) -> None:
        nonlocal parent
        while (live := parent[i] != parent[j]).any():
            i, j = i[live], j[live]
            x, y = parent[i], parent[j]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := parent[parent], parent):
                parent = up

    def close(level, a, b):
        differ = (ones[level][a] & ~some[level][b]) | (ones[level][b] & ~some[level][a])
        return np.bitwise_count(differ) <= distance

    def count(what: str, n: int) -> None:
        if seen is not None:
            seen[what] = seen.get(what, 0) + int(n)

    top = len(starts)
    roots = np.arange(len(ones[top]))
    piece = 2_000_000 // fanout**2  # pairs of nodes that are opened at once
    work = [(top, roots, roots)]
    while work:
        level, a, b = work.pop()
        count("fingerprints" if level == 0 else "nodes", len(a))
        if level == 0:
            near = (a < b) & close(0, a, b)
            union(a[near], b[near])
            continue
        keep = close(level, a, b)
        count("pruned", len(keep) - keep.sum())
        a, b = a[keep], b[keep]
        if level == 1 and len(a):  # groups that are one component already need no more links
            low, high = np.minimum.reduceat(parent, starts[0]), np.maximum.reduceat(parent, starts[0])
            known = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
            a, b = a[~known], b[~known]
        if len(a) > piece:
            work += [(level, a[k : k + piece], b[k : k + piece]) for k in range(0, len(a), piece)]
        elif len(a):
            begin, size = starts[level - 1], sizes[level - 1]
            pairs = size[a] * size[b]
            k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            width = np.repeat(size[b], pairs)
            c, d = np.repeat(begin[a], pairs) + k // width, np.repeat(begin[b], pairs) + k % width
            once = c <= d
            work.append((level - 1, c[once], d[once]))
    i = np.flatnonzero(parent != np.arange(n))
    return order[i], order[parent[i]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp), a bucket's rows together; returns links a, b."""
    import numpy as np

    def links(bucket, fp):
        i, j = spanning_links(bucket, fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], ["a", "b"])

    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        held = tuple(np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held))
        if len(held[0]) > BUCKET_ROWS:  # all but the last bucket is complete
            cut = np.searchsorted(held[0] == held[0][-1], True)
            if cut:
                yield links(held[0][:cut], held[1][:cut])
                held = tuple(h[cut:] for h in held)
    if len(held[0]):
        yield links(*held)


def _parts(places: list[int]) -> list[list[int]]:
    """Four groups of bit places, as equal as can be."""
    n, more = divmod(len(places), BLOCKS)
    cuts = [k * n + min(k, more) for k in range(BLOCKS + 1)]
    return [places[a:b] for a, b in zip(cuts, cuts[1:])]


def _mask(places: list[int]) -> int:
    """The bits of places as a signed long."""
    bits = sum(1 << k for k in places)
    return bits - (1 << BITS if bits >> (BITS - 1) else 0)


def divisions() -> list[dict[int, list[int]]]:
    """By level, the masks that divide a bucket of each mask of the level before; 0 stands for all codes.

    Two codes within DISTANCE that share the bits of a mask share those of one of
    its divisions: of the bits beyond, one group of four has no difference. The
    first level takes half of each block's bits, the second one all of them.
    """
    blocks = _parts(list(range(BITS)))
    out = [{0: [_mask(b[: len(b) // 2]) for b in blocks]}, {_mask(b[: len(b) // 2]): [_mask(b)] for b in blocks}]
    held = blocks
    while min(BITS - len(h) for h in held) > 16:  # what is left are fewer codes than a task takes
        level, following = {}, []
        for h in held:
            new = [h + part for part in _parts([k for k in range(BITS) if k not in h])]
            level.setdefault(_mask(h), []).extend(_mask(x) for x in new)
            following += new
        out.append({mask: sorted(set(x)) for mask, x in level.items()})
        held = [list(x) for x in {tuple(sorted(x)) for x in following}]
    return out


def _divided(rows: DataFrame, level: dict[int, list[int]]) -> DataFrame:
    """A row of fp, mask and key for each division of the mask of each row."""
    masks = F.lit(None).cast("array<long>")
    for mask, new in level.items():
        masks = F.when(F.col("mask") == mask, F.array(*[F.lit(x).cast("long") for x in new])).otherwise(masks)
    rows = rows.select("fp", F.explode(masks).alias("mask"))
    return rows.select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))


def bucket_links(codes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links a, b that span every group of codes (distinct, column fp) within DISTANCE.

    codes must be stored. Buckets of one key that a hash brings together are
    compared as one, which finds no less.
    """
    found = None
    keyed = codes.select("fp", F.lit(0).cast("long").alias("mask"))
    for k, level in enumerate(divisions()):
        keyed = _divided(keyed, level)
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
        large = stored(sizes, "large-buckets")
        if large.isEmpty() or k == len(divisions()) - 1:
            found = keyed if found is None else found.unionByName(keyed)
            break
        keys = large.select("key")
        rest = keyed.join(F.broadcast(keys) if large.count() <= BROADCAST_ROWS else keys, "key", "left_anti")
        found = rest if found is None else found.unionByName(rest)
        keyed = stored(attach(keyed, large, "key", "n").select("fp", "mask"), "divided-buckets")
    return (
        found.select(F.col("key").alias("bucket"), "fp")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_links, "a long, b long")
    )


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Node and root of each node that is not its component's smallest: node, root.

    Alternates large-star and small-star steps until the edges stop to change;
    fails if they still change after so many rounds, of which a chain of 2^n links
    takes about n.
    """
    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges"
    )
    seen = mark(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "large-star")
        large = stored(
            attach(both, least, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges"
        )
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "small-star")
        small = attach(large, least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, seen = seen, mark(edges)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_components(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text_hash, fp, root and component_id of each row; rows of one component, and no others, share a root."""
    prints = stored(fingerprints(docs), "fingerprints")
    codes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "codes")
    roots = components(bucket_links(codes.select("fp"), bucket_rows))
    rooted = codes.join(roots, codes["fp"] == roots["node"], "left").select(
        "fp", "least_id", "n", F.coalesce("root", "fp").alias("root")
    )
    rooted = stored(rooted, "rooted")
    ids = stored(
        rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("codes")), "component-ids"
    )
    by_code = stored(attach(rooted, ids, "root", "codes").select("fp", "n", "root", "component_id"), "code-components")
    return attach(prints, by_code, "fp", "n").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id.

    Documents link when their fingerprints differ in at most three bits; a
    component's id is its smallest doc_id (null only if all its ids are null).
    Null texts and texts without words have fingerprint zero and link like any
    other. Repeated rows each get a row; further columns are ignored. Very long
    texts are read whole, and an empty table gives an empty result. components()
    says when it fails.
    """
    return near_components(docs, bucket_rows).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, one for each component.

    The row of the component's smallest id stays. Rows are told apart by id and
    text, so an id that stands for several texts loses only those that go; of
    rows that share the smallest id, or have none in a component without ids,
    that of the smallest text hash stays, and of rows with one id and text the
    least by their other columns. Null texts are wordless ones and link; very long
    ones are read whole; an empty table gives an empty result.
    """
    found = stored(near_components(docs), "near-duplicates")
    head = F.col("doc_id").eqNullSafe(F.col("component_id"))
    heads = found.where(head).withColumn("nameless", F.when(F.col("doc_id").isNull(), F.col("root")))
    firsts = heads.groupBy("doc_id", "nameless").agg(F.min("text_hash").alias("first"), F.count(F.lit(1)).alias("n"))
    tied = stored(firsts.where("n > 1").select(F.col("doc_id").alias("tied_id"), F.col("nameless").alias("tied_root"), "first"), "tied-heads")
    ties = not tied.isEmpty()
    dropped = found.where(~head)
    if ties:
        own = heads["doc_id"].eqNullSafe(tied["tied_id"]) & heads["nameless"].eqNullSafe(tied["tied_root"])
        dropped = dropped.unionByName(heads.join(tied, own).where("text_hash != first").select(found.columns))
    dropped = dropped.select(F.col("doc_id").alias("_drop_id"), F.col("text_hash").alias("_drop_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(dropped["_drop_id"]) & (F.xxhash64(docs["text"]) == dropped["_drop_hash"])
    kept = docs.join(dropped, same, "left_anti")
    if not ties:
        return kept
    repeated = tied.select(F.col("tied_id").alias("_id"), F.col("first").alias("_digest")).distinct()
    return least_of_ties(kept, repeated, F.xxhash64(kept["text"]))
