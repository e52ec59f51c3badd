"""Bounded-space online best-fit packing of tokenised documents.

Each task packs its own documents in one pass. A fixed number of bins is open;
a bitset keyed by free space finds the open bin that a piece fits best with two
integer operations. When a new bin must be opened and none may, the fullest one
closes. Pieces arrive in batches of LOOKAHEAD documents, the longest first, so
that short ones fill what long ones leave. Memory is bounded by one batch, the
open bins and the word cache.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
OPEN_BINS = 1024
LOOKAHEAD = 1024
#: Parts of words whose ids are held in memory, and characters of texts whose ids are made together.
CACHED, TOGETHER = 800_000, 4 << 20
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: Texts of these characters alone can be cut into parts here; others go to the tokenizer whole.
_KNOWN = bytes([9, 10, 13, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
#: What a lower-case character is: 0 white space, 1 letter, 2 digit, 3 any other.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[[*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1
_CLASS[48:58] = 2
#: Letters that belong to an apostrophe before them.
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


def known(text: str) -> bool:
    """Whether a text has no character but those of _KNOWN, and no special token."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not raw.translate(None, _KNOWN) and b"<|" not in raw


def part_starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a part of a word starts in lower-case text that ends in three blanks, and where no white space is.

    Parts are runs of letters, single digits, runs of other characters, and an
    apostrophe that starts such a run together with the letters it takes.
    """
    kind = _CLASS[raw]
    solid = kind != 0
    starts = np.empty(len(raw), bool)
    starts[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts |= kind == 2
    starts &= solid
    quote = np.flatnonzero((raw == ord("'")) & starts)
    one, two = raw[quote + 1], raw[quote + 2]
    short = np.isin(one, np.frombuffer(_ONE, np.uint8))
    long = np.any([(one == a) & (two == b) for a, b in _TWO], axis=0)
    starts[quote[short | long] + 1] = False
    after = np.concatenate([quote[short] + 2, quote[long] + 3])
    starts[after[solid[after]]] = True
    # what is no letter starts a part there anyway
    return starts, solid


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit numbers, the same as the tokenizer's.

    words=True is for the lower-casing word-level vocabulary: there no token
    spans two parts of a word, so many texts are cut into parts at once, and each
    distinct part is tokenised once while it stays in the cache. Any other file, and
    any text with unusual characters, goes through the tokenizer as a whole.
    """

    def __init__(self, path: str, words: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = words
        letters, part = byte_letters(), self.tokenizer.model.tokenize

        class Cache(dict):
            def __init__(self, make) -> None:
                super().__init__()
                self.make = make

            def __missing__(self, key):
                if len(self) >= CACHED:
                    self.clear()
                found = self[key] = self.make(key)
                return found

        def of_part(x: bytes) -> bytes:
            text = x.decode("latin-1")
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(letters)
            return b"".join(t.id.to_bytes(4, "little") for t in part(text))

        self.parts = Cache(of_part)

    def __call__(self, text: str) -> bytes:
        return next(self.many([text]))

    def many(self, texts: Sequence[str]) -> Iterator[bytes]:
        """The ids of each text, about TOGETHER characters at a time."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            if not self.words or not known(text):
                yield from self._together(held)
                held, size = [], 0
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                yield np.asarray(ids, "<u4").tobytes()
                continue
            raw = text.lower().encode("latin-1")
            if size + len(raw) > TOGETHER:
                yield from self._together(held)
                held, size = [], 0
            if len(raw) > TOGETHER:  # cut where no part is
                cuts = [0, *(raw.find(b" ", k) for k in range(TOGETHER, len(raw), TOGETHER))]
                cuts = sorted({k for k in cuts if k >= 0}) + [len(raw)]
                yield b"".join(ids for a, b in zip(cuts, cuts[1:]) for ids in self._together([raw[a:b]]))
                continue
            held.append(raw)
            size += len(raw)
        yield from self._together(held)

    def _together(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of lower-cased texts: those of each distinct part, gathered for all its places."""
        if not texts:
            return
        raw = np.frombuffer(b" ".join(texts) + b"   ", np.uint8)
        starts, solid = part_starts(raw)
        data = raw[solid]
        offsets = np.append(np.flatnonzero(starts[solid]), len(data))
        count = len(offsets) - 1
        if not count:
            yield from [b""] * len(texts)
            return
        parts = pa.Array.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        _, bounds, blob = coded.dictionary.buffers()
        bounds, blob = np.frombuffer(bounds, np.int64, len(coded.dictionary) + 1).tolist(), blob.to_pybytes()
        table = [self.parts[blob[a:b]] for a, b in zip(bounds, bounds[1:])]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        first, place = np.cumsum(sizes) - sizes, coded.indices.to_numpy(zero_copy_only=False)
        each = sizes[place]
        ends = np.append(0, np.cumsum(each))
        at = np.repeat(first[place] - ends[:-1], each) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(table), "<u4")[at].tobytes()
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = (4 * ends[np.searchsorted(np.flatnonzero(starts), begin)]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            yield ids[a:b]


class Bins:
    """Open bins by free space; place() returns a bin's number and the place in it."""

    def __init__(self, capacity: int, limit: int, first: int = 0) -> None:
        self.capacity, self.limit, self.next = capacity, limit, first
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = 0

    def _take(self, free: int) -> int:
        found = self.free[free].pop()
        if not self.free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.limit and length < self.capacity:  # a full piece needs no place among the open bins
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, free = self.next, self.capacity
            self.next += 1
        left = free - length
        if left:
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - free


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    keep_ids: bool = False,
    words: bool = True,
) -> DataFrame:
    """One row per piece of a document: where its ids go, see SCHEMA; keep_ids adds the ids.

    tokenizer: path of a tokenizer file, there on every executor. A document is
    its ids and one 0 behind them, so null and empty texts have the length 1.
    Only documents longer than the capacity are cut, and their full pieces are
    sequences of their own. Sequences are numbered by task, so rows of a table
    that is read again the same way get the same numbers. Repeated rows are
    packed each; further columns are ignored. Very long texts are read whole and
    held one at a time; an empty table gives an empty result.
    """
    schema = SCHEMA + (", ids array<int>" if keep_ids else "")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(tokenizer, words)
        bins = Bins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, *[pa.list_(pa.int32())] * keep_ids]
        for batch in batches:
            for lo in range(0, batch.num_rows, LOOKAHEAD):
                part = batch.slice(lo, LOOKAHEAD)
                pieces = []
                texts = [text or "" for text in part.column(1).to_pylist()]
                for doc_id, data in zip(part.column(0).to_pylist(), ids_of.many(texts)):
                    data += b"\0\0\0\0"
                    n = len(data) // 4
                    for piece, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        own = data[4 * start : 4 * (start + length)]
                        ids = [memoryview(own).cast("i").tolist()] if keep_ids else []
                        pieces.append([doc_id, piece, start, length, zlib.crc32(own), *ids])
                pieces.sort(key=lambda p: -p[3])  # ties in the order of arrival
                for p in pieces:
                    p[5:5] = bins.place(p[3])
                columns = zip(*pieces) if pieces else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(packed, schema)
