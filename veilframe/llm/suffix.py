"""Suffix-array dedup: remove bytes that lie in a long match with an earlier document.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller id.

Sparse suffixes. Every ``length``-byte window contains ``GRAM``-byte grams; the smallest of their hashes
(the leftmost of equals) is the window's anchor, so equal windows have equal anchors at equal places.
A unit is a run of windows with the same anchor; it stands for all of its suffixes, about one
for 14 bytes of text. Units are known by the hash of their anchor's gram and of their whole content.

Index family. Documents are cut into batches by ascending id, and the keys of a batch's units into
buckets. A bucket holds a family of levels, each a sorted array. A batch brings a sorted array, is
merge-scanned against the levels for units whose content an earlier batch has, and then becomes a level
itself; as long as the two smallest levels are about equal in size, they merge.

Ends of matches. A unit that is nowhere else as a whole may still share some windows. That takes another
unit with the same anchor gram but other content, so each batch also says which grams it has, with one content or with
several. Units of grams that have several contents in all, few in number, go through a second family of the same kind with
the hashes of all their windows, which decides every window exactly.

Steps: order by id and pack into blocks (a table in the shared folder); unit keys to buckets, verdicts back
to blocks; window keys of the undecided units to buckets, verdicts back; take out what was found. Rows that move
are packed arrays of one block and bucket.

Scale: work and shuffle grow with the text; the number of buckets grows with it, so a bucket's family
stays within a task's memory. Within a batch equal keys are one. Contents and windows are dealt by hashes of all of their bytes, grams
by their own: of a passage that many documents share, each of these has one entry a batch, and what stands before and after it in
each document is spread over all buckets. A single text is never cut apart for good: it is read in overlapping pieces.

Defined results: null and empty texts have nothing to remove; documents with a null id count as last, and
documents with equal ids (nulls too) don't count as earlier than each other; ids are keys, and the
rows of one id are read by one task; repeated rows follow from that; an empty table gives an empty result.
Whole units and windows are compared by 64-bit hashes, the contents of one gram by 48 bits of theirs. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe import runtime
from veilframe.llm import rolling

LENGTH = 50
GRAM = 24
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
#: Text bytes for which there is one bucket, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 64 << 20, 64
_LAST = (1 << 63) - 1
_POSITIONS = np.uint64((1 << 21) - 1)


def _pack(a: np.ndarray) -> bytes:
    """Compressed by planes of bytes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=np.zeros(1, a.dtype)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


class Piece:
    """Hashes over a stretch of text. Windows start at 0 .. n_windows - 1."""

    def __init__(self, data: np.ndarray, length: int, gram: int, powers: rolling.Powers):
        self.length, self.n_windows = length, max(0, len(data) - length + 1)
        if not self.n_windows:
            return
        self.sums = rolling.Sums(data, powers)
        self.gram_hashes = self.sums.stretches(np.arange(len(data) - gram + 1), gram)
        wide = length - gram + 1
        low = (self.gram_hashes & ~_POSITIONS) | np.arange(len(self.gram_hashes), dtype=np.uint64)
        span = 1
        while 2 * span <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: self.n_windows], low[wide - span : wide - span + self.n_windows])
        self.anchors = (low & _POSITIONS).astype(np.int64)

    def windows(self, starts: np.ndarray) -> np.ndarray:
        return self.sums.stretches(starts, self.length)


class Units:
    """The units of a block in the order of its text: first and last window (offsets in the block), owner, and keys: 48 bits of the gram, 64 of the content."""

    def __init__(self, block: Block):
        first, last, grams, contents = [], [], [], []
        for at, piece, windows in block.pieces():
            anchors = piece.anchors[windows]
            turn = np.flatnonzero((np.diff(anchors) != 0) | (np.diff(windows) != 1)) + 1
            a, z = windows[np.concatenate([[0], turn])], windows[np.concatenate([turn - 1, [len(windows) - 1]])]
            first.append(a + at)
            last.append(z + at)
            grams.append(rolling.mixed(piece.gram_hashes[piece.anchors[a]]))  # anchors have small hashes; keys are spread evenly
            contents.append(piece.sums.stretches(a, z - a + piece.length))
        cat = lambda parts, kind: np.concatenate(parts).astype(kind, copy=False) if parts else np.empty(0, kind)
        self.first, self.last = cat(first, np.int64), cat(last, np.int64)
        self.owner = np.searchsorted(block.ends, self.first, side="right")
        self.grams, self.contents = cat(grams, np.uint64) >> np.uint64(16), cat(contents, np.uint64)


class Block:
    """Whole documents by ascending id, packed into one row."""

    def __init__(self, ids: list[int], sizes: list[int], data: bytes, length: int, gram: int, powers: rolling.Powers):
        self.ids, self.data = np.array(ids, np.int64), np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(np.array(sizes, np.int64))
        self.starts = self.ends - np.array(sizes, np.int64)
        self.length, self.gram, self.powers = length, gram, powers

    def pieces(self) -> Iterator[tuple[int, Piece, np.ndarray]]:
        """Offset and hashes of each stretch of text, and its windows that lie within one document.

        Stretches overlap by length - 1, so that every window is in one of them.
        """
        for at in range(0, len(self.data) - self.length + 1, PIECE_BYTES):
            piece = Piece(self.data[at : at + PIECE_BYTES + self.length - 1], self.length, self.gram, self.powers)
            places = np.arange(at, at + piece.n_windows)
            inside = np.flatnonzero(places + self.length <= self.ends[np.searchsorted(self.ends, places, side="right")])
            if len(inside):
                yield at, piece, inside


class Family:
    """Levels of sorted distinct keys; equal-sized levels merge, so there are few of them."""

    def __init__(self):
        self.levels: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.last = None

    def known(self, keys: np.ndarray) -> np.ndarray:
        """Merge-scan: which of the sorted ``keys`` a level has."""
        found = np.zeros(len(keys), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            found |= level[at] == keys
        return found

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.levels.append(keys)
            while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
                both = np.concatenate([self.levels.pop(), self.levels.pop()])
                both.sort(kind="stable")  # two sorted runs: one merge
                self.levels.append(both[np.concatenate([[True], both[1:] != both[:-1]])])

    def scan(self, keys: np.ndarray, first: int, last: int) -> np.ndarray:
        """Which keys of a batch of ids first .. last an earlier id has; batches come by ascending ids."""
        if self.last is not None and first > self.last:
            for held in self.waiting:
                self.add(held)
            self.waiting = []
        self.last = last
        found = self.known(keys)
        self.waiting.append(keys)  # batches of one id don't count for each other
        return found


def _joint(grams: np.ndarray, contents: np.ndarray) -> np.ndarray:
    return rolling.mixed(rolling.mixed(grams) + contents)


def _dealt(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Bucket of keys of so many bits: ranges, so that sorted keys are sorted by bucket. For up to 2^32 buckets."""
    return (((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _bounds(dealt: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.concatenate([[0], np.flatnonzero(np.diff(dealt)) + 1, [len(dealt)]]).tolist() if len(dealt) else [0]
    for a, z in itertools.pairwise(edges):
        yield int(dealt[a]), a, z


# Steps

_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("nulls", pa.list_(pa.bool_())), ("data", pa.binary())])
_BLOCK_SQL = "block long, ids array<long>, sizes array<long>, nulls array<boolean>, data binary"


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted documents. A block ends between ids, unless it holds one id only, as do then those that go on with it."""
    ids, texts, size, made, closed = [], [], 0, 0, None

    def block(n: int) -> pa.RecordBatch:
        nonlocal ids, texts, size, made, closed
        number = (TaskContext.get().partitionId() << 32) + made
        out = {"block": [number], "ids": [ids[:n]], "sizes": [[len(t) for t in texts[:n]]], "nulls": [[i == _LAST for i in ids[:n]]]}
        out["data"] = [zstandard.ZstdCompressor(level=3).compress(b"".join(texts[:n]))]
        closed, ids, texts, made = ids[n - 1], ids[n:], texts[n:], made + 1
        size = sum(map(len, texts))
        return pa.RecordBatch.from_pydict(out, _BLOCK)

    for b in batches:
        for i, t in zip(b["id"].to_pylist(), b["text"], strict=True):
            if size >= BLOCK_BYTES and (i != ids[-1] or ids[0] == i):
                yield block(len(ids))
            elif ids and ids[0] == closed and i != closed:
                yield block(len(ids))
            elif size >= 2 * BLOCK_BYTES:
                yield block(ids.index(i))  # one id goes on and on: what came before it is a block of its own
            ids.append(i)
            texts.append((t.as_py() or "").encode())
            size += len(texts[-1])
    if ids:
        yield block(len(ids))


def _read(row: dict, length: int, gram: int, powers: rolling.Powers) -> Block:
    data = zstandard.ZstdDecompressor().decompress(row["data"]) if row["data"] else b""
    return Block(row["ids"], row["sizes"], data, length, gram, powers)


_KEYS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("grams", pa.binary()), ("contents", pa.binary())])
_KEYS_SQL = "bucket long, block long, first long, last long, grams binary, contents binary"


def _entries(units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (gram, content) of a block in order, and the entry of each unit."""
    order = np.argsort(units.grams, kind="stable")
    g = units.grams[order]
    same = np.concatenate([[False], g[1:] == g[:-1], [False]])
    shared = np.flatnonzero(same[:-1] | same[1:])  # where a gram has more than one unit
    within = order[shared]
    order[shared] = within[np.lexsort((units.contents[within], units.grams[within]))]
    c = units.contents[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    entry = np.empty(len(g), np.int64)
    entry[order] = np.cumsum(new) - 1
    return g[new], c[new], entry


def _first_of_grams(g: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)


def _tags(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each distinct gram of a block 48 bits of its content, or 0 if it has several."""
    at = np.flatnonzero(_first_of_grams(g))
    alone = np.diff(np.append(at, len(g))) == 1
    return np.where(alone, np.maximum(c[at] >> np.uint64(16), np.uint64(1)), np.uint64(0))


def _unit_keys(length: int, gram: int, buckets: int):
    """Of each block, its distinct units by content in the first ``buckets`` buckets, and its distinct grams in as many more."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = rolling.Powers()
        for b in batches:
            for row in b.to_pylist():
                block = _read(row, length, gram, powers)
                g, c, _ = _entries(Units(block))
                joint, grams, tags = np.sort(_joint(g, c)), g[_first_of_grams(g)], _tags(g, c)
                own = {"block": row["block"], "first": int(block.ids[0]), "last": int(block.ids[-1])}
                out = [own | {"bucket": k, "grams": _pack_sorted(joint[a:z])} for k, a, z in _bounds(_dealt(joint, 64, buckets))]
                out += [own | {"bucket": buckets + k, "grams": _pack_sorted(grams[a:z]), "contents": _pack(tags[a:z])} for k, a, z in _bounds(_dealt(grams, 48, buckets))]
                if out:
                    yield pa.RecordBatch.from_pylist(out, _KEYS)

    return keys


_VERDICT = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
_VERDICT_SQL = "block long, bucket long, bits binary"


def _several(grams: list[np.ndarray], tags: list[np.ndarray]) -> np.ndarray:
    """The sorted grams of a bucket with more than one content."""
    g, x = np.concatenate(grams), np.concatenate(tags)
    order = np.argsort(g, kind="stable")
    g, x = g[order], x[order]
    return np.unique(np.concatenate([g[1:][(g[1:] == g[:-1]) & (x[1:] != x[:-1])], g[x == 0]]))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    rows = (row for b in batches for row in b.to_pylist())
    return itertools.groupby(rows, key=lambda r: r["bucket"])


def _unit_verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit for each key of a block: an earlier id has the content; the gram has several contents."""
    for bucket, rows in _by_bucket(batches):
        family, held = Family(), []
        for row in rows:
            keys = _unpack_sorted(row["grams"])
            if row["contents"] is None:
                earlier = family.scan(keys, row["first"], row["last"])
                yield pa.RecordBatch.from_pydict({"block": [row["block"]], "bucket": [bucket], "bits": [_pack(earlier.astype(np.uint8))]}, _VERDICT)
            else:
                held.append((row["block"], keys, _unpack(row["contents"], np.uint64)))
        several = _several([h[1] for h in held], [h[2] for h in held]) if held else ()
        for block, g, _ in held:
            at = np.minimum(np.searchsorted(several, g), max(len(several) - 1, 0))
            mixed = several[at] == g if len(several) else np.zeros(len(g), bool)
            yield pa.RecordBatch.from_pydict({"block": [block], "bucket": [bucket], "bits": [_pack(mixed.astype(np.uint8))]}, _VERDICT)


def _window_verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of a block's window keys in a bucket: 1 an earlier id has the window."""
    for bucket, rows in _by_bucket(batches):
        family = Family()
        for row in rows:
            earlier = family.scan(_unpack_sorted(row["grams"]), row["first"], row["last"])
            yield pa.RecordBatch.from_pydict({"block": [row["block"]], "bucket": [bucket], "bits": [_pack(earlier.astype(np.uint8))]}, _VERDICT)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """Each block's own row, and the rows about it, which are sorted before it."""
    about: list[dict] = []
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            if row["ids"] is None:
                about.append(row)
            else:
                yield row, about
                about = []


def _bits(about: list[dict], part: str) -> np.ndarray:
    found = sorted((r for r in about if r["part"] == part), key=lambda r: r["bucket"])  # range buckets: their order is that of the keys
    return np.concatenate([_unpack(r["bits"], np.uint8) for r in found]) if found else np.empty(0, np.uint8)


def _later(entry: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Which of the (entry, id), in ascending order of ids, have a smaller id with the same entry among them."""
    least = np.empty(n, np.int64)
    least[entry[::-1]] = ids[::-1]  # the first one of each stays
    return ids > least[entry]


class _Judged:
    """A block's units after the first family: spans to remove, and the windows still to decide."""

    def __init__(self, block: Block, bits: np.ndarray):
        units = Units(block)
        g, c, entry = _entries(units)
        new = _first_of_grams(g)
        if len(bits) != len(g) + int(new.sum()):
            raise RuntimeError("a block came back with other units than it had")
        earlier = np.empty(len(g), bool)
        earlier[np.argsort(_joint(g, c), kind="stable")] = bits[: len(g)]
        several = bits[len(g) :].astype(bool)[np.cumsum(new) - 1] if len(g) else np.empty(0, bool)
        owner = block.ids[units.owner]
        gone = earlier[entry] | _later(entry, owner, len(g))
        self.first, self.last = units.first[gone], units.last[gone] + block.length
        open_ = ~gone & several[entry]
        counts = (units.last - units.first + 1)[open_]
        first = units.first[open_]
        self.windows = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        owners = np.repeat(owner[open_], counts)
        keys = [np.empty(0, np.uint64)]
        for at, piece, _ in block.pieces():
            a, z = np.searchsorted(self.windows, [at, at + min(piece.n_windows, PIECE_BYTES)])
            keys.append(piece.windows(self.windows[a:z] - at))
        self.distinct, self.entry = np.unique(np.concatenate(keys), return_inverse=True)
        self.later = _later(self.entry, owners, len(self.distinct))


_FOUND = pa.schema([*_KEYS, ("spans", pa.list_(pa.binary())), ("windows", pa.list_(pa.binary()))])
_FOUND_SQL = _KEYS_SQL + ", spans array<binary>, windows array<binary>"


def _window_keys(length: int, gram: int, buckets: int):
    """Window keys of each block by bucket, and one row with what is known of the block."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = rolling.Powers()
        for row, about in _by_block(batches):
            block = _read(row, length, gram, powers)
            found = _Judged(block, _bits(about, "units"))
            out = [
                {"bucket": k, "block": row["block"], "first": int(block.ids[0]), "last": int(block.ids[-1]), "grams": _pack_sorted(found.distinct[a:z])}
                for k, a, z in _bounds(_dealt(found.distinct, 64, buckets))
            ]
            spans = [_pack(np.diff(x, prepend=0)) for x in _merged(found.first, found.last)]
            windows = [_pack(np.diff(found.windows, prepend=0)), _pack(found.entry.astype(np.int32)), _pack(found.later.astype(np.uint8))]
            out.append({"block": row["block"], "spans": spans, "windows": windows})
            for i in range(0, len(out), 16):
                yield pa.RecordBatch.from_pylist(out[i : i + 16], _FOUND)

    return keys


def _merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans by ascending starts, with those that meet made one."""
    if not len(first):
        return first, last
    reach = np.maximum.accumulate(last)
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    return first[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)]


def _removed(size: int, length: int, known: dict, bits: np.ndarray) -> np.ndarray:
    """A flag for each byte of a block."""
    first, last = (np.cumsum(_unpack(b, np.int64)) for b in known["spans"])
    windows, entry, later = (_unpack(b, kind) for b, kind in zip(known["windows"], (np.int64, np.int32, np.uint8), strict=True))
    windows = np.cumsum(windows)
    if len(bits) != (int(entry.max()) + 1 if len(entry) else 0):
        raise RuntimeError("a block came back with other windows than it had")
    gone = windows[bits[entry].astype(bool) | later.astype(bool)]
    edge = np.zeros(size + 1, np.int32)
    for a, z in ((first, last), (gone, gone + length)):
        np.add.at(edge, a, 1)
        np.add.at(edge, z, -1)
    return np.cumsum(edge[:-1]) > 0


_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_RESULT_SQL = "id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>"


def _assembler(length: int, gram: int):
    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = rolling.Powers()
        for row, about in _by_block(batches):
            block = _read(row, length, gram, powers)
            known = next(r for r in about if r["spans"] is not None)
            gone = _removed(len(block.data), length, known, _bits(about, "windows"))
            out: list[dict] = []
            for i, null, a, z in zip(row["ids"], row["nulls"], block.starts.tolist(), block.ends.tolist(), strict=True):
                own = gone[a:z]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).tolist()
                spans = [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2], strict=True)]
                out.append({"id": None if null else i, "n_bytes": z - a, "kept": block.data[a:z][~own].tobytes(), "spans": spans})
                if len(out) >= 256 or z - a >= PIECE_BYTES:
                    yield pa.RecordBatch.from_pylist(out, _RESULT)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _RESULT)

    return assemble


def _beside(blocks: DataFrame, verdicts: dict[str, DataFrame]) -> DataFrame:
    """Blocks and the verdicts about them, together and in order."""
    rows = blocks
    for part, found in verdicts.items():
        rows = rows.unionByName(found.withColumn("part", F.lit(part)), allowMissingColumns=True)
    return rows.repartition("block").sortWithinPartitions("block", F.col("ids").isNotNull(), "part", "bucket")


def remove_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key, n_bytes, kept binary (the bytes that stay), spans (start and end of each removed run): one row per document."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LAST)).alias("id"), F.col(f"`{text}`").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id")
    blocks = runtime.materialize(ordered.mapInArrow(_packer, _BLOCK_SQL), "blocks")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))

    def judged(keys: DataFrame, verdicts, name: str) -> DataFrame:
        by_bucket = keys.repartition("bucket").sortWithinPartitions("bucket", "first", "last", "block")
        return runtime.materialize(by_bucket.mapInArrow(verdicts, _VERDICT_SQL), name)

    runtime.release(spark)
    units = judged(blocks.mapInArrow(_unit_keys(length, gram, buckets), _KEYS_SQL), _unit_verdicts, "units")
    runtime.release(spark)
    found = runtime.materialize(_beside(blocks, {"units": units}).mapInArrow(_window_keys(length, gram, buckets), _FOUND_SQL), "found")
    runtime.release(spark)
    keys = found.where("bucket is not null").select("bucket", "block", "first", "last", "grams")
    windows = judged(keys, _window_verdicts, "windows")
    runtime.release(spark)
    known = found.where("bucket is null").select("block", "spans", "windows")
    made = _beside(blocks, {"windows": windows, "known": known}).mapInArrow(_assembler(length, gram), _RESULT_SQL)
    return made.withColumnRenamed("id", key)
