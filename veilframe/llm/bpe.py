"""BPE encoding and decoding with a distinct-word table.

Texts are split into words as the tokenizer splits them; each distinct word is encoded once; its ids
are joined back by position, and ids are decoded through the id-to-piece table of the vocabulary.

1. ``split`` cuts the texts once, in blocks of about ``BLOCK_CHARS`` characters with a number of their own. A block's distinct
   words are dealt into buckets by a hash and numbered there, frequent ones first; each text becomes buckets and numbers. Both are
   written as a table, so what follows depends on a block's rows only and comes out the same however often it is made.
2. The word rows (one a block and bucket) are shuffled by bucket, so all occurrences of a word meet in the part of
   the distinct-word table that its bucket holds: ``encode`` enters each word once and sends the ids back under block and bucket.
3. Ids and texts are shuffled by block and sorted; ``assemble`` reads a block's ids, looks up their pieces in the
   id-to-piece table, then joins them to the texts by bucket and number, one chunk after the other, and yields ids and decoded text.

Scale: a frequent word is one entry a block, not one row an occurrence, so no word is hot. Every row is
bounded by a block, except that a single text is never cut: it needs memory in proportion to itself. The number of buckets
grows with the texts (``buckets_for``), so that a bucket's words fit a task; beyond ``WORDS`` of them it starts a new table,
which costs time only. A number takes about 12 bits on disk, less than the text.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows are each
encoded; an empty table gives an empty result. Columns other than those named are not read.
Strings of the tokenizer's special tokens inside a text become those tokens, as its library has it.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe import runtime

BLOCK_CHARS = 16_000_000
BLOCK_TEXTS = 100_000
CHUNK_CHARS = 1_000_000
#: Characters for which there is one bucket, and the least and greatest number of buckets: with more, a block's row for a bucket
#: would hold a few words only, and with 8192 a task holds about a million words of ten thousand million.
BUCKET_CHARS, LEAST_BUCKETS, MOST_BUCKETS = 4_000_000, 64, 8192
WORDS = 4_000_000

#: Characters whose normal form, case and class don't depend on the Unicode version: Latin, punctuation, the euro sign;
#: without the few whose lower case lies elsewhere.
_RANGES = [*map(chr, range(0x300)), *map(chr, range(0x2010, 0x2027)), "\u20ac"]
_SETTLED = "".join(c for c in _RANGES if set(c.lower()) <= set(_RANGES))


def _pack(a: np.ndarray) -> bytes:
    """Compressed by planes of bytes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def _pack_words(words: list[str]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(words)).tobytes() + sizes.tobytes() + "".join(words).encode())


def _unpack_words(b: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(b)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4)).tolist()
    text = raw[4 + 4 * n :].decode()
    return [text[a:z] for a, z in zip([0, *ends], ends, strict=False)]


class _Codes(dict):
    """Word -> its number, by first appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Words:
    """How a tokenizer cuts texts into words, and what it makes of each."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True  # special strings are found before words are cut
        described = json.loads(spec)
        added = described["added_tokens"]
        steps = (described["pre_tokenizer"] or {}).get("pretokenizers", [])
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added) or described["decoder"] is not None:
            raise ValueError("only tokenizers with plain special tokens and no decoder are supported")
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["add_prefix_space"]:
            raise ValueError("only tokenizers that split by one pattern, then into bytes, are supported")
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")") if added else None
        self.split_step = self.tokenizer.pre_tokenizer[0]
        normal = [n["type"] for n in (described["normalizer"] or {}).get("normalizers", [])]
        plain = normal == ["NFC", "Replace", "Lowercase"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
        self.odd = re.compile(f"[^{re.escape(_SETTLED)}]") if plain else None
        self.pattern = self._settled(steps[0]["pattern"]["Regex"]) if plain else None

    @staticmethod
    def _settled(pattern: str) -> re.Pattern:
        """The split pattern with its classes spelled out over the settled characters, for the standard library."""
        import regex

        for name in (r"\p{L}", r"\p{N}", r"\s"):
            members = re.escape("".join(regex.findall(name, _SETTLED)))
            pattern = pattern.replace(f"[{name}]", f"[{members}]").replace(name, members)
        return re.compile(pattern)

    def _plain(self, text: str) -> list[str]:
        if self.odd is not None and not self.odd.search(text):
            return self.pattern.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [w for w, _ in self.split_step.pre_tokenize_str(normal)]

    def split(self, text: str) -> list:
        """The words of a whole text; a special token is a tuple of its string."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out: list = []
        for i, part in enumerate(self.special.split(text)):
            out += [(part,)] if i % 2 else self._plain(part)
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of words as ``mark`` writes them."""
        plain = [w[1:] for w in words if w[0] == "w"]
        found = iter(self.tokenizer.encode_batch(plain, add_special_tokens=False))
        return [next(found).ids if w[0] == "w" else [self.tokenizer.token_to_id(w[1:])] for w in words]

    def pieces(self) -> list[str]:
        """The id-to-piece table."""
        n = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        return [self.tokenizer.id_to_token(i) or "" for i in range(n)]


def mark(word) -> str:
    return "w" + word if isinstance(word, str) else "s" + word[0]


def buckets_for(chars: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS)))


class _Block:
    def __init__(self, number: int, buckets: int):
        self.number, self.buckets, self.codes, self.chunks = number, buckets, _Codes(), []
        self._new()

    def _new(self) -> None:
        self.keys, self.counts, self.parts, self.held = [], [], [], 0

    def add(self, key, words: list, chars: int) -> None:
        self.keys.append(key)
        self.counts.append(len(words))
        self.parts.append(np.fromiter(map(self.codes.__getitem__, words), np.uint32, len(words)))
        self.held += chars
        if self.held >= CHUNK_CHARS or len(self.keys) >= 4096:
            self.close()

    def close(self) -> None:
        if self.keys:
            self.chunks.append((self.keys, self.counts, np.concatenate(self.parts)))
            self._new()

    def rows(self) -> Iterator[dict]:
        """A row for each bucket of words, and for each chunk of texts, whose words are bucket and number in one."""
        self.close()
        words = [mark(w) for w in self.codes]
        bucket = np.fromiter((zlib.crc32(w.encode()) % self.buckets for w in words), np.int64, len(words))
        often = np.zeros(len(words), np.int64)
        for *_, codes in self.chunks:
            often += np.bincount(codes, minlength=len(words))
        order = np.lexsort((-often, bucket))
        starts = np.cumsum(np.bincount(bucket, minlength=self.buckets)) - np.bincount(bucket, minlength=self.buckets)
        name = np.empty(len(words), np.uint64)
        name[order] = (bucket[order] << 32 | np.arange(len(words)) - starts[bucket[order]]).astype(np.uint64)
        order = order.tolist()
        for b, group in itertools.groupby(order, key=bucket.__getitem__):
            yield {"kind": "words", "block": self.number, "bucket": int(b), "words": _pack_words([words[i] for i in group])}
        for keys, counts, codes in self.chunks:
            yield {"kind": "texts", "block": self.number, "n_words": len(words), "keys": keys, "counts": counts, "codes": _pack(name[codes])}


def _splitter(spec: str, schema: pa.Schema, buckets: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, number = Words(spec), TaskContext.get().partitionId() << 32
        block, chars, texts = _Block(number, buckets), 0, 0

        def rows() -> Iterator[pa.RecordBatch]:
            held = iter(block.rows())
            while some := list(itertools.islice(held, 16)):
                yield pa.RecordBatch.from_pylist(some, schema)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                block.add(key, cut.split(text), len(text))
                chars, texts = chars + len(text), texts + 1
                if chars >= BLOCK_CHARS or texts >= BLOCK_TEXTS:
                    yield from rows()
                    number += 1
                    block, chars, texts = _Block(number, buckets), 0, 0
        yield from rows()

    return split


def _encoder(spec: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, memo = Words(spec), {}  # the part of the distinct-word table of this task's buckets
        for b in batches:
            out = []
            for packed in b["words"]:
                words = _unpack_words(packed.as_py())
                if len(memo) > WORDS:
                    memo.clear()
                new = [w for w in words if w not in memo]
                for i in range(0, len(new), 1024):
                    memo.update(zip(new[i : i + 1024], words_of.encode(new[i : i + 1024]), strict=True))
                ids = [memo[w] for w in words]
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter((x for one in ids for x in one), np.uint32, int(sizes.sum()))
                out.append((_pack(sizes), _pack(flat)))
            yield pa.RecordBatch.from_arrays(
                [b["block"], b["bucket"], pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())],
                ["block", "bucket", "sizes", "ids"],
            )

    return encode


class _Dictionary:
    """A block's words: where the ids of each lie, and its decoded pieces."""

    def __init__(self, parts: dict[int, tuple[bytes, bytes]], pieces: list[str], buckets: int):
        sizes = {b: _unpack(parts[b][0], np.uint32).astype(np.int64) for b in sorted(parts)}
        self.first = np.zeros(buckets, np.int64)  # the place of each bucket's first word
        at = 0
        for b, n in sizes.items():
            self.first[b], at = at, at + len(n)
        none = np.empty(0, np.int64)
        self.sizes = np.concatenate([none, *sizes.values()])
        self.ids = np.concatenate([none.astype(np.int32), *(_unpack(parts[b][1], np.uint32).astype(np.int32) for b in sizes)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        ids, ends = self.ids.tolist(), np.cumsum(self.sizes).tolist()
        self.texts = [" ".join([pieces[i] for i in ids[a:z]]) for a, z in zip([0, *ends], ends, strict=False)]

    def places(self, packed: bytes) -> np.ndarray:
        """The places of a chunk's words, from bucket and number."""
        name = _unpack(packed, np.uint64)
        return self.first[(name >> np.uint64(32)).astype(np.int64)] + (name & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of words, and how many each word has."""
        sizes = self.sizes[codes]
        first = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(self.starts[codes] - first, sizes) + np.arange(int(sizes.sum()))], sizes


def _assembler(spec: str, key: pa.Field, buckets: int):
    schema = pa.schema([key, pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Words(spec).pieces()
        current, parts, dictionary = None, {}, None
        for b in batches:
            for r in range(b.num_rows):
                block, bucket, sizes, ids, n_words, keys, counts, codes = (b.column(c)[r] for c in range(8))
                if block.as_py() != current:
                    current, parts, dictionary = block.as_py(), {}, None
                if bucket.as_py() is not None:
                    parts[bucket.as_py()] = (sizes.as_py(), ids.as_py())
                    continue
                if dictionary is None:
                    dictionary, parts = _Dictionary(parts, pieces, buckets), {}
                    if len(dictionary.sizes) != n_words.as_py():
                        raise RuntimeError("a block came back with other words than it had")
                codes, counts = dictionary.places(codes.as_py()), np.array(counts.as_py(), np.int64)
                flat, sizes = dictionary.ids_of(codes)
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], np.concatenate([[0], np.cumsum(sizes)])[ends]])
                texts, plain = dictionary.texts, codes.tolist()
                decoded = [" ".join([texts[i] for i in plain[a:z]]) for a, z in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.as_py(), key.type), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(decoded)], schema=schema
                )

    return assemble


def _encoded(rows: DataFrame, spec: str) -> DataFrame:
    """The ids of each block's words, as a table; nothing refers to the shuffle of the words afterwards."""
    words = rows.select("block", "bucket", "words").repartition("bucket")
    return runtime.materialize(words.mapInArrow(_encoder(spec), "block long, bucket int, sizes binary, ids binary"), "ids")


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>, decoded string: one row per document."""
    spec, spark = Path(tokenizer).read_text(), docs.sparkSession
    kind = docs.schema[key].dataType
    arrow = spark.createDataFrame([], T.StructType([T.StructField("keys", T.ArrayType(kind)), T.StructField("key", kind)])).toArrow().schema
    columns = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text"))
    buckets = buckets_for(columns.agg(F.sum(F.length("text"))).first()[0] or 0)
    split = pa.schema([
        ("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("n_words", pa.int64()), arrow.field("keys"), ("counts", pa.list_(pa.int32())), ("codes", pa.binary()),
    ])
    split_sql = T.StructType().add("kind", "string").add("block", "long").add("bucket", "integer").add("words", "binary").add("n_words", "long").add("keys", T.ArrayType(kind)).add("counts", T.ArrayType(T.IntegerType())).add("codes", "binary")
    tables = runtime.Scratch(spark)
    rows = tables.table(columns.mapInArrow(_splitter(spec, split, buckets), split_sql), "split", by=["kind"])
    ids = _encoded(rows.where("kind = 'words'"), spec)
    tables.drop(rows, "kind=words")
    runtime.release(spark, settle=1.0)
    texts = rows.where("kind = 'texts'").select("block", "n_words", "keys", "counts", "codes")
    both = ids.unionByName(texts, allowMissingColumns=True).select("block", "bucket", "sizes", "ids", "n_words", "keys", "counts", "codes")
    by_block = both.repartition("block").sortWithinPartitions("block", F.col("bucket").asc_nulls_last())
    out = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return by_block.mapInArrow(_assembler(spec, pa.field(key, arrow.field("key").type), buckets), out)
