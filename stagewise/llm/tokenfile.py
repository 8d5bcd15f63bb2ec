"""Token-id shards: every document's ids in a zstandard frame of its own, over one shared dictionary.

A shard is: MAGIC, the byte width of an id, the dictionary's SHA-256; the frames one after another; then the
index (per document its id, whether it has one, the frame's offset, its number of tokens) and a fixed-size tail
that says where the index begins. One document is read with two seeks and one small frame. The dictionary lies
beside the shards under its hash. Shards follow each other in ascending doc_id order.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .align import byte_alphabet
from .shared import bounded_sample, lean, ranges, scratch, stash, tasks
from .storage import reading, writing

MAGIC = b"TOKSHRD1"
TAIL = struct.Struct("<QQ8s")
LEVEL = 3
#: Words whose ids a Python worker remembers; beyond this it starts anew.
REMEMBERED = 500_000
#: Words of letters that are encoded as one text.
TOGETHER = 64
SIGNS = string.punctuation.encode()


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Steps of a tokenizer that drops white space, never joins across it, and cuts letters from all else.
BY_WORDS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordIds:
    """Ids of texts, as little-endian bytes. If the tokenizer has the steps of BY_WORDS, word by word, each new word once; else text by text."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        steps = json.loads(self.tokenizer.to_str())
        marked = all("<|" in t["content"] for t in steps["added_tokens"])
        self.by_words = marked and all(((steps.get(k) or {}).get("normalizers") or (steps.get(k) or {}).get("pretokenizers")) == v for k, v in BY_WORDS.items()) and not steps.get("post_processor")
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.known: dict[bytes, bytes] = {}
        self.letters = re.compile("(?:[a-z]|{})+".format("|".join(c for c in map(chr, range(128, 256)) if c.isalpha() and c == c.lower())).encode()).fullmatch
        self.respelt = self.spell(steps["model"])

    def spell(self, model: dict):
        """The tokenizer's model with one letter for a word's last one and the suffix that marks it there. No merge begins at such a
        letter, so words can stand one right after another. None for a model that does more than merge, or has other marks.
        """
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        mark, vocab = model.get("end_of_word_suffix"), model.get("vocab") or {}
        more = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        spelt = {b: c for c, b in byte_alphabet().items()}
        alphabet = set(spelt.values())
        if model["type"] != "BPE" or not mark or more or any(c + x not in vocab for c in spelt.values() for x in ("", mark)):
            return None
        if any(mark in (rest := t.removesuffix(mark)) or not rest or not alphabet.issuperset(rest) for t in vocab):
            return None
        ends = {c: chr(0xE000 + b) for b, c in spelt.items()}
        again = {t: t[: -len(mark) - 1] + ends[t[-len(mark) - 1]] if t.endswith(mark) else t for t in vocab}
        self.inside, self.last = (np.array([ord(x[spelt[b]]) for b in range(256)], "<u2") for x in ({c: c for c in ends}, ends))
        self.is_last = np.zeros(max(vocab.values()) + 1, bool)
        self.is_last[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        return Tokenizer(BPE({again[t]: i for t, i in vocab.items()}, [(again[x], again[y]) for x, y in model["merges"]]))

    def folded(self, text: str) -> bytes:
        """The text in UTF-8; in lower case where that changes no id: the tokenizer lowers too, but not before it has
        found its special tokens and composed characters. Latin-1 has nothing to compose."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.encode()

    def learn(self, words: set[bytes]) -> None:
        """Ids of new words. Lower-case letters of Latin-1, and signs after them, are one word each to the tokenizer, on which its
        first steps do nothing but spell bytes as letters: its model alone encodes them."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        split = {w: x for w in words if self.letters(x := w.rstrip(SIGNS))} if self.respelt else {}
        letters = [x for x in set(split.values()) if x not in self.known]
        self.known.update(zip(letters, self.of_letters(letters), strict=True))
        self.learn_others(words.difference(split) | {w[len(x) :] for w, x in split.items() if len(w) > len(x)})
        for w, x in split.items():
            if len(w) > len(x):
                self.known[w] = self.known[x] + self.known[w[len(x) :]]

    def of_letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters only, written one after another."""
        if not words:
            return []
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        raw = np.frombuffer(b"".join(words), np.uint8)
        spelt = self.inside[raw]
        spelt[ends - 1] = self.last[raw[ends - 1]]
        text = spelt.tobytes().decode("utf-16-le")
        at = [0, *ends[TOGETHER - 1 : -1 : TOGETHER].tolist(), len(text)]
        found = self.respelt.encode_batch_fast([text[i:j] for i, j in pairwise(at)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable([x.ids for x in found]), "<u2" if self.width == 2 else "<u4")
        cuts = ((np.flatnonzero(self.is_last[ids]) + 1) * self.width).tolist()
        flat = ids.tobytes()
        return [flat[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]

    def learn_others(self, words: set[bytes]) -> None:
        """Any other letters and one point or comma are two words to the tokenizer, so the letters' ids serve both; but
        not if a letter becomes a letter and a mark when it is lowered, as the mark would go with the point."""
        ended = [w for w in words if w[-1:] in (b".", b",") and (rest := w[:-1].decode()).isalpha() and rest.lower().isalpha()]
        plain = [w for w in words.difference(ended) | {w[:-1] for w in ended} | {b".", b","} if w not in self.known]
        for lo in range(0, len(plain), 4096):
            part = plain[lo : lo + 4096]
            self.known.update(zip(part, self.plainly([w.decode() for w in part]), strict=True))
        for w in ended:
            self.known[w] = self.known[w[:-1]] + self.known[w[-1:]]

    def plainly(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.width == 2 else "I"
        return [array(kind, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self.plainly(texts)
        split = [self.folded(x).split() for x in texts]
        found = [list(map(self.known.get, words)) for words in split]
        gaps = [(words, ids, list(missing(ids))) for words, ids in zip(split, found, strict=True) if None in ids]
        if gaps:
            new = {words[i] for words, _, at in gaps for i in at}
            self.learn(new)
            for words, ids, at in gaps:
                for i in at:
                    ids[i] = self.known[words[i]]
        return [b"".join(ids) for ids in found]


def missing(found: list) -> Iterator[int]:
    """Where the Nones are."""
    at = -1
    while True:
        try:
            at = found.index(None, at + 1)
        except ValueError:
            return
        yield at


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def groups(texts: list[str], size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters together; a longer text comes alone."""
    lo, n = 0, 0
    for i, x in enumerate(texts):
        if i > lo and n + len(x) > size:
            yield lo, i
            lo, n = i, 0
        n += len(x)
    if lo < len(texts):
        yield lo, len(texts)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    ids = word_ids(path)
    end = int(end_id).to_bytes(ids.width, "little")
    for b in batches:
        texts = [x or "" for x in b.column(1).to_pylist()]
        for lo, hi in groups(texts):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([x + end for x in ids.encode(texts[lo:hi])], pa.binary())], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids) of every row of (doc_id, text): the text's ids and end_id, little-endian. Null text: empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(lambda b: encoded(b, path, end_id)), f"doc_id {kind}, ids binary")


class Dictionary(NamedTuple):
    data: bytes
    digest: bytes

    def shared(self) -> zstandard.ZstdCompressionDict:
        return zstandard.ZstdCompressionDict(self.data)


def train(docs: DataFrame, path: str, end_id: int, sample_rows: int = 1000, sample_bytes: int = 8192, size: int = 65536) -> Dictionary:
    """A dictionary from about sample_rows serialized id arrays (twice as many at most), of each at most sample_bytes. Only the shards' size depends on it."""
    sample = encode(bounded_sample(docs.select("doc_id", "text"), sample_rows), path, end_id).select(F.substring("ids", 1, sample_bytes).alias("ids"))
    parts = [bytes(r["ids"]) for r in sample.collect()]
    try:
        data = zstandard.train_dictionary(size, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to train on: the arrays themselves serve
        data = b"".join(parts)[-size:]
    return Dictionary(data, hashlib.sha256(data).digest())


class Shard:
    """One shard while it is written."""

    def __init__(self, out: pa.NativeFile, width: int, digest: bytes) -> None:
        self.out, self.at = out, 0
        self.rows: list[tuple[int, bool, int, int]] = []
        self.put(MAGIC + struct.pack("<B", width) + digest)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, frame: bytes, n_tokens: int) -> None:
        self.rows.append((doc_id or 0, doc_id is not None, self.at, n_tokens))
        self.put(frame)

    def close(self) -> None:
        index = self.at
        for i, kind in enumerate(("<i8", "<u1", "<u8", "<u8")):
            self.put(np.array([r[i] for r in self.rows], kind).tobytes())
        self.put(TAIL.pack(index, len(self.rows), MAGIC))


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, shard_bytes: int = 32 << 20, sample_rows: int = 1000) -> DataFrame:
    """Write shards of all rows of (doc_id, text) into the folder; returns their manifest: name, docs, tokens, start.

    start: ids in all shards before. Rows are compressed before the one shuffle, which deals them out by ranges
    of doc_id, null last; equal ids are ordered by their frames. A shard that reaches shard_bytes is followed by
    another. No rows write no shards.
    """
    spark = docs.sparkSession
    trained = train(docs, path, end_id, sample_rows)
    with writing(f"{folder}/{trained.digest.hex()}.dict") as out:
        out.write(trained.data)
    width = 2 if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    kind = docs.schema["doc_id"].dataType.simpleString()

    cut = ranges(docs, "doc_id")

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained.shared(), write_checksum=False, write_dict_id=False)
        for b in encoded(batches, path, end_id):
            ids, keys = b.column(1).to_pylist(), b.column(0).cast(pa.int64())
            at = np.where(keys.is_null().to_numpy(zero_copy_only=False), cut.n, cut.n - 1 - cut.numbers(keys)).astype(np.int32)
            columns = [b.column(0), pa.array([z.compress(x) for x in ids], pa.binary()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "frame", "n_tokens", "at"])

    # Ranges are numbered here: a function of its own would be a second Python worker of each task, and workers that change places all remember words.
    frames = docs.select("doc_id", "text").mapInArrow(lean(compressed), f"doc_id {kind}, frame binary, n_tokens long, at int")
    dealt = frames.repartitionById(cut.n + 1, F.col("at")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "frame")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row, k = next(rows, None), 0
        while row:
            name, n_docs, n_tokens = f"{row[3]:06d}-{k:06d}.tok", 0, 0
            with writing(f"{folder}/{name}") as out:
                shard = Shard(out, width, trained.digest)
                while row and shard.at < shard_bytes:
                    shard.add(*row[:3])
                    n_docs, n_tokens = n_docs + 1, n_tokens + row[2]
                    row = next(rows, None)
                shard.close()
            k += 1
            yield pa.RecordBatch.from_pydict({"name": [name], "docs": [n_docs], "tokens": [n_tokens]})

    manifest = stash(dealt.mapInArrow(shards, "name string, docs long, tokens long"), "shards")
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


class Reader:
    """A shard's index, and its documents one by one."""

    def __init__(self, file: pa.NativeFile, folder: str) -> None:
        self.file = file
        index, n, magic = TAIL.unpack(self.bytes(file.size() - TAIL.size, TAIL.size))
        head = self.bytes(0, len(MAGIC) + 1 + 32)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        self.width, self.digest = head[len(MAGIC)], head[len(MAGIC) + 1 :]
        with reading(f"{folder}/{self.digest.hex()}.dict") as f:
            data = f.read()
        if hashlib.sha256(data).digest() != self.digest:
            raise ValueError("the dictionary does not have the shard's hash")
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        raw, at, columns = self.bytes(index, n * 25), 0, []
        for kind in ("<i8", "<u1", "<u8", "<u8"):
            columns.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.doc_ids, self.has_id, self.offsets, self.n_tokens = columns
        self.ends = np.append(self.offsets[1:], index)

    def bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def ids(self, i: int) -> np.ndarray:
        frame = self.bytes(int(self.offsets[i]), int(self.ends[i] - self.offsets[i]))
        return np.frombuffer(self.zstd.decompress(frame), f"<u{self.width}")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents in the shards of a manifest."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with reading(f"{folder}/{name}") as file:
                    shard = Reader(file, folder)
                    starts = start + np.cumsum(shard.n_tokens) - shard.n_tokens
                    for lo in range(0, len(shard.doc_ids), 256):
                        hi = min(lo + 256, len(shard.doc_ids))
                        ids = [shard.ids(i).astype("<u4") for i in range(lo, hi)]
                        columns = [
                            pa.array(shard.doc_ids[lo:hi], pa.int64(), mask=shard.has_id[lo:hi] == 0),
                            pa.array(starts[lo:hi].astype(np.int64)),
                            pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                            pa.array([x.tobytes() for x in ids], pa.binary()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    listed = manifest.select("name", "start").repartition(tasks(manifest.sparkSession))
    return listed.mapInArrow(lean(opened), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write shards to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32 of every document."""
    folder = scratch(docs.sparkSession, "tokens")
    return read(write(docs, folder, path, end_id), folder).drop("ids")
