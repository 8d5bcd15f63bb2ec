"""Byte-level BPE by recursive DuckDB queries, one database per Python worker.

Spark deals out the documents; a task takes whole texts in groups of about GROUP characters. The pretokens of a
group that the worker does not know yet go into one table of (word, pos, token), a row per byte. A recursive query
joins neighbours to the merge table and contracts pairs until no pair is left to merge:

* words of up to LONG bytes: each round contracts the word's leftmost pair of minimum rank. A row holds its right neighbour and
  their merge as well, so that a round needs no order and looks up only the two pairs that the contraction makes anew;
* longer ones are first cut where two bytes meet that stand side by side in no piece of the vocabulary: no merge ever
  joins them, so what is left and right of the cut is contracted alike on its own. Of parts that are still longer than
  LONG each round contracts, from the left, the occurrences of the minimum-rank pair up to the first that makes a pair
  of a lower rank with a neighbour. Until then all other pairs rank higher, so the leftmost rule takes the same
  occurrences one by one; that pair comes next.

A pretoken that is itself in the vocabulary is that one token. Decoding joins ids to their pieces in order and cuts the
joined pieces into documents.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import lean

#: Characters of text that are encoded at once, and bytes up to which a word counts as short.
GROUP, LONG = 2 << 20, 64
#: New words that one query encodes, and words that a worker remembers before it starts anew.
AT_ONCE, REMEMBERED = 20_000, 400_000

PAIRS = """
  SELECT s.*, id FROM (
    SELECT *, lead(tok) OVER w AS following, lag(pos) OVER w AS preceding FROM step WINDOW w AS (PARTITION BY word ORDER BY pos)
  ) s LEFT JOIN merges ON l = tok AND r = following"""

LAST = """
SELECT word AS owner, tok AS value FROM step JOIN (SELECT word, max(n) AS n FROM step WHERE pos = 0 GROUP BY word) USING (word, n) ORDER BY word, pos"""

#: nxt: where the right neighbour, of token following, begins; id: what both merge to. Positions fit in 8 bits, and END is none of them.
END = 255
LEFTMOST = f"""
WITH RECURSIVE step(n, word, pos, nxt, tok, following, id) AS (
  SELECT 0, word, pos, nxt, tok, following, m.id FROM given LEFT JOIN merges m ON l = tok AND r = following
  UNION ALL
  (WITH best AS (SELECT word, min(CAST(id AS BIGINT) * 65536 + pos * 256 + nxt) AS pair FROM step WHERE id IS NOT NULL GROUP BY word),
   chosen AS (SELECT word, CAST(pair // 65536 AS INT) AS merged, CAST(pair // 256 % 256 AS INT) AS spot, CAST(pair % 256 AS INT) AS gone FROM best),
   made AS (SELECT n + 1 AS n, word, CASE WHEN pos = gone THEN spot ELSE pos END AS pos, nxt, CASE WHEN pos = gone THEN merged ELSE tok END AS tok,
                   CASE WHEN nxt = spot THEN merged ELSE following END AS following, id, pos = gone OR nxt = spot AS anew
            FROM step JOIN chosen USING (word) WHERE pos <> spot)
   SELECT n, word, pos, nxt, tok, following, CASE WHEN anew THEN m.id ELSE made.id END FROM made LEFT JOIN merges m ON anew AND l = tok AND r = following)
){LAST}"""

ALL_LEAST = f"""
WITH RECURSIVE step(n, word, pos, tok) AS (
  SELECT 0, word, pos, tok FROM given
  UNION ALL
  (WITH pair AS MATERIALIZED ({PAIRS}),
   best AS (SELECT word, min(id) AS merged FROM pair WHERE id IS NOT NULL GROUP BY word),
   marked AS (SELECT p.*, merged, coalesce(id = merged, false) AS least, row_number() OVER (PARTITION BY p.word ORDER BY pos) AS k FROM pair p JOIN best USING (word)),
   runs AS (SELECT *, least AND (k - coalesce(max(CASE WHEN NOT least THEN k END) OVER (PARTITION BY word ORDER BY pos), 0)) % 2 = 1 AS hit FROM marked),
   near AS (SELECT *, CASE WHEN lag(hit, 2, false) OVER o THEN merged ELSE lag(tok) OVER o END AS before, lead(tok, 2) OVER o AS after FROM runs WINDOW o AS (PARTITION BY word ORDER BY pos)),
   made AS (SELECT near.*, hit AND (coalesce(a.id < merged, false) OR coalesce(b.id < merged, false)) AS lower
            FROM near LEFT JOIN merges a ON a.l = near.before AND a.r = merged LEFT JOIN merges b ON b.l = merged AND b.r = near.after),
   first AS (SELECT word, min(CASE WHEN lower THEN pos END) AS upto FROM made GROUP BY word),
   taken AS (SELECT made.*, hit AND (upto IS NULL OR pos <= upto) AS joined FROM made JOIN first USING (word)),
   done AS (SELECT *, lag(joined, 1, false) OVER (PARTITION BY word ORDER BY pos) AS eaten FROM taken)
   SELECT n + 1, word, pos, CASE WHEN joined THEN merged ELSE tok END FROM done WHERE NOT eaten)
){LAST}"""

DECODE = "SELECT doc AS owner, piece AS value FROM given JOIN pieces USING (id) ORDER BY i"


def ascii_pattern(pattern: str) -> str | None:
    """The pattern for texts in ASCII, in the syntax of the faster standard module; None if it asks for more than is known here."""
    blank = r" \t\n\r\x0b\x0c"
    for theirs, ours in ((r"[^\s\p{L}\p{N}]", f"[^{blank}A-Za-z0-9]"), (r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"), (r"\s", f"[{blank}]"), (r"\S", f"[^{blank}]")):
        pattern = pattern.replace(theirs, ours)
    return None if re.search(r"\\[pPwWdDbBX]|\[\[", pattern) else pattern


def missing(found: list) -> Iterator[int]:
    """Where the Nones are."""
    at = -1
    while True:
        try:
            at = found.index(None, at + 1)
        except ValueError:
            return
        yield at


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        narrow = ascii_pattern(pattern)
        self.find_ascii = narrow and re.compile(narrow).findall
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.beside = np.zeros((256, 256), bool)  # bytes that stand side by side in some piece
        for t in ranks:
            b = np.frombuffer(t, np.uint8)
            self.beside[b[:-1], b[1:]] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.table("merges", **{k: np.array(v, np.int32) for k, v in zip(("l", "r", "id"), zip(*merges, strict=True), strict=True)})
        self.table("pieces", id=np.fromiter(ranks.values(), np.int32), piece=pa.array(list(ranks), pa.binary()))

    def table(self, name: str, **columns) -> None:
        self.db.register("loading", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM loading")
        self.db.unregister("loading")

    def query(self, sql: str, **given) -> tuple[np.ndarray, list[pa.Array]]:
        """All values that a query gives, in its order, and the owner of each: a word or a document."""
        self.db.register("given", pa.table(given))
        try:
            got = self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister("given")
        return got.column("owner").to_numpy(), got.column("value").chunks

    def contract(self, words: list[bytes], sql: str) -> list[bytes]:
        """The ids of words, as little-endian unsigned 32-bit numbers."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(words), np.uint8)
        pos = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        given = {"word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": pos.astype(np.int32), "tok": self.single[data]}
        if sql is LEFTMOST:
            given |= {"nxt": given["pos"] + np.int32(1), "following": np.append(given["tok"][1:], np.int32(-1))}
            given["nxt"][ends - 1], given["following"][ends - 1] = END, -1
        owner, ids = self.query(sql, **given)
        return parted(b"".join([x.to_numpy().astype("<u4").tobytes() for x in ids]), 4 * np.bincount(owner, minlength=len(words)))

    def cut(self, raw: bytes) -> list[bytes]:
        """A long word's parts, between bytes that no piece joins."""
        b = np.frombuffer(raw, np.uint8)
        at = [0, *(np.flatnonzero(~self.beside[b[:-1], b[1:]]) + 1).tolist(), len(raw)]
        return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]

    def contracted(self, parts: set[bytes]) -> dict[bytes, bytes]:
        out = {}
        short, long = ([x for x in parts if (len(x) <= LONG) == is_short] for is_short in (True, False))
        for kind, sql, most in ((short, LEFTMOST, AT_ONCE), (long, ALL_LEAST, 200)):
            for lo in range(0, len(kind), most):
                out |= dict(zip(kind[lo : lo + most], self.contract(kind[lo : lo + most], sql), strict=True))
        return out

    def learn(self, words: list[str]) -> None:
        """Ids of new words."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        raw = [w.encode() for w in words]
        ranks = list(map(self.ranks.get, raw))
        self.known.update((w, r.to_bytes(4, "little")) for w, r in zip(words, ranks, strict=True) if r is not None)
        short = [i for i, r in enumerate(ranks) if r is None and len(raw[i]) <= LONG]
        long = [i for i, r in enumerate(ranks) if r is None and len(raw[i]) > LONG]
        for lo in range(0, len(short), AT_ONCE):
            part = short[lo : lo + AT_ONCE]
            self.known.update(zip([words[i] for i in part], self.contract([raw[i] for i in part], LEFTMOST), strict=True))
        for i in long:
            parts = self.cut(raw[i])
            ids = self.contracted(set(parts))
            self.known[words[i]] = b"".join([ids[x] for x in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.find_ascii(x) if self.find_ascii and x.isascii() else self.find(x) for x in texts]
        found = [list(map(self.known.get, words)) for words in split]
        gaps = [(words, ids, list(missing(ids))) for words, ids in zip(split, found, strict=True) if None in ids]
        if gaps:
            self.learn(list({words[i] for words, _, at in gaps for i in at}))
            for words, ids, at in gaps:
                for i in at:
                    ids[i] = self.known[words[i]]
        return [b"".join(ids) for ids in found]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        sizes = [len(x) // 4 for x in ids]
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        owner, pieces = self.query(DECODE, doc=np.repeat(np.arange(len(ids), dtype=np.int32), sizes), i=np.arange(len(flat)), id=flat)
        at = [np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1] for x in pieces]
        each = np.bincount(owner, np.concatenate([np.zeros(0), *map(np.diff, at)]), len(ids)).astype(np.int64)
        return parted(b"".join([memoryview(x.buffers()[2])[k[0] : k[-1]] for x, k in zip(pieces, at, strict=True)]), each)


def parted(raw: bytes, sizes: np.ndarray) -> list[bytes]:
    """Parts of so many bytes, one after another."""
    ends = np.cumsum(sizes).tolist()
    return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Bpe:
    return Bpe(load_ranks(path), pattern)


def groups(texts: list[str], size: int = GROUP) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters together; a longer text comes alone."""
    lo, n = 0, 0
    for i, x in enumerate(texts):
        if i > lo and n + len(x) > size:
            yield lo, i
            lo, n = i, 0
        n += len(x)
    if lo < len(texts):
        yield lo, len(texts)


def encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = coder(path, pattern)
    for b in batches:
        texts = [x or "" for x in b.column(1).to_pylist()]
        for lo, hi in groups(texts):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(bpe.encode(texts[lo:hi]), pa.binary())], ["doc_id", "ids"])


def decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = coder(path, pattern)
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            raw = bpe.decode([x or b"" for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row of (doc_id, text): ids as little-endian unsigned 32-bit numbers.

    A null text is empty and has no ids. Rows are encoded one by one, so repeated rows and ids give as many rows;
    further columns are not read; no rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda b: encoded(b, path, pattern), f"doc_id {kind}, ids binary")


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of (doc_id, ids): the bytes that the ids stand for; null ids: none."""
    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "ids").mapInArrow(lambda b: decoded(b, path, pattern), f"doc_id {kind}, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and digest both in one task: doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in decoded(encoded(batches, path, pattern), path, pattern):
            ids, raw = b.column(1).to_pylist(), b.column(2).to_pylist()
            sums = [pa.array([hashlib.sha256(x).hexdigest() for x in c], pa.string()) for c in (ids, raw)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *sums], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(lean(digested), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
