"""Byte-level BPE encoding and decoding by longest matches and adjacent-token compatibility.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton (pyahocorasick) over the vocabulary finds
the longest token from any byte. A sequence of tokens is the one that the merges give exactly when every two neighbours
would stay apart if only those two were merged; that test is memoised. The encoder takes longest matches from left to
right and, where two neighbours are not compatible, falls back to the next shorter token, never visiting a dead byte
position twice, which keeps it linear in the text.

Cases: a null text is the empty text; an empty text has no ids and decodes to no bytes; repeated rows are encoded one by
one; a null id is returned as it is; an empty table gives an empty table; columns other than the id and the text are not
read, and may have any name. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship

#: Pieces whose ids a worker remembers; beyond it the memory starts afresh.
CACHE_PIECES = 200_000
#: Pairs of tokens whose compatibility a worker remembers, likewise.
MEMO_PAIRS = 300_000
#: Characters of text encoded before a batch of results is sent.
BATCH_CHARS = 4_000_000

_LATER = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_all(piece: bytes, ranks: dict[bytes, int], below: int = _LATER) -> list[bytes]:
    """The parts left when merges of rank under `below` are applied, lowest rank first and leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], _LATER), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def vocabulary_tables(ranks: dict[bytes, int]) -> dict:
    """Bytes of each id, the two tokens each id is merged from (-1: none), and ids by pair."""
    size = max(ranks.values()) + 1
    token = [b""] * size
    for t, i in ranks.items():
        token[i] = t
    left, right = [-1] * size, [-1] * size
    for t, i in ranks.items():
        if len(t) > 1:
            parts = merge_all(t, ranks, i)
            if len(parts) == 2:
                left[i], right[i] = ranks[parts[0]], ranks[parts[1]]
    return {"token": token, "left": left, "right": right}


class Encoder:
    def __init__(self, tables: dict):
        import ahocorasick

        self.token, left, right = tables["token"], tables["left"], tables["right"]
        self.length = [len(t) for t in self.token]
        self.pair = {(a, b): i for i, (a, b) in enumerate(zip(left, right)) if a >= 0}
        self.automaton = ahocorasick.Automaton()
        known = {t: i for i, t in enumerate(self.token) if t}
        for t, i in known.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [next((known[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), -1) for t in self.token]
        self.left, self.right = left, right
        self.memo: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}

    def _spine(self, i: int, child: list[int]) -> list[int]:
        out = [i]
        while child[out[-1]] >= 0:
            out.append(child[out[-1]])
        return out[::-1]  # from the single byte up to the token

    def compatible(self, a: int, b: int) -> bool:
        found = self.memo.get((a, b))
        if found is None:
            if len(self.memo) > MEMO_PAIRS:
                self.memo.clear()
            found = self.memo[a, b] = self._stay_apart(a, b)
        return found

    def _stay_apart(self, a: int, b: int) -> bool:
        """Follow what touches the boundary while both sides are merged; a merge across it that comes first joins them."""
        lefts, rights = self._spine(a, self.right), self._spine(b, self.left)
        i = j = 0
        while True:
            grow_left = lefts[i + 1] if i + 1 < len(lefts) else _LATER
            grow_right = rights[j + 1] if j + 1 < len(rights) else _LATER
            across = self.pair.get((lefts[i], rights[j]))
            if across is not None and across < grow_left and across <= grow_right:
                return False
            if grow_left == grow_right == _LATER:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def piece(self, s: str) -> list[int]:
        """Ids of one piece given as Latin-1 characters."""
        ids = [i for _, i in self.automaton.iter_long(s)]
        memo = self.memo
        for pair in zip(ids, ids[1:]):
            ok = memo.get(pair)
            if not (self.compatible(*pair) if ok is None else ok):
                return self._backtrack(s)
        return ids

    def _longest(self, s: str, at: int) -> int:
        return next(self.automaton.iter_long(s, at))[1]

    def _backtrack(self, s: str) -> list[int]:
        alive = bytearray(b"\1" * (len(s) + 1))
        out: list[int] = []
        at, t = 0, self._longest(s, 0)
        while at < len(s):
            end = at + self.length[t]
            if alive[end] and (not out or self.compatible(out[-1], t)):
                out.append(t)
                at = end
                if at < len(s):
                    t = self._longest(s, at)
            elif self.shorter[t] >= 0:
                t = self.shorter[t]
            else:
                alive[at] = 0
                t = out.pop()
                at -= self.length[t]
        return out

    def miss(self, s: str) -> bytes:
        if len(self.cache) >= CACHE_PIECES:
            self.cache.clear()
        found = np.array(self.piece(s.encode().decode("latin-1")), "<u4").tobytes()
        if len(s) <= 64:
            self.cache[s] = found
        return found

    def encode(self, text: str, split) -> bytes:
        get, miss = self.cache.get, self.miss
        return b"".join([get(s) or miss(s) for s in split(text)])


#: Encoders of this worker, by the hash of vocabulary and pattern; a worker outlives a query, so the newest replaces others.
_ready: dict[str, tuple] = {}


def _encoder(shared, key: str, pattern: str):
    if key not in _ready:
        import regex

        found = (Encoder(shared.value), regex.compile(pattern).findall)
        _ready.clear()
        _ready[key] = found
    return _ready[key]


def _tables(spark, vocabulary_path: str, pattern: str = ""):
    """Broadcast tables (as large as the vocabulary file, about 1 MB, whatever the corpus is), and the hash of vocabulary and pattern."""
    ship(spark)
    with open(vocabulary_path, "rb") as f:
        key = hashlib.sha256(f.read() + b"\0" + pattern.encode()).hexdigest()
    return spark.sparkContext.broadcast(vocabulary_tables(load_ranks(vocabulary_path))), key


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """`id_col`, `ids` (little-endian unsigned 32-bit ids as binary), `n_tokens`, and with `with_decoded` the bytes that the ids decode to."""
    shared, key = _tables(docs.sparkSession, vocabulary_path, pattern)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema[0], T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())] + [T.StructField("decoded", T.BinaryType())] * with_decoded)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = _encoder(shared, key, pattern)
        token = np.array(encoder.token, object)
        for batch in batches:
            begin, size, ids = 0, 0, []
            texts = batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                ids.append(encoder.encode(text, split))
                size += len(text)
                if size >= BATCH_CHARS or i + 1 == batch.num_rows:
                    out = [batch.column(0).slice(begin, len(ids)), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                    if with_decoded:
                        out.append(pa.array([b"".join(token[np.frombuffer(x, "<u4")].tolist()) for x in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, schema.names)
                    begin, size, ids = i + 1, 0, []

    return rows.mapInArrow(work, schema)


def decode(encoded: DataFrame, vocabulary_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of `encoded` and `decoded`, the bytes of its ids; null ids decode to no bytes."""
    shared, _ = _tables(encoded.sparkSession, vocabulary_path)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    place = encoded.columns.index(ids_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = np.array(shared.value["token"], object)
        for batch in batches:
            found = [b"".join(token[np.frombuffer(x.as_py() or b"", "<u4")].tolist()) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], schema.names)

    return encoded.mapInArrow(work, schema)


def digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
