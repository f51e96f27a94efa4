"""Resampling towards a target distribution, over hashed n-grams whose CRCs are composed from the CRCs of words.

A feature's bucket is the CRC-32 of its words joined by one space. The CRC of each word is worked out once, for a whole batch
of words at a time; that of an n-gram follows from crc(a + b) = shift(crc(a), len(b)) xor crc(b), where `shift` over n bytes
is a 32 x 32 matrix over GF(2). No n-gram is ever written out. `weigh` counts buckets over all documents and all target
texts, gives each bucket the logarithm of how much more common it is among the targets, and each document the mean of its
features' gains; `draw` adds Gumbel noise made from the ids and keeps the highest scores, a sample without replacement in
which a document's odds follow its weight.

What the driver and every task hold is a count or a gain for each bucket, a parameter's number. Ranks come from ranges of
about equal size and their counts.

Cases: a null text has no words, no features and weight 0, like the empty text; texts of any length are read whole;
a null id counts as the text 'null' in the noise and comes last among equal scores; documents of equal score are ordered by
id, equal rows by the order in which they are stored; repeated rows count and are drawn each for itself; an empty
table of documents gives an empty table, an empty table of targets gives every bucket the gain of t = 0, T = 0; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, chunks, numbered, ship, stored, text_view

#: The reflected polynomial of CRC-32, a fixed value.
POLYNOMIAL = 0xEDB88320
#: Longer words take zlib's CRC one by one, and their shifts power by power.
SHORT = 64

#: Every byte but 0-9, a-z and those of characters outside ASCII parts words.
_BREAK = np.zeros(256, bool)
_BREAK[:128] = True
_BREAK[48:58] = _BREAK[97:123] = False


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


def _spread(columns: np.ndarray) -> np.ndarray:
    """(4, 256) table of a matrix given by its 32 columns: its product with each value of each byte."""
    values = np.arange(256)
    out = np.zeros((4, 256), np.uint32)
    for i in range(32):
        out[i // 8] ^= np.where(values >> i % 8 & 1, columns[i], 0).astype(np.uint32)
    return out


def _times(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


class Shifts:
    """Matrices that carry a CRC over n further bytes: one for each small n, and one for each power of two."""

    def __init__(self):
        self.bytes = _byte_table()
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        one = self.bytes[unit & 255] ^ (unit >> 8)
        small = [unit]
        for _ in range(1, SHORT):
            small.append(self.bytes[small[-1] & 255] ^ (small[-1] >> 8))
        self.small = np.stack([_spread(c) for c in small]).ravel()
        self.powers, columns = [], one
        for _ in range(32):
            self.powers.append(_spread(columns))
            columns = _times(self.powers[-1], columns)

    def over(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        """`crc` of texts carried over `size` zero bytes each."""
        short = size < SHORT
        base = np.where(short, size, 0) * 1024
        low, mid, high, top = (crc >> k & 255 for k in (0, 8, 16, 24))
        out = self.small[base + low] ^ self.small[base + 256 + mid] ^ self.small[base + 512 + high] ^ self.small[base + 768 + top]
        for i in np.flatnonzero(~short):
            one = crc[i : i + 1]
            for k in range(int(size[i]).bit_length()):
                if size[i] >> k & 1:
                    one = _times(self.powers[k], one)
            out[i] = one[0]
        return out

    def words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRC of each word, a byte place of all words at a time."""
        out = np.empty(len(start), np.uint32)
        for i in np.flatnonzero(size > SHORT):
            out[i] = zlib.crc32(data[start[i] : start[i] + size[i]])
        order = np.flatnonzero(size <= SHORT)
        order = order[np.argsort(size[order].astype(np.uint8), kind="stable")[::-1]]
        at, left = start[order], np.bincount(size[order], minlength=1)
        crc, n = np.full(len(order), 0xFFFFFFFF, np.uint32), len(order) - int(left[0])
        for k in range(len(left) - 1):
            crc[:n] = self.bytes[(crc[:n] ^ data[at[:n] + k]) & 255] ^ (crc[:n] >> 8)
            n -= int(left[k + 1])
        out[order] = ~crc
        return out


_SPACE = np.uint32(zlib.crc32(b" "))


def gram_crcs(words: Words, shifts: Shifts, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to `longest`: the CRC of the n words from each word on, and whether they lie in one document."""
    size = words.end - words.start
    crc = shifts.words(words.data, words.start, size)
    left = np.repeat(words.bounds[1:], words.counts) - np.arange(len(crc))
    grams, out = crc, [(crc, left >= 1)]
    for n in range(2, longest + 1):
        last = np.roll(crc, 1 - n)
        spaced = shifts.over(grams, np.ones(len(grams), np.int64)) ^ _SPACE
        grams = shifts.over(spaced, np.roll(size, 1 - n)) ^ last
        out.append((grams, left >= n))
    return out


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; buckets without any are left out."""
    ship(texts.sparkSession)
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts, counts = Shifts(), np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            for i, j in chunks(offsets):
                for crc, whole in gram_crcs(Words(data, offsets[i : j + 1], lower=True, hashes=False, space=_BREAK), shifts, longest):
                    counts += np.bincount(crc[whole] % buckets, minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found])], schema.names)

    counted = texts.select(F.col(text_col).cast("string")).mapInArrow(work, schema)
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln of how much likelier the target is to use each bucket), with one feature more in every bucket."""
    n = np.zeros((2, buckets), np.int64)
    for k, counts in enumerate((raw, target)):
        for bucket, count in counts.collect():
            n[k, bucket] = count
    s, t = n.astype(float)
    odds = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(odds)).astype(np.int64)


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """`id_col`, `n_words`, `n_features`, `weight` (floored mean gain of a document's features; none: 0)."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, text_col, longest, buckets), buckets)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema[0], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = Shifts()
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            for i, j in chunks(offsets):
                words = Words(data, offsets[i : j + 1], lower=True, hashes=False, space=_BREAK)
                total, features = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for n, (crc, whole) in enumerate(gram_crcs(words, shifts, longest)):
                    sums = np.concatenate([[0], np.cumsum(np.where(whole, gain[crc % buckets], 0))])
                    total += sums[words.bounds[1:]] - sums[words.bounds[:-1]]
                    features += np.maximum(words.counts - n, 0)
                weight = total // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x.astype(np.int64)) for x in (words.counts, features, weight))], schema.names)

    return rows.mapInArrow(work, schema)


def draw(weighed: DataFrame, id_col: str = "doc_id", percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """`weighed` with `score` (weight and noise) and `rank`: of the N rows with `least_words` the floor(percent * N / 100) of highest score count 1, 2, 3, ..."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighed.withColumn("score", F.col("weight") + noise), "resampling-scores")
    fit = F.col("n_words") >= least_words
    placed = numbered(scored.withColumn("__fit", fit), [F.desc("__fit"), F.desc("score"), F.asc_nulls_last(id_col)], "resampling-ranks")
    n = scored.filter(fit).count()
    rank = F.when(F.col("place") < percent * n // 100, F.col("place") + 1)
    return placed.withColumn("rank", rank).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """`id_col`, `n_words`, `n_features`, `weight`, `score`, `rank` of every document; those that are not drawn have no rank."""
    return draw(weigh(docs, target, id_col, text_col, longest, buckets), id_col, percent, least_words, seed)
