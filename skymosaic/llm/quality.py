"""Quality by hierarchical empirical Bayes: a document's own evidence, its path's and its host's.

A document classifier (an additive logistic model over binned text measures, fitted on at most SAMPLE labelled rows) gives
each document a probability. Grouped sums of these per host and per path (host and section), without the document's own,
give its posteriors: a path's mean is shrunk toward its host's and a host's toward the global mean, by strengths estimated
from the variance between groups, so sparse sites fall back on the prior. A document's final log odds are its own, moved by
its path's log odds against the global ones; it counts once.

Cases: null and empty texts have no words and are scored by the measures of an empty text; null hosts and sections form
groups of their own; the only document of a host gets the global mean; ties at the threshold are kept; repeated rows are
scored one by one; a null id hashes as the text 'null' and has no label; without labelled rows every document has
probability 0.5 and is kept; an empty table gives an empty table; other columns are not read, and may have any name. Texts
are measured whole. Groups are summed before the shuffle. Their sums come back to the documents in a join that is a
broadcast while they are few; beyond, it is a sort-merge join whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, fold, ship, stored, text_view

#: Labelled rows that the document classifier is fitted on, at most.
SAMPLE = 20_000
BINS = 12
MEASURES = ("words", "word_bytes", "distinct", "letters", "capitals", "digits", "punctuation", "shouts", "symbols", "lines", "same_next", "letter_e")

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in ".,;:?"]] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[ord("!")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "*$#@&%^~|<>{}[]=_+\\/"]] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of MEASURES for each document."""
    w = Words(data, offsets)
    docs, start, end = len(offsets) - 1, w.doc_offsets[:-1], w.doc_offsets[1:]
    size = np.maximum(end - start, 1).astype(float)

    def share(kind: np.ndarray, by: np.ndarray) -> np.ndarray:
        running = np.append(0, np.cumsum(kind[w.data], dtype=np.int64))
        return (running[end] - running[start]) / by

    n = np.maximum(w.counts, 1).astype(float)
    owner = w.owner
    order = np.lexsort((w.hash, owner))
    h, o = w.hash[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[fresh], minlength=docs) / n
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    word_bytes = np.bincount(owner, w.end - w.start, docs) / n
    e = np.zeros(256, bool)
    e[[101, 69]] = True
    return np.column_stack([
        np.log1p(w.counts), word_bytes, distinct * np.log1p(n), share(_LETTER, size), share(_CAPITAL, size), share(_DIGIT, size), share(_POINT, n), share(_SHOUT, n), share(_SYMBOL, n), share(_LINE, n),
        np.bincount(owner[same], minlength=docs) / n, share(e, size),
    ])


def measured(rows: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """`keep` columns and `measures`, an array of doubles."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(len(keep)))
            for i, j in chunks(offsets, 1 << 21):
                x = measures(data, offsets[i : j + 1])
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keep))), values], [*keep, "measures"])

    return rows.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(work, ", ".join([*fields, "measures array<double>"]))


class Additive:
    """Logistic regression on indicator columns of binned measures; knots are quantiles of the sample."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0):
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        self.knots = [np.unique(np.append(np.quantile(x[:, k], quantiles), np.quantile(x[y == 0, k], quantiles) if (y == 0).any() else [])) for k in range(x.shape[1])]
        design = self.columns(x)
        self.weights = np.zeros(design.shape[1])
        gram = 0.25 * design.T @ design + ridge * np.eye(design.shape[1])
        gram[0, 0] -= ridge - 1e-6
        solve = np.linalg.inv(gram)  # a bound of the curvature: steps can't overshoot
        penalty = np.full(design.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-design @ self.weights))
            self.weights += solve @ (design.T @ (y - p) - penalty * self.weights)

    def columns(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1))]
        for k, knots in enumerate(self.knots):
            parts.append((np.searchsorted(knots, x[:, k], "right")[:, None] == np.arange(len(knots) + 1)).astype(float))
        return np.hstack(parts)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.weights[0])
        at = 1
        for k, knots in enumerate(self.knots):
            out += self.weights[at + np.searchsorted(knots, x[:, k], "right")]
            at += len(knots) + 1
        return out


def fit(measured_rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, modulus: int, held: int, sample: int = SAMPLE) -> Additive | None:
    known = labels.select(id_col, F.col(label_col).cast("int").alias("__label")).filter(f"`{id_col}` is not null and __label is not null and " + f"crc32(cast(cast(`{id_col}` as string) as binary)) % {modulus} <> {held}")
    rows = measured_rows.join(known, id_col).select("measures", "__label", F.xxhash64(id_col).alias("__order")).orderBy("__order").limit(sample).toArrow()
    if not rows.num_rows:
        return None
    x = np.array(rows.column("measures").to_pylist(), float)
    return Additive(x, rows.column("__label").to_numpy().astype(float))


def _logit(p):
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", section_col: str = "lang", label_col: str = "quality", modulus: int = 3, held: int = 1, threshold: float = 0.5, carry: Sequence[str] = ()) -> DataFrame:
    """One row a document: id, held_out, own (classifier), host_mean, path_mean, score and kept (score >= threshold), and the columns in `carry`.

    Labels teach only from rows whose crc32 of the id, modulo `modulus`, is not `held`; hosts and paths are summed over all rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col), F.col(host_col).cast("string").alias("host"), F.col(section_col).cast("string").alias("section"), F.struct(F.lit(0).alias("nothing"), *[F.col(c) for c in carry]).alias("__carry"), F.col(text_col).cast("string").alias("__t"))
    x = stored(measured(rows, "__t", [id_col, "host", "section", "__carry"]), "quality-measures")
    model = fit(x, labels, id_col, label_col, modulus, held)
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            logit = model.logit(flat) if model else np.zeros(batch.num_rows)
            own = 1 / (1 + np.exp(-np.clip(logit, -12, 12)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(own)], [id_col, "host", "section", "__carry", "own"])

    id_type = rows.schema[0].dataType.simpleString()
    own = x.mapInArrow(work, f"`{id_col}` {id_type}, host string, section string, __carry {rows.schema['__carry'].dataType.simpleString()}, own double")
    # null groups need a key that joins; names begin with a mark so that no name can be taken for it
    own = own.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("null")) for k in ("host", "section")})
    paths = own.groupBy("host", "section").agg(F.count("*").alias("n"), F.sum("own").alias("s"), F.sum(F.col("own") * F.col("own")).alias("q"))
    paths = stored(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s"), F.count("*").alias("k"), F.sum(F.col("host_s") * F.col("host_s") / F.col("host_n")).alias("b")).first()
    squares = paths.agg(F.sum("q").alias("q"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b")).first()
    if not total.n:
        mean, host_strength, path_strength = 0.5, 1.0, 1.0
    else:
        mean = min(max(total.s / total.n, 1e-4), 1 - 1e-4)
        within = max((squares.q - squares.b) / max(total.n - squares.k, 1), 1e-6)
        spread = lambda between, groups: max((between - (groups - 1) * within) / total.n, within * 1e-4)
        host_strength = within / spread(max(total.b - total.s**2 / total.n, 0.0), total.k)
        path_strength = within / spread(max(squares.b - total.b, 0.0), squares.k - total.k + 1)
    sites = paths.join(hosts, "host").select("host", "section", "n", "s", "host_n", "host_s")
    bounded = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-4)), F.lit(1 - 1e-4))
    joined = own.join(sites, ["host", "section"], "left")
    joined = joined.withColumn("host_mean", (F.col("host_s") - F.col("own") + host_strength * mean) / (F.col("host_n") - 1 + host_strength))
    joined = joined.withColumn("path_mean", (F.col("s") - F.col("own") + path_strength * F.col("host_mean")) / (F.col("n") - 1 + path_strength))
    logit = _logit(bounded("own")) + _logit(bounded("path_mean")) - F.lit(float(np.log(mean / (1 - mean))))
    scored = joined.withColumn("score", 1 / (1 + F.exp(-logit)))
    return scored.select(id_col, (fold(id_col, modulus) == held).alias("held_out"), "own", "host_mean", "path_mean", "score", (F.col("score") >= threshold).alias("kept"), *[F.col("__carry")[c].alias(c) for c in carry])
