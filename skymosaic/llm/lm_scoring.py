"""Hashed maximum-entropy language model with a class-factored softmax.

log P(word | context) = log softmax over CLASSES classes + log softmax over the SUBCLASSES parts of the class + log share of
the word in that part. Both softmaxes have weights for hashed features of the context (previous word, skipped word, and the
pair; inside a class the class is hashed with them); the share is add-one over the part's training counts, with one slot for
all words never seen, so the words of a part and that slot sum to one. The end of a text is a class of its own.

A word's class and part go by its form, a hash of its first two and last two bytes, so that unseen words have one, too. Forms
are put in classes, and classes in parts, by spherical-like k-means of what stands next to them: every task counts, for each
form, the hashed forms of its neighbours, over all training rows; the sums (4 MB) are clustered on the driver.

Training: every partition of the training rows makes minibatch gradient updates from the shared weights; the updated rows
are summed by blocks of features, weighted by how often a partition saw them, and their mean is the next model. The weights
have a row for every TOKENS_PER_ROW training tokens, as a power of two between 2^LEAST_BITS and 2^MOST_BITS rows (8 MB).
Word counts are grouped and written to the shared folder. Scoring looks the HEAD most frequent words up in a broadcast table
of bounded size; the others meet their counts in a join on the word, so counts are exact for every word.

A minibatch depends on which rows share a task: with other partitions `score` moves by about a hundredth of a decimal
logarithm a token, all other columns agree exactly.

Cases: a null text is the empty text, which has one token, its end; A-Z are lowered, other letters are not; without
training rows all words are unknown (N = V = 0); words of equal count are all frequent or all rare; a null id hashes as the
text 'null'; rows repeated with one id are scored one by one; an empty table gives an empty table; other columns are not
read, and may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, fold, mix, partitions, ship, stored, text_view

CLASSES = SUBCLASSES = 16
LEAVES = CLASSES * SUBCLASSES
#: Forms of words, and hashed forms of neighbours that are counted for each.
FORMS, NEAR = 1 << 13, 64
TOKENS_PER_ROW, LEAST_BITS, MOST_BITS = 64, 12, 16
RATE, DAMP = 1.5, 5.0
EPOCHS = 1
#: Tokens of a gradient step, and distinct words that a task counts before it sends them on.
STEP_TOKENS = 1 << 16
COUNT_WORDS = 400_000
#: Most frequent words whose counts are broadcast (about 16 bytes each).
HEAD = 200_000
BLOCKS = 64
TOKENS_CHUNK = 1 << 19

END = b" "  # written for a text's end; no word holds a space


def forms(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Forms of the words from each start to each end (one byte at least)."""
    long = end - start > 1
    at = lambda i: data[i].astype(np.uint32)
    opens = at(start) << np.uint32(8) | np.where(long, at(np.minimum(start + 1, len(data) - 1)), 0).astype(np.uint32)
    closes = at(end - 1) << np.uint32(8) | np.where(long, at(np.maximum(end - 2, 0)), 0).astype(np.uint32)
    return ((opens * np.uint32(0x9E3779B1) ^ closes * np.uint32(0x85EBCA77)) >> np.uint32(7) & np.uint32(FORMS - 1)).astype(np.int64)


class Stream:
    """Tokens of some documents, a text's words and then its end: form of each (FORMS for ends), and hashes of three context features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, features: bool = True):
        self.words = w = Words(data, offsets, lower=True, hashes=features)
        n, docs = len(w.start), len(offsets) - 1
        at = np.arange(n) + w.owner  # place of each word among tokens
        self.total = n + docs
        self.doc = np.repeat(np.arange(docs), w.counts + 1)
        self.form = np.full(self.total, FORMS, np.int64)
        self.form[at] = forms(w.data, w.start, w.end)
        if not features:
            return
        word = np.full(self.total, 0x5851F42D4C957F2D, np.uint64)
        word[at] = w.hash
        # contexts restart with each text
        end_at = w.bounds[1:] + np.arange(docs)
        first = np.append(0, end_at[:-1] + 1) if docs else np.zeros(0, np.int64)
        one = np.roll(word, 1)
        one[first] = 1
        two = np.roll(one, 1)
        two[first] = 2
        self.features = [mix(x) for x in (one * np.uint64(3), two * np.uint64(5) + np.uint64(1), one * np.uint64(0x9E3779B97F4A7C15) + two)]


class Model:
    """Class and part of every form; biases and weights of both softmaxes."""

    def __init__(self, top: np.ndarray, sub: np.ndarray, leaf_tokens: np.ndarray, bits: int):
        self.top, self.sub, self.bits = top, sub, bits
        n = leaf_tokens.reshape(CLASSES, SUBCLASSES)
        self.bias = np.log((n.sum(1) + 1) / (n.sum() + CLASSES)).astype(np.float32)
        self.inner_bias = np.log((n + 1) / (n.sum(1, keepdims=True) + SUBCLASSES)).astype(np.float32)
        self.weights = np.zeros((1 << bits, CLASSES), np.float32)
        self.inner = np.zeros((1 << bits, SUBCLASSES), np.float32)

    def leaf(self, form: np.ndarray) -> np.ndarray:
        return self.top[form] * SUBCLASSES + self.sub[form]

    def _levels(self, s: Stream, part: slice):
        """Weights, biases, feature rows and what is right, of both levels; rows fit 16 bits, which sort fast."""
        mask = np.uint64((1 << self.bits) - 1)
        c, k = self.top[s.form[part]], self.sub[s.form[part]]
        yield self.weights, self.bias, [(f[part] & mask).astype(np.uint16) for f in s.features], c
        salt = c.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        yield self.inner, self.inner_bias[c], [(mix(f[part] + salt) & mask).astype(np.uint16) for f in s.features], k

    def log_prob(self, s: Stream) -> np.ndarray:
        """Natural logarithm of the probability of each token's class and part."""
        out = np.zeros(s.total)
        for i in range(0, s.total, STEP_TOKENS):
            part = slice(i, i + STEP_TOKENS)
            for weights, bias, rows, right in self._levels(s, part):
                z = weights[rows[0]] + weights[rows[1]] + weights[rows[2]] + bias
                z -= z.max(1, keepdims=True)
                out[part] += z[np.arange(len(z)), right] - np.log(np.exp(z).sum(1))
        return out

    def learn(self, s: Stream, seen: np.ndarray) -> None:
        """Gradient steps over the tokens; `seen` counts how often a row of each level was used."""
        for i in range(0, s.total, STEP_TOKENS):
            for level, (weights, bias, rows, right) in enumerate(self._levels(s, slice(i, i + STEP_TOKENS))):
                z = weights[rows[0]] + weights[rows[1]] + weights[rows[2]] + bias
                z -= z.max(1, keepdims=True)
                np.exp(z, out=z)
                z /= -z.sum(1, keepdims=True)
                z[np.arange(len(z)), right] += 1
                for r in rows:
                    order = np.argsort(r, kind="stable")
                    r = r[order]
                    at = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                    n = np.diff(np.append(at, len(r)))
                    weights[r[at]] += np.add.reduceat(z[order], at, axis=0) * (RATE / (n + DAMP)).astype(np.float32)[:, None]
                    seen[r[at], level] += n


def k_means(x: np.ndarray, mass: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Cluster of each row; centres start at heavy rows that lie far apart."""
    centres = [x[mass.argmax()]]
    apart = ((x - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        centres.append(x[(apart * mass).argmax()])
        apart = np.minimum(apart, ((x - centres[-1]) ** 2).sum(1))
    centres = np.array(centres)
    for _ in range(rounds):
        found = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        for j in np.unique(found):
            mine = found == j
            centres[j] = (x[mine] * mass[mine, None]).sum(0) / mass[mine].sum()
    return found


def classes_of_forms(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and part of each form, from the counts of what stands next to it; the last form, a text's end, is a class alone."""
    near = near[:FORMS]
    n = near.sum(1)
    if not n.any():
        top = np.arange(FORMS) % (CLASSES - 1)
        return np.append(top, CLASSES - 1), np.zeros(FORMS + 1, np.int64)
    usual = near.sum(0) / n.sum()
    x = np.sqrt((near + 50 * usual) / (n + 50)[:, None]) - np.sqrt(usual)  # rare forms are drawn to the usual
    mass = np.sqrt(n) + 1e-3
    top, sub = k_means(x, mass, CLASSES - 1), np.zeros(FORMS, np.int64)
    for j in range(CLASSES - 1):
        mine = np.flatnonzero(top == j)
        sub[mine] = k_means(x[mine], mass[mine], SUBCLASSES) if len(mine) > SUBCLASSES else np.arange(len(mine))
    return np.append(top, CLASSES - 1), np.append(sub, 0)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of all tokens of the column `text`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            data, offsets = text_view(batch.column(0))
            raw = data.tobytes().lower()  # of bytes: A-Z only
            for i in range(batch.num_rows):
                counts.update(raw[offsets[i] : offsets[i + 1]].split())
                if len(counts) > COUNT_WORDS:
                    yield out()
                    counts.clear()
            counts[END] += batch.num_rows
        if counts:
            yield out()

    return docs.select("text").mapInArrow(work, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


_SUMS = "block int, salt int, total binary"


def pieces(values: np.ndarray, salt: int) -> pa.RecordBatch:
    """An array cut along its first axis to BLOCKS rows."""
    cut = np.array_split(values.astype(np.float32), BLOCKS)
    return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([salt % 16] * BLOCKS, pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], ["block", "salt", "total"])


def added(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of the arrays that tasks made with `pieces`; each block is summed in 16 tasks first, BLOCKS rows come to the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a block, of all the rows that stream by; holds one block of sums for each block it meets."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(2)):
                x = np.frombuffer(x.as_py(), np.float32)
                if b in total:
                    total[b] += x
                else:
                    total[b] = x.astype(float)
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([0] * len(keys), pa.int32()), pa.array([total[b].astype(np.float32).tobytes() for b in keys], pa.binary())], ["block", "salt", "total"])

    tasks = max(2, min(BLOCKS, partitions(parts.sparkSession)))
    found = parts.repartition(tasks, "block", "salt").mapInArrow(summed, _SUMS).repartition(tasks, "block").mapInArrow(summed, _SUMS).collect()
    return np.concatenate([np.frombuffer(r.total, np.float32).astype(float).reshape(-1, width) for r in sorted(found, key=lambda r: r.block)]) if found else np.zeros((0, width))


def neighbours(docs: DataFrame) -> np.ndarray:
    """For each form (a text's end last) how often hashed forms stand next to it, over all rows of the column `text`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, salt = np.zeros((FORMS + 1) * NEAR, np.int64), 0
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            salt = salt * 31 + len(data)
            for i, j in chunks(offsets, TOKENS_CHUNK):
                f = Stream(data, offsets[i : j + 1], features=False).form
                for one, other in ((f[:-1], f[1:]), (f[1:], f[:-1])):
                    counts += np.bincount(one * NEAR + other % NEAR, minlength=len(counts))
        if counts.any():
            yield pieces(counts.reshape(-1, NEAR), salt)

    found = added(docs.select("text").mapInArrow(work, _SUMS), NEAR)
    return found if len(found) else np.zeros((FORMS + 1, NEAR))


def leaf_totals(vocabulary: DataFrame, top: np.ndarray, sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct words of each part: LEAVES rows at most come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, distinct = np.zeros(LEAVES, np.int64), np.zeros(LEAVES, np.int64)
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            c = batch.column(1).to_numpy(zero_copy_only=False)
            form = forms(data, offsets[:-1], offsets[1:]) if batch.num_rows else np.zeros(0, np.int64)
            form[(np.diff(offsets) == 1) & (data[offsets[:-1]] == END[0])] = FORMS
            leaf = top[form] * SUBCLASSES + sub[form]
            tokens += np.bincount(leaf, c, LEAVES).astype(np.int64)
            distinct += np.bincount(leaf, minlength=LEAVES)
        yield pa.RecordBatch.from_arrays([pa.array(range(LEAVES), pa.int64()), pa.array(tokens), pa.array(distinct)], ["k", "n", "v"])

    found = vocabulary.select("word", "c").mapInArrow(work, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(LEAVES), np.zeros(LEAVES)
    for r in found:
        n[r.k], v[r.k] = r.n, r.v
    return n, v


def train(docs: DataFrame, model: Model, epochs: int = EPOCHS) -> None:
    """Learns the weights of `model` in `epochs` rounds over the whole column `text`."""
    spark = docs.sparkSession
    for _ in range(epochs):
        shared = spark.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import copy

            start, own, salt = shared.value, copy.copy(shared.value), 0
            own.weights, own.inner = start.weights.copy(), start.inner.copy()
            seen = np.zeros((len(own.weights), 2), np.float32)
            for batch in batches:
                data, offsets = text_view(batch.column(0))
                salt = salt * 31 + len(data)
                for i, j in chunks(offsets, TOKENS_CHUNK):
                    own.learn(Stream(data, offsets[i : j + 1]), seen)
            if seen.any():
                yield pieces(np.hstack([(own.weights - start.weights) * seen[:, :1], (own.inner - start.inner) * seen[:, 1:], seen]), salt)

        found = added(docs.select("text").mapInArrow(learn, _SUMS), CLASSES + SUBCLASSES + 2)
        if len(found):
            model.weights += (found[:, :CLASSES] / np.maximum(found[:, -2:-1], 1)).astype(np.float32)
            model.inner += (found[:, CLASSES:-2] / np.maximum(found[:, -1:], 1)).astype(np.float32)
        shared.unpersist()


def trained(training: DataFrame, vocabulary: DataFrame, n_tokens: int, epochs: int = EPOCHS) -> tuple[Model, np.ndarray]:
    """The model, and log10 of each part's denominator, from the column `text` and its (word, c)."""
    top, sub = classes_of_forms(neighbours(training))
    tokens, distinct = leaf_totals(vocabulary, top, sub)
    model = Model(top, sub, tokens, min(MOST_BITS, max(LEAST_BITS, (n_tokens // TOKENS_PER_ROW).bit_length())))
    if n_tokens:
        train(training, model, epochs)
    return model, np.log10(tokens + distinct + 1)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held: int = 2, epochs: int = EPOCHS) -> DataFrame:
    """One row a document; learns from those whose crc32 of the id, modulo `modulus`, is not `held`.

    Returns the id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (this model), both
    as log10 probabilities of the whole text.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), (fold(id_col, modulus) == held).alias("held_out"))
    training = rows.filter(~F.col("held_out"))
    vocabulary = stored(count_words(training), "lm-words")
    n_total, n_distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model, denominator = trained(training, vocabulary, int(n_total), epochs)

    # the least count that at most HEAD words reach: from a histogram of counts in steps of a 32nd of a power of two
    steps = vocabulary.groupBy(F.floor(F.log2("c") * 32).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for r in steps:
        held += r.n
        if held > HEAD:
            break
        least = r.least
    frequent = F.col("c") >= least if least is not None else F.lit(False)
    head = vocabulary.filter(frequent).toArrow().to_pandas()
    raw = [w.encode() for w in head.word if w != END.decode()]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    hashes = Words(data, np.array([0, len(data)])).hash
    order = np.argsort(hashes)
    counts = head.c[head.word != END.decode()].to_numpy(np.int64)
    end_count = int(vocabulary.filter(F.col("word") == END.decode()).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    shared = spark.sparkContext.broadcast((model, denominator, hashes[order], counts[order]))
    base_denominator = float(np.log10(n_total + n_distinct + 1))

    id_type = rows.schema[0].dataType.simpleString()
    fields = f"row_key string, `{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, head double, base_minus double, model double, tail array<struct<word:string,n:int>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, denominator, known, c = shared.value
        tail_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            for i, j in chunks(offsets, TOKENS_CHUNK):
                s = Stream(data, offsets[i : j + 1])
                docs = j - i
                above = np.bincount(s.doc, model.log_prob(s), docs) / np.log(10) - np.bincount(s.doc, denominator[model.leaf(s.form)], docs)
                w = s.words
                place = np.minimum(np.searchsorted(known, w.hash), max(len(known) - 1, 0))
                hit = known[place] == w.hash if len(known) else np.zeros(len(w.hash), bool)
                owner = w.owner
                head = np.bincount(owner[hit], np.log10(c[place[hit]] + 1.0), docs) + np.log10(end_count + 1.0)
                n_known = np.bincount(owner[hit], minlength=docs) + (end_count > 0)
                lists: list[list] = [[] for _ in range(docs)]
                missing: dict[int, Counter] = {}
                for k in np.flatnonzero(~hit).tolist():
                    missing.setdefault(int(owner[k]), Counter())[w.word(k)] += 1
                for d, words in missing.items():
                    lists[d] = [{"word": x.decode(), "n": n} for x, n in words.items()]
                n = w.counts + 1
                columns = [pa.array([f"{task}-{serial + x}" for x in range(docs)], pa.string()), batch.column(0).slice(i, docs), batch.column(2).slice(i, docs)]
                serial += docs
                columns += [pa.array(x) for x in (n.astype(np.int64), n_known.astype(np.int64), head, n * base_denominator, above)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, tail_type)], ["row_key", id_col, "held_out", "n_tokens", "n_known", "head", "base_minus", "model", "tail"])

    # a row's key says which task made it and must not change when a lost task runs anew: hence written before it is used twice
    local = stored(rows.select(id_col, "text", "held_out").mapInArrow(work, fields), "lm-local")
    rare = vocabulary.filter(~frequent)
    tails = local.select("row_key", F.explode("tail").alias("t")).select("row_key", "t.word", "t.n")
    found = tails.join(rare, "word").groupBy("row_key").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare"), F.sum("n").alias("rare_known"))
    both = local.drop("tail").join(found, "row_key", "left").withColumn("logs", F.col("head") + F.coalesce("rare", F.lit(0.0)))
    return both.select(
        id_col, "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(n_total)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("base_minus")).alias("base_score"), (F.col("logs") + F.col("model")).alias("score"),
    )
