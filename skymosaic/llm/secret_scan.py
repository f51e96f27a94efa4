"""Secret scan: patterns of known kinds, and strings in sensitive context that a primed compressor cannot explain.

Three kinds come from patterns: `assign` (a value given to something called password, secret, token or key), `access` (access
key ids) and `hex` (long runs of hexadecimal digits). The fourth, `novel`, comes from compression: a candidate is a run of 16
or more letters, digits and `+/_-` that holds both letters and digits and stands shortly behind a sensitive word. It is measured
by its marginal bytes: zstandard, primed with a dictionary of identifiers, compresses the text around the candidate without
and with it. Names, paths and repeated strings cost a few bytes; what costs most of its length is reported, unless a pattern
has found it already.

The dictionary holds words of code and those parts of long identifiers that most different identifiers of the whole corpus
share, `dictionary_bytes` at most; copies of a document count once, so a copied secret does not enter it.

Cases: a null text is the empty text and holds nothing; texts of any length are read whole; equal texts give equal values,
and of findings that start together the kinds come in the order above; repeated rows are repeated; an empty table gives
an empty table; other columns are not read. Places are code points, ends exclusive; characters outside ASCII belong to no kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _LOWER, Words, chunks, ship, text_view

KINDS = ("assign", "access", "hex", "novel")
#: On lower-cased text; the second group must have LEAST_VALUE bytes, but a shorter one uses up its place all the same.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

SENSITIVE = re.compile(rb"pass|pwd|secret|token|key|auth|cred|bearer|private|signature|salt")
#: LONGEST bounds the identifiers that the dictionary is made of, not what is reported.
SHORTEST, LONGEST = 16, 256
#: Bytes before a candidate that are searched for a sensitive word, and bytes around it that prime the compressor.
NEAR, BEFORE, AFTER = 48, 256, 128
#: Of a candidate's bytes, the share that it must cost.
LEAST_COST = 0.7
PARTS = "[A-Z]?[a-z]{3,23}|[A-Z]{4,24}"
CODE_WORDS = (
    "access account address admin application argument array async await backend boolean bucket buffer bytes callback catch bin "
    "certificate class client column config connect const context count create credential data database debug default delete "
    "description development document domain email enable encode endpoint environment error event example exception export "
    "false field filename filter final float format from function handler hash header host http https identifier import index "
    "input instance integer interface json key label length level lib library list load local login manager message method model "
    "module name null number object option output package parameter password path pattern port prefix private process product "
    "production property protocol public query queue read record request resource response result return schema secret select "
    "self server service session settings share signature size source src start state static status string struct table target "
    "task temp template test text thread time token true type update upload user username usr value variable version void write"
)


def _bytes_of(kept: bytes) -> np.ndarray:
    """Which bytes part runs of `kept`."""
    table = np.ones(256, bool)
    table[list(kept)] = False
    return table


_UPPER, _SMALL, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_NOT_HEX = _bytes_of(_DIGITS + b"abcdef")
_NOT_NAME = _bytes_of(_UPPER + _SMALL + _DIGITS + b"+/_-")
_NOT_LETTER, _NOT_DIGIT = _bytes_of(_UPPER + _SMALL), _bytes_of(_DIGITS)


def _holders(text: bytes, needles: tuple[bytes, ...], offsets: np.ndarray) -> np.ndarray:
    """Documents of `text` (from offsets[k] to offsets[k+1]) in which a needle begins."""
    at = []
    for needle in needles:
        place = text.find(needle)
        while place >= 0:
            at.append(place)
            place = text.find(needle, place + 1)
    return np.unique(np.searchsorted(offsets, at, "right") - 1) if at else np.zeros(0, np.int64)


def _runs(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray, least: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of the runs of bytes that do not part, by their length."""
    words = Words(data, offsets, hashes=False, space=parting)
    size = words.end - words.start
    kept = np.flatnonzero((size >= least) & (size <= (most or len(data))))
    return np.searchsorted(words.doc_offsets, words.start[kept], "right") - 1, words.start[kept], words.end[kept]


def patterns(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By document: (begin, kind, end) in bytes of the text `data`, whose documents end at `offsets`."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    low, raw = _LOWER[data].tobytes(), data.tobytes()
    for d in _holders(low, ASSIGN_WORDS, offsets):
        for m in ASSIGN.finditer(low, int(offsets[d]), int(offsets[d + 1])):
            if len(m[2]) >= LEAST_VALUE:
                found.setdefault(int(d), []).append((m.start(), 0, m.end()))
    for d in _holders(raw, (b"AKIA",), offsets):
        for m in ACCESS.finditer(raw, int(offsets[d]), int(offsets[d + 1])):
            if len(m[0]) >= LEAST_ACCESS:
                found.setdefault(int(d), []).append((m.start(), 1, m.end()))
    for d, begin, end in zip(*_runs(data, offsets, _NOT_HEX, LEAST_HEX)):
        found.setdefault(int(d), []).append((int(begin), 2, int(end)))
    return found


def candidates(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, begin, end) of runs of letters and digits, both, that stand behind a sensitive word."""
    owner, begin, end = _runs(data, offsets, _NOT_NAME, SHORTEST)
    counts = [np.concatenate([[0], np.cumsum(~parting[data])]) for parting in (_NOT_LETTER, _NOT_DIGIT)]
    mixed = np.logical_and(*(c[end] > c[begin] for c in counts))
    for d, b, e in zip(owner[mixed].tolist(), begin[mixed].tolist(), end[mixed].tolist()):
        if SENSITIVE.search(_LOWER[data[max(int(offsets[d]), b - NEAR) : b]].tobytes()):
            yield d, b, e


class Novelty:
    """Marginal bytes of strings for zstandard primed with a dictionary."""

    def __init__(self, dictionary: bytes, level: int = 9):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False)

    def cost(self, around: bytes, candidate: bytes) -> int:
        return len(self.compressor.compress(around + candidate)) - len(self.compressor.compress(around))


def identifiers(docs: DataFrame, text_col: str = "text", dictionary_bytes: int = 1 << 15) -> bytes:
    """The dictionary: parts that most different long identifiers of the corpus share, the commonest last, then words of code."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("run", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(0))
            for i, j in chunks(offsets):
                base = offsets[i]
                text = data[base : offsets[j]]
                _, begin, end = _runs(text, offsets[i : j + 1] - base, _NOT_NAME, SHORTEST, LONGEST)
                runs = {text[b:e].tobytes().decode() for b, e in zip(begin, end)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(runs), pa.string())], schema.names)

    runs = docs.select(F.col(text_col).cast("string")).mapInArrow(work, schema).distinct()
    parts = runs.select(F.explode(F.array_distinct(F.expr(f"regexp_extract_all(run, '{PARTS}', 0)"))).alias("part"))
    shared = parts.groupBy("part").count().filter("count >= 3").orderBy(F.desc("count"), "part").limit(dictionary_bytes // 4)
    size, kept = 0, []
    for row in shared.collect():
        size += len(row.part) + 1
        if size > dictionary_bytes:
            break
        kept.append(row.part)
    return " ".join([*reversed(kept), CODE_WORDS]).encode()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: bytes | None = None, least_cost: float = LEAST_COST) -> DataFrame:
    """`id_col` and `findings` (kind, start, end, value, and for `novel` its marginal bytes `cost`) of every document, by start."""
    dictionary = identifiers(docs, text_col) if dictionary is None else dictionary
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    finding = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("cost", pa.int32())])
    told = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType()), T.StructField("cost", T.IntegerType())]))
    schema = T.StructType([rows.schema[0], T.StructField("findings", told)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            for i, j in chunks(offsets):
                bounds = offsets[i : j + 1] - offsets[i]
                text = data[offsets[i] : offsets[j]]
                found = {d: [(*x, None) for x in known] for d, known in patterns(text, bounds).items()}
                for d, b, e in candidates(text, bounds):
                    first, last = int(bounds[d]), int(bounds[d + 1])
                    if any(x[0] < e and b < x[2] for x in found.get(d, ()) if x[1] < 3):
                        continue
                    around = text[max(first, b - BEFORE) : b].tobytes() + text[e : min(last, e + AFTER)].tobytes()
                    cost = novelty.cost(around, text[b:e].tobytes())
                    if cost >= least_cost * (e - b):
                        found.setdefault(d, []).append((b, 3, e, cost))
                out: list[list[dict]] = [[] for _ in range(j - i)]
                for d, spans in found.items():
                    first = int(bounds[d])
                    own = text[first : int(bounds[d + 1])]
                    points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    out[d] = [{"kind": KINDS[k], "start": int(points[b - first]), "end": int(points[e - first]), "value": own[b - first : e - first].tobytes().decode(), "cost": cost} for b, k, e, cost in sorted(spans, key=lambda x: x[:3])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out, pa.list_(finding))], schema.names)

    return rows.mapInArrow(work, schema)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the kinds that patterns find, the hash of their places, and the places of all findings."""
    told = lambda found: F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    base = told(F.filter("findings", lambda x: x["kind"] != "novel"))
    return scanned.select(id_col, *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), told(F.col("findings")).alias("spans"))
