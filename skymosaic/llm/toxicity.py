"""Toxicity of texts behind a noisy channel of disguises.

Words that look disguised (symbols or digits among letters, letters held three times or longer, single letters spaced out)
are decoded: their characters span a lattice in which a symbol may stand for a letter, a separator or a held letter may be
dropped, each at a cost, and Viterbi picks the path that costs least under a character trigram model. In a run of spaced
letters each gap may also end a word, cheaper where it is wider than the run's narrowest, and a word that is frequent in
plain texts costs what its frequency says where that is less. Texts are then scored on the restored words. Words of any length are decoded: letters held in long ones are shortened first, and the path is settled
window by window.

Learning reads every labelled row of the training fold: character trigrams of their plain words, and for each word and for
each opening of PREFIXES letters the number of toxic and of other documents that hold it. Only features whose smoothed
share of toxic documents reaches `least` are kept, and every part of the model must occur in SUPPORT documents; so it
grows with the vocabulary, not with the rows.
A text's score is a noisy-or of its features' shares.

Cases: null and empty texts, and texts without features, get the score of the background; repeated words count once;
texts are read whole; without labelled toxic rows every score is 0; documents labelled twice count once for each label;
a null id hashes as the text 'null' and has no label; an empty table gives an empty table; columns other than id, text and
the labels' id and label are not read, and may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import fold, ship

#: Labelled rows (16 bytes each) up to which their ids are broadcast, so that no text is shuffled; beyond it they are joined.
BROADCAST = 1_000_000
#: Documents that must hold a feature, a word or a trigram, and distinct features that a task counts before it sends them on.
SUPPORT = 4
COUNT_FEATURES = 300_000
#: Words whose features a worker remembers; beyond it the memory starts afresh.
CACHE_WORDS = 300_000
#: Openings of words used as features besides whole words.
PREFIXES = (4, 5, 6)
#: Held letters of longer words are shortened before they are decoded.
LONGEST_WORD = 64
#: Documents at the background share that are added to a feature's own: openings are many, so chance finds more of them.
DOUBT = {"w": 2, "p": 10}
#: Least share of an opening; words that are clean may begin alike.
LEAST_OPENING = 0.9

#: What a symbol may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "{": "c", "<": "c", "€": "e", "£": "l", "ß": "ß"}
COST_STAND, COST_DROP, COST_LOSE, COST_HELD, COST_KEEP = 1.0, 0.5, 3.0, 0.4, 8.0
#: A word's end at a gap as narrow as those between letters, and the paths that a run of them keeps.
COST_BREAK, BEAM = 0.5, 32
#: Viterbi settles all but the last LAG letters of the best path every WINDOW characters.
WINDOW, LAG = 256, 64

_HEAD = re.compile(r"[^\w@$+|(<{€£]+")
_ODD = re.compile(r"[\W\d_]|([^\W\d_])\1\1")
#: Letters (or what stands for them) and the gaps between share no character, so a run is read in one way, in linear time.
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\W_]|[@$!|+])(?:[ ._\-*]{1,3}(?:[^\W_]|[@$!|+])){3,}")
_LETTER_GAP = re.compile(r"([^\W_]|[@$!|+])([ ._\-*]*)")
_HELD = re.compile(r"(.)\1{3,}")


def edged(word: str) -> str:
    """`word` without what stands before and behind its letters."""
    m = _HEAD.match(word)
    begin, end = m.end() if m else 0, len(word)
    while end > begin and not word[end - 1].isalnum():
        end -= 1
    return word[begin:end]


def spaced_runs(text: str) -> Iterator[str]:
    """Runs of four and more spaced letters, each cut back to the last one that a space, an end or a mark follows."""
    for m in _SPACED.finditer(text):
        begin, end = m.span()
        while end > begin and not (end == len(text) or text[end].isspace() or text[end] in ".,;:!?"):
            end -= 1
            while end > begin and text[end - 1] in " ._-*":
                end -= 1
        run = text[begin:end]
        if _SPACED.fullmatch(run):
            yield run


class Characters:
    """Trigram model of the letters of words, with additive smoothing over `size` letters; and what frequent words cost."""

    def __init__(self, three: dict[str, int], words: dict[str, int] | None = None):
        self.three = three
        total = sum((words or {}).values())
        self.words = {w: -math.log(n / total) for w, n in (words or {}).items()}
        self.two: Counter = Counter()
        for k, n in three.items():
            self.two[k[:2]] += n
        self.size = max(30, len({k[2] for k in three}))
        self.memo: dict[str, float] = {}

    def cost(self, context: str, letter: str) -> float:
        k = context + letter
        found = self.memo.get(k)
        if found is None:
            found = self.memo[k] = -math.log((self.three.get(k, 0) + 0.05) / (self.two.get(context, 0) + 0.05 * self.size))
        return found


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each character what it may be ('' for nothing) and at what cost."""
    for i, c in enumerate(token):
        if c.isalpha():
            options = [(c, 0.0)] + [(x, COST_STAND) for x in STANDS_FOR.get(c, "") if x != c]
            if i and token[i - 1] == c:
                options.append(("", COST_HELD))
        else:
            options = [(x, COST_STAND) for x in STANDS_FOR.get(c, "")]
            options.append(("", COST_HELD if i and token[i - 1] == c else COST_LOSE if options else COST_DROP))
            if c.isdigit():
                options.append((c, COST_KEEP))
        yield options


def viterbi(token: str, model: Characters) -> str:
    """The letters that most likely lie behind `token`."""
    best: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    settled = ""
    for i, options in enumerate(lattice(token)):
        after: dict[str, tuple[float, str]] = {}
        for context, (cost, text) in best.items():
            for letter, extra in options:
                total = cost + extra + (model.cost(context, letter) if letter else 0.0)
                key = (context + letter)[-2:]
                if key not in after or (total, text + letter) < after[key]:
                    after[key] = (total, text + letter)
        best = after
        if i % WINDOW == WINDOW - 1:
            text = min(best.values())[1]
            sure = text[: max(0, len(text) - LAG)]
            settled += sure
            best = {context: (cost, text[len(sure) :]) for context, (cost, text) in best.items() if text.startswith(sure)}
    return settled + min((cost + model.cost(context, "$"), text) for context, (cost, text) in best.items())[1]


def parted(letters: str, gaps: list[tuple[float, float]], model: Characters) -> list[str]:
    """The words that most likely lie behind spaced letters; gaps: for each letter what it costs to end a word behind it, and not to.

    A path is known by where its word began and its last letters, so that a word that ends can be looked up.
    """
    paths: dict[tuple[int, str], tuple[float, float, str]] = {(0, "^^"): (0.0, 0.0, "")}  # cost, the part of the word's letters, text
    settled: list[str] = []

    def ended(context: str, cost: float, own: float, text: str) -> float:
        end = model.cost(context, "$")
        return cost + min(end, model.words.get(text[text.rfind(" ") + 1 :], math.inf) - own)

    for i, options in enumerate(lattice(letters)):
        after: dict[tuple[int, str], tuple[float, float, str]] = {}
        for (start, context), (cost, own, text) in paths.items():
            for letter, extra in options:
                more = model.cost(context, letter) if letter else 0.0
                key, path = (start, (context + letter)[-2:]), (cost + extra + more, own + more, text + letter)
                if key not in after or path < after[key]:
                    after[key] = path
        if i < len(letters) - 1:
            ends, glues = gaps[i]
            over = [(ended(key[1], *path) + ends, 0.0, path[2] + " ") for key, path in after.items() if key[1] != "^^"]
            after = {key: (cost + glues, own, text) for key, (cost, own, text) in after.items()}
            if over:
                after[i + 1, "^^"] = min(over)
        paths = dict(sorted(after.items(), key=lambda x: x[1])[:BEAM])
        if i % WINDOW == WINDOW - 1:
            text = min(paths.values())[2]
            cut = text.rfind(" ", 0, max(0, len(text) - LAG)) + 1 or max(0, len(text) - 2 * LAG)
            settled.append(text[:cut])
            paths = {key: (cost, own, text[cut:]) for key, (cost, own, text) in paths.items() if text.startswith(settled[-1])}
    best = min((ended(key[1], *path), path[2]) for key, path in paths.items())[1]
    return "".join([*settled, best]).split()


def spaced(run: str, model: Characters) -> list[str]:
    """The words behind a run of spaced letters: of all of them glued, and of those that its gaps part."""
    found = _LETTER_GAP.findall(run.rstrip(" .,;:!?"))
    narrow = min((len(gap) for _, gap in found[:-1]), default=0)
    gaps = [(COST_BREAK, 0.0) if len(gap) <= narrow else (0.0, COST_LOSE) for _, gap in found]
    glued = restored("".join(c for c, _ in _LETTER_GAP.findall(run)), model)
    return list(dict.fromkeys(glued + parted("".join(c for c, _ in found), gaps, model)))


def restored(word: str, model: Characters) -> list[str]:
    """The plain words behind a lower-case word: itself without edges, or decoded where it looks disguised."""
    plain = edged(word)
    if not _ODD.search(word):
        return [plain]
    if _SPACED.fullmatch(word):
        return spaced(word, model)
    if len(word) > LONGEST_WORD:
        word = _HELD.sub(r"\1\1\1", word)
        plain = edged(word)
    if len(word) > LONGEST_WORD:  # a blob: decoded whole, and each of its parts
        parts = [x for x in re.split(r"[\W_]+", word) if x]
        return [viterbi(plain, model)] + ([x for part in parts for x in restored(part, model)] if len(parts) > 1 else [])
    if not _ODD.search(plain):
        whole = [plain]
        if any(c in STANDS_FOR for c in word.rstrip(".,;:!?\"')")):
            whole.append(viterbi(word.rstrip(".,;:!?\"')"), model))
        return whole
    parts = [x for x in re.split(r"[\W_]+", plain) if len(x) > 2 and x.isalpha()]
    found = [viterbi(plain, model)]
    for x in parts:  # words that are merely joined
        found.append(x if not _ODD.search(x) else viterbi(x, model))
    return found


def features(word: str) -> list[str]:
    return [f"w:{word}"] + [f"p:{word[:k]}" for k in PREFIXES if len(word) >= k]


def words_of(text: str) -> set[str]:
    text = text.lower()
    found = set(text.split())
    found.update(spaced_runs(text))
    return found


def plain_counts(word: str) -> list[str]:
    """What a plain word counts for: itself and its trigrams; nothing for others."""
    if not word.isalpha() or _ODD.search(word):
        return []
    framed = f"^^{word}$"
    return [f"w:{word}", *[framed[i : i + 3] for i in range(len(framed) - 2)]]


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int, held: int, most: int = BROADCAST) -> DataFrame:
    """Texts and labels of all labelled rows of the training fold.

    Up to `most` ids are broadcast. Beyond that texts are shuffled, once: what is joined is written, as learning reads it twice.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).filter("__id is not null and __label is not null").filter(fold("__id", modulus) != held).distinct()
    few = known.count() <= most
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    if few:
        return texts.join(F.broadcast(known), "__id").select("__text", "__label")
    return checkpointed(texts.filter(fold("__id", modulus) != held).join(known, "__id").select("__text", "__label"))


def learn(rows: DataFrame, least: float = 0.6, support: int = SUPPORT) -> tuple[dict[str, float], tuple[dict[str, int], dict[str, int]], float]:
    """Shares of kept features, character trigrams and frequent words, and the background share, from (text, label) rows."""

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        memo: dict[str, list[str]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["k", "n"])

        for batch in batches:
            for t in batch.column(0):
                for w in set((t.as_py() or "").lower().split()):
                    told = memo.get(w)
                    if told is None:
                        if len(memo) >= CACHE_WORDS:
                            memo.clear()
                        told = memo[w] = plain_counts(edged(w))
                    for k in told:
                        counts[k] += 1
                if len(counts) > COUNT_FEATURES:
                    yield out()
                    counts.clear()
        yield out()

    found = rows.mapInArrow(trigrams, "k string, n long").groupBy("k").agg(F.sum("n").alias("n"))
    kinds = F.col("k").startswith("w:")  # no trigram of letters holds a colon
    found = {r.k: r.n for r in found.filter(~kinds | (F.col("n") >= support)).collect()}
    letters = {k: n for k, n in found.items() if k[1] != ":"}, {k[2:]: n for k, n in found.items() if k[1] == ":"}
    shared = rows.sparkSession.sparkContext.broadcast(letters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Characters(*shared.value)
        toxic: Counter = Counter()
        clean: Counter = Counter()
        memo: dict[str, list[str]] = {}

        def told(w: str) -> list[str]:
            found = memo.get(w)
            if found is None:
                if len(memo) >= CACHE_WORDS:
                    memo.clear()
                found = memo[w] = [f for x in restored(w, model) if x for f in features(x)]
            return found

        def out():
            keys = list(toxic.keys() | clean.keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["k", "a", "b"])

        for batch in batches:
            for t, label in zip(batch.column(0), batch.column(1)):
                found = {f for w in words_of(t.as_py() or "") for f in told(w)}
                found.add("all")
                (toxic if label.as_py() else clean).update(found)
                if len(toxic) + len(clean) > COUNT_FEATURES:
                    yield out()
                    toxic.clear(), clean.clear()
        yield out()

    counts = rows.mapInArrow(count, "k string, a long, b long").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # beside the total, only features that toxic documents hold can pass
    kept = counts.filter((F.col("k") == "all") | ((F.col("a") >= support) & (F.col("a") >= least * (F.col("a") + F.col("b")))))
    found = kept.collect()
    total = next((r for r in found if r.k == "all"), None)
    if total is None or not total.a:
        return {}, letters, 0.0
    prior = total.a / (total.a + total.b)
    shares = {r.k: (r.a + DOUBT[r.k[0]] * prior) / (r.a + r.b + DOUBT[r.k[0]]) for r in found if r.k != "all"}
    return {k: p for k, p in shares.items() if p >= (least if k[0] == "w" else LEAST_OPENING)}, letters, prior


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """One row a document: id, held_out, score, predicted, and `restored`, the restored words that speak for toxicity."""
    spark = docs.sparkSession
    ship(spark)
    shares, letters, prior = learn(labelled_rows(docs, labels, id_col, text_col, label_col, modulus, held))
    shared = spark.sparkContext.broadcast((shares, letters))
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    background = prior * 0.1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, letters = shared.value
        model = Characters(*letters)
        memo: dict[str, tuple] = {}
        for batch in batches:
            scores, spoke = [], []
            for t in batch.column(1):
                apart, why = 1.0, []
                # what words share (an opening, a disguise) speaks once; sorted, so that products agree between runs
                told: dict[str, float] = {}
                for w in words_of(t.as_py() or ""):
                    found = memo.get(w)
                    if found is None:
                        if len(memo) >= CACHE_WORDS:
                            memo.clear()
                        found = ()
                        for x in restored(w, model):
                            if x and (known := [shares[f] for f in features(x) if f in shares]):
                                found += ((x, max(known)),)
                        memo[w] = found
                    for x, p in found:
                        told[x] = p
                for x in sorted(told):
                    apart *= 1 - told[x]
                    why.append(x)
                scores.append(max(background, 1 - apart) if why else background)
                spoke.append(why)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spoke, pa.list_(pa.string()))], [id_col, "score", "restored"])

    id_type = rows.schema[0].dataType.simpleString()
    scored = rows.mapInArrow(work, f"`{id_col}` {id_type}, score double, restored array<string>")
    return scored.select(id_col, (fold(id_col, modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "restored")
