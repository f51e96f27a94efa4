"""One-to-one matching of predictions with truth, and the scores made from it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import area, is_simple
from ..session import checkpointed
from ..sources.geojson import collections

EPSILON = 1e-9


def greedy_match(pairs: DataFrame, keys: list[str], threshold: float = 0.5, most: int = 1_000_000) -> DataFrame:
    """(keys, truth_id, pred_id, iou): truths in the order of their ids take the best prediction that is free; of equal ones the least id."""
    found = match_in_turn(pairs.withColumn("turn", F.struct("truth_id")), keys, "truth_id", "pred_id", [threshold], most)
    return found.select(*keys, "truth_id", "pred_id", "iou")


def match_by_confidence(pairs: DataFrame, keys: list[str], thresholds: list[float], most: int = 1_000_000) -> DataFrame:
    """(keys, threshold, truth_id, pred_id, iou): at each threshold, predictions in falling confidence take the best truth that is free.

    pairs: keys, truth_id, pred_id, conf, iou. Predictions of equal confidence go by id; a null confidence comes last.
    """
    turn = F.struct((-F.coalesce("conf", F.lit(float("-inf")))).alias("c"), F.col("pred_id").alias("i"))
    found = match_in_turn(pairs.withColumn("turn", turn), keys, "pred_id", "truth_id", thresholds, most)
    return found.select(*keys, "threshold", "truth_id", "pred_id", "iou")


def match_in_turn(pairs: DataFrame, keys: list[str], chooser: str, chosen: str, thresholds: list[float], most: int = 1_000_000) -> DataFrame:
    """(keys, threshold, chooser, chosen, iou): in the order of `turn`, each chooser takes the best of what is free and reaches the threshold.

    Groups of equal keys with `most` pairs at most are sorted by Spark and streamed, all thresholds in one pass; what is
    held is what a group's choosers have taken. Larger groups are worked in rounds, so no group has to fit a task.
    Pairs may repeat; null ids match nothing.
    """
    if min(thresholds) <= 0:
        raise ValueError("thresholds must be above 0")
    useful = pairs.select(*keys, chooser, chosen, "turn", "iou").filter(F.col("iou") >= min(thresholds)).dropna(subset=[chooser, chosen])
    useful = checkpointed(useful)
    sizes = useful.groupBy(*keys).count().filter(F.col("count") > most)
    large = checkpointed(sizes.select(*keys))
    if not large.limit(1).count():
        return _streamed(useful, keys, chooser, chosen, thresholds)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    small, rest = useful.join(large, same(useful, large), "left_anti"), useful.join(large, same(useful, large), "left_semi")
    grid = F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("iou") >= t))
    return _streamed(small, keys, chooser, chosen, thresholds).unionByName(_in_rounds(rest.withColumn("threshold", grid), [*keys, "threshold"], chooser, chosen))


def _streamed(pairs: DataFrame, keys: list[str], chooser: str, chosen: str, thresholds: list[float]) -> DataFrame:
    n = len(keys)
    steps = sorted(float(t) for t in thresholds)
    columns = [*keys, chooser, chosen, "iou"]
    dealt = pairs.repartition(*keys).sortWithinPartitions(*keys, "turn", F.desc("iou"), chosen).select(*columns)
    schema = T.StructType([*dealt.schema.fields[: n + 2], T.StructField("iou", T.DoubleType()), T.StructField("threshold", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, turn = None, None
        taken: list[set] = []
        free: list[bool] = []
        for batch in batches:
            rows, at = [], []
            names = list(zip(*[c.to_pylist() for c in batch.columns[:n]])) if n else [()] * batch.num_rows
            for r, (name, one, other, iou) in enumerate(zip(names, *[c.to_pylist() for c in batch.columns[n:]])):
                if name != group:
                    group, turn, taken = name, None, [set() for _ in steps]
                if one != turn:
                    turn, free = one, [True] * len(steps)
                for k, least in enumerate(steps):
                    if iou < least:
                        break
                    if free[k] and other not in taken[k]:
                        taken[k].add(other)
                        free[k] = False
                        rows.append(r)
                        at.append(least)
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(at, pa.float64())], schema.names)

    return dealt.mapInArrow(work, schema).select(*keys, "threshold", chooser, chosen, "iou")


def _in_rounds(pairs: DataFrame, keys: list[str], chooser: str, chosen: str) -> DataFrame:
    """A chooser whose turn comes before that of every other one that wants any of what it wants can choose now, whatever else
    happens, so all such choose at once and what they take leaves. Rounds are as many as the longest chain of choosers that wait
    for one another, not as many as choosers."""
    left = checkpointed(pairs)
    done = None
    while True:
        first = F.min("turn").over(Window.partitionBy(*keys, chosen))
        ready = F.min((F.col("first") == F.col("turn")).cast("int")).over(Window.partitionBy(*keys, chooser))
        marked = left.withColumn("first", first).withColumn("ready", ready)
        best = F.row_number().over(Window.partitionBy(*keys, chooser).orderBy(F.desc("iou"), chosen))
        marked = checkpointed(marked.withColumn("best", F.when(F.col("ready") == 1, best)))
        took = marked.filter("ready = 1 and best = 1").select(*keys, chooser, chosen, "iou")
        done = took if done is None else done.unionByName(took)
        rest = marked.filter("ready = 0").select(*keys, chooser, chosen, "turn", "iou")
        if not rest.limit(1).count():
            return done
        gone = took.select(*[F.col(c).alias(f"__{c}") for c in (*keys, chosen)])
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, chosen)]
        left = checkpointed(rest.join(gone, same, "left_anti"))


def matchable(truth: DataFrame, points: str = "points") -> DataFrame:
    """Truths whose polygons are valid: simple rings that hold an area. Others take part in no match."""
    return truth.filter(is_simple(F.col(points)) & (area(F.col(points)) > 0))


def scores(tp: Column, total_truth: Column, total_pred: Column, fn: Column | None = None) -> dict[str, Column]:
    """Every score is 0 where its denominator is."""
    fn = total_truth - tp if fn is None else fn
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    p, r = ratio(tp, total_pred), ratio(tp, total_truth)
    return {"precision": p, "recall": r, "f1": F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)), "fnr": ratio(fn, fn + tp)}


def outcome_counts(truth: DataFrame, predictions: DataFrame, matches: DataFrame, label: str | None = None, valid: DataFrame | None = None) -> DataFrame:
    """tp, fn, fp, totals and scores: one row, or one a predicted label, each label against all of the truth.

    False positives are the predictions that are not matched. `valid`: the truths that `matchable` leaves; others are neither
    found nor missed, but in the total. Without any prediction all truths are missed.
    """
    group = [label] if label else []
    preds = predictions.groupBy(*group).agg(F.count("*").alias("total_pred"))
    hits = matches.groupBy(*group).agg(F.count("*").alias("tp"))
    total = truth.agg(F.count("*").alias("total_truth"))
    total = total.crossJoin(valid.agg(F.count("*").alias("n_valid"))) if valid is not None else total.withColumn("n_valid", F.col("total_truth"))  # a row each
    joined = preds.join(hits, group, "left") if group else preds.join(hits, F.lit(True), "left")
    joined = joined.join(F.broadcast(total), F.lit(True)).withColumn("tp", F.coalesce("tp", F.lit(0)))
    missed = F.when(F.col("total_pred") == 0, F.col("total_truth")).otherwise(F.col("n_valid") - F.col("tp"))
    out = joined.withColumns({"fn": missed, "fp": F.col("total_pred") - F.col("tp")}).drop("n_valid")
    return out.withColumns(scores(F.col("tp"), F.col("total_truth"), F.col("total_pred"), F.col("fn")))


def outcomes(truth: DataFrame, predictions: DataFrame, matches: DataFrame, keys: list[str], label: str | None = None) -> DataFrame:
    """(label, outcome, properties, points): truths found (TP) and missed (FN), predictions that match nothing (FP).

    truth: keys, truth_id, points, of valid polygons; predictions: keys, pred_id, points; with `label`, predictions and
    matches carry it, and every predicted label is held against all of the truth. Each truth is shuffled once, whatever the
    number of labels; the matches are written, as both sides read them.
    """
    labels = [label] if label else []
    truth, predictions = truth.select(*keys, "truth_id", "points"), predictions.select(*keys, *labels, "pred_id", "points")
    matches = checkpointed(matches.select(*keys, *labels, "truth_id", "pred_id"))
    hits = matches.groupBy(*keys, "truth_id").agg(F.collect_list(F.struct(*labels, "pred_id")).alias("hits"))
    held = truth.join(hits, [*keys, "truth_id"], "left").withColumn("hits", F.coalesce("hits", F.array()))
    if label:  # a few names, once for each truth; not shuffled any more
        held = held.crossJoin(F.broadcast(predictions.select(label).distinct())).withColumn("hits", F.filter("hits", lambda h: h[label] == F.col(label)))
    held = held.withColumn("pred_id", F.explode_outer(F.transform("hits", lambda h: h["pred_id"]))).withColumn("outcome", F.when(F.size("hits") > 0, "true_positives").otherwise("false_negatives")).drop("hits")
    fp = predictions.join(matches.select(*keys, *labels, "pred_id"), [*keys, *labels, "pred_id"], "left_anti").withColumns({"truth_id": F.lit(None).cast("string"), "outcome": F.lit("false_positives")})
    every = held.unionByName(fp)
    name = F.col(label) if label else F.lit("all")
    return every.select(name.alias("label"), "outcome", F.struct(*keys, "truth_id", "pred_id").alias("properties"), "points")


def outcomes_by_source(found: DataFrame, names: DataFrame, key: str, label: str) -> DataFrame:
    """(properties, points, collections): the same from the rows of `gathered.match_by_source`, without a shuffle. `names`: the labels of all predictions, a few.

    A row is a feature, `collections` an array of the (label, outcome) that it counts for: a truth is missed for many labels at once.
    """
    every = names.select(label).distinct().agg(F.collect_list(F.struct(label)).alias("names"))  # one row
    pred = found.schema["pred_id"].dataType.simpleString()
    entry = lambda name, what: F.struct(name.alias("label"), F.lit(what).alias("outcome"))
    feature = lambda i, held: F.struct(i.cast(pred).alias("pred_id"), held.alias("collections"))
    missed = F.filter("names", lambda n: ~F.exists("hits", lambda h: F.coalesce(h[label] == n[label], F.lit(False))))
    hit = F.transform("hits", lambda h: feature(h["pred_id"], F.array(entry(h[label], "true_positives"))))
    of_truth = F.concat(hit, F.array(feature(F.lit(None), F.transform(missed, lambda n: entry(n[label], "false_negatives")))))
    told = F.when(F.col("is_truth"), of_truth).when(F.col("iou").isNull(), F.array(feature(F.col("pred_id"), F.array(entry(F.col(label), "false_positives")))))
    rows = found.crossJoin(F.broadcast(every)).select(key, "truth_id", "points", F.explode(told).alias("f")).filter(F.size("f.collections") > 0)
    return rows.select(F.struct(key, "truth_id", "f.pred_id").alias("properties"), "points", "f.collections")


def write_outcomes(found: DataFrame, path: str, parts: int = 1, epsg: int | None = None) -> None:
    """A folder label=<label>/outcome=<outcome> of GeoJSON collections for each outcome that has rows; `parts` bounds a collection's size."""
    part = F.pmod(F.xxhash64("properties"), F.lit(parts)).cast("int")
    texts = collections(found.withColumn("part", part), ["label", "outcome", "part"], epsg=epsg)
    texts.select("label", "outcome", F.col("content").alias("value")).write.mode("overwrite").partitionBy("label", "outcome").text(path)


def false_positives(predictions: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    return predictions.join(matches.select(*keys, "pred_id"), [*keys, "pred_id"], "left_anti")


def false_negatives(truth: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    return truth.join(matches.select(*keys, "truth_id"), [*keys, "truth_id"], "left_anti")


def confusion(pairs: DataFrame, pred: str = "pred", true: str = "true") -> DataFrame:
    """(pred, true, n, share): shares of each true class (column), as the epsilon allows."""
    counts = pairs.groupBy(pred, true).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy(true)) + EPSILON))


def miss_rate(counts: DataFrame, background, pred: str = "pred", true: str = "true") -> DataFrame:
    """Share of each true class that was predicted as background."""
    missed = F.sum(F.when(F.col(pred) == background, F.col("n")).otherwise(0))
    return counts.groupBy(true).agg((missed / (F.sum("n") + EPSILON)).alias("miss_rate"))


def thresholds(spark, start: float = 0.01, stop: float = 0.9, n: int = 25) -> DataFrame:
    step = (stop - start) / (n - 1)
    return spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") == n - 1, F.lit(stop)).otherwise(F.lit(start) + F.col("id") * F.lit(step)).alias("conf_min"))


def threshold_sweep(scored: DataFrame, support: DataFrame, grid: DataFrame, cls: str = "label") -> DataFrame:
    """Precision, recall and F1 of each class at each threshold. scored: cls, conf, hit (0/1); support: cls, total_truth.

    Rows meet the grid by arithmetic, not by a join: each counts in a histogram of the grid's steps, summed from above.
    """
    steps = [r.conf_min for r in grid.orderBy("k").collect()]  # the grid is a parameter of a few values
    bin_of = sum((F.col("conf") >= F.lit(s)).cast("int") for s in steps)
    binned = scored.withColumn("bin", bin_of).groupBy(cls, "bin").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    all_bins = support.select(cls, "total_truth").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    joined = all_bins.join(binned.withColumn("k", F.col("bin") - 1).filter("k >= 0").drop("bin"), [cls, "k"], "left").na.fill(0, ["n", "h"])
    above = Window.partitionBy(cls).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    summed = joined.withColumns({"total_pred": F.sum("n").over(above), "tp": F.sum("h").over(above)}).join(F.broadcast(grid), "k")
    p = F.when(F.col("total_pred") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("total_pred"))
    r = F.when(F.col("total_truth") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("total_truth"))
    return summed.withColumns({"precision": p, "recall": r}).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPSILON))


def average_precision(scored: DataFrame, support: DataFrame, cls: str = "label", buckets: int = 1_024) -> DataFrame:
    """(cls, average_precision, total_truth): precision summed over the steps of recall, confidences falling; equal ones are one step.

    scored: cls, conf (0 to 1), hit (0/1); support: cls, total_truth. Rows are counted by confidence first; sums run over
    buckets of confidence and then inside a bucket, so no task orders a class.
    """
    counts = scored.groupBy(cls, "conf").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    counts = counts.withColumn("bucket", F.least(F.floor(F.col("conf") * buckets), F.lit(buckets - 1)))
    above = Window.partitionBy(cls).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(cls, "bucket").agg(F.sum("n").alias("bn"), F.sum("h").alias("bh"))
    sums = sums.select(cls, "bucket", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n_above"), F.coalesce(F.sum("bh").over(above), F.lit(0)).alias("h_above"))
    inside = Window.partitionBy(cls, "bucket").orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.withColumns({"n_upto": F.sum("n").over(inside), "h_upto": F.sum("h").over(inside)}).join(sums, [cls, "bucket"])
    gained = F.sum(F.col("h") * (F.col("h_upto") + F.col("h_above")) / (F.col("n_upto") + F.col("n_above")))
    found = support.select(cls, "total_truth").join(steps.groupBy(cls).agg(gained.alias("gained")), cls, "left")
    return found.select(cls, F.when(F.col("total_truth") == 0, F.lit(0.0)).otherwise(F.coalesce("gained", F.lit(0.0)) / F.col("total_truth")).alias("average_precision"), "total_truth")


#: Thresholds of IoU that mean average precision is taken over.
IOUS = [round(0.5 + 0.05 * k, 2) for k in range(10)]


def interpolated_precision(scored: DataFrame, support: DataFrame, cls: str = "label", levels: int = 100, buckets: int = 1_024) -> DataFrame:
    """(cls, threshold, ap): the mean over the recalls 0, 1/levels, ..., 1 of the best precision at that recall or more.

    scored: cls, conf (0 to 1), and hits, a map from thresholds to the number (0 or 1) of truths that the prediction finds;
    support: cls, total_truth. Rows are counted by confidence first, equal ones are one step; sums run over buckets of
    confidence and then inside a bucket; a class and threshold then has a row a level of recall.
    """
    single = scored.select(cls, "conf", F.explode("hits").alias("threshold", "hit"))
    counts = single.groupBy(cls, "conf", "threshold").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    counts = counts.withColumn("bucket", F.least(F.floor(F.col("conf") * buckets), F.lit(buckets - 1)))
    keys = [cls, "threshold"]
    above = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("bn"), F.sum("h").alias("bh"))
    sums = sums.select(*keys, "bucket", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n_above"), F.coalesce(F.sum("bh").over(above), F.lit(0)).alias("h_above"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.withColumns({"n_upto": F.sum("n").over(inside), "h_upto": F.sum("h").over(inside)}).join(sums, [*keys, "bucket"])
    steps = steps.select(*keys, (F.col("h_upto") + F.col("h_above")).alias("h"), (F.col("n_upto") + F.col("n_above")).alias("n")).join(support, cls)
    reached = steps.filter("total_truth > 0").withColumn("level", F.floor(F.lit(levels) * F.col("h") / F.col("total_truth")))
    best = reached.groupBy(*keys, "level").agg(F.max(F.col("h") / F.col("n")).alias("p"))
    # a row stands for the levels from its own down to the next lower row's
    up = Window.partitionBy(*keys).orderBy(F.desc("level"))
    best = best.withColumns({"p": F.max("p").over(up.rowsBetween(Window.unboundedPreceding, 0)), "below": F.lead("level", 1, -1).over(up)})
    return best.groupBy(*keys).agg((F.sum(F.col("p") * (F.col("level") - F.col("below"))) / (levels + 1)).alias("ap"))


def mean_average_precision(pairs: DataFrame, predictions: DataFrame, truth: DataFrame, keys: list[str], cls: str = "label", thresholds: list[float] = IOUS) -> DataFrame:
    """(cls, threshold, ap): average precision of every class of the truth at each threshold of IoU, and with null thresholds its mean over them.

    pairs: keys, cls, truth_id, pred_id, conf, iou of truths and predictions of one class; predictions: keys, cls, pred_id,
    conf; truth: cls. Classes without predictions have 0; predictions of classes without truths count for nothing.
    """
    matched = match_by_confidence(pairs, [*keys, cls], thresholds)
    hits = matched.groupBy(*keys, cls, "pred_id").agg(F.collect_set("threshold").alias("found"))
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    scored = predictions.select(*keys, cls, "pred_id", "conf").join(hits, [*keys, cls, "pred_id"], "left")
    hit = F.map_from_arrays(grid, F.transform(grid, lambda t: F.coalesce(F.array_contains("found", t), F.lit(False)).cast("int")))
    support = truth.groupBy(cls).agg(F.count("*").alias("total_truth"))
    found = interpolated_precision(scored.select(cls, "conf", hit.alias("hits")), support, cls)
    every = support.select(cls, F.explode(grid).alias("threshold")).join(found, [cls, "threshold"], "left").na.fill(0.0, ["ap"])
    return every.unionByName(every.groupBy(cls).agg(F.lit(None).cast("double").alias("threshold"), F.avg("ap").alias("ap")))


def of_all_classes(metrics: DataFrame, classes: DataFrame, cls: str = "label") -> DataFrame:
    """Metrics of every class in `classes`; 0 where a class was not evaluated."""
    kept = [c for c in metrics.columns if c != cls]
    return classes.select(cls).join(metrics, cls, "left").na.fill(0, kept)


def best_per_class(sweep: DataFrame, metric: str, cls: str = "label", conf: str = "conf_min") -> DataFrame:
    """The row of the greatest metric for each class; the lowest threshold on ties."""
    rank = F.row_number().over(Window.partitionBy(cls).orderBy(F.desc(metric), conf))
    return sweep.withColumn("rank", rank).filter("rank = 1").drop("rank")


def with_global_row(per_class: DataFrame, name: str = "global") -> DataFrame:
    """Per-class precision, recall, F1 and support, and a row of their means (support: the sum)."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPSILON)
    overall = per_class.agg(F.lit(name).alias("class_name"), F.sum("support").alias("support"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    return per_class.select("class_name", "support", "precision", "recall").unionByName(overall).withColumn("f1", f1)
