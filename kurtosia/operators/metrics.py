"""Detection metrics.  Every rate is NULL without a denominator, and every row says how much was available, scored and unscored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kurtosia.functions.numbers import rate

from .joins import drawn_share, memberships
from .settling import settled

Names = Sequence[str]


def _count(where: Column, name: str) -> Column:
    return F.count_if(where).alias(name)


def confusion(df: DataFrame, keys: Names, truth: str, flag: str) -> DataFrame:
    """tn, fp, fn, tp over rows with both, with recall, precision, false-positive rate and the unscored rows."""
    t, p = F.col(truth), F.col(flag)
    out = df.groupBy(*keys).agg(_count(~t & ~p, "tn"), _count(~t & p, "fp"), _count(t & ~p, "fn"), _count(t & p, "tp"), F.count(F.lit(1)).alias("available"), F.count(F.when(t.isNotNull() & p.isNotNull(), 1)).alias("scored"))
    return out.select(*keys, "tn", "fp", "fn", "tp", "available", "scored", (F.col("available") - F.col("scored")).alias("unscored"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def coverage(available: DataFrame, predictions: DataFrame, keys: Names, id_col: str, positive: str, flag: str) -> DataFrame:
    """Recall among the scored, capture among all available, and the false-positive rate; ``positive`` is a column of ``available``."""
    joined = available.join(predictions.select(id_col, flag), id_col, "left")
    t, p = F.col(positive), F.col(flag)
    out = joined.groupBy(*keys).agg(_count(t, "positive_available"), _count(~t, "normal_available"), _count(t & p, "tp"), _count(t & ~p, "fn"), _count(~t & p, "fp"), _count(~t & ~p, "tn"))
    return out.select("*", (F.col("positive_available") + F.col("normal_available") - F.col("tp") - F.col("fn") - F.col("fp") - F.col("tn")).alias("unscored"), rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("conditional_recall"), rate(F.col("tp"), F.col("positive_available")).alias("overall_capture"), rate(F.col("fp"), F.col("fp") + F.col("tn")).alias("normal_fpr"))


def by_class(df: DataFrame, keys: Names, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 (0 without a denominator) and support of each class that occurs on either side."""
    pairs = df.groupBy(*keys, truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    actual = pairs.groupBy(*keys, F.col(truth).alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    given = pairs.groupBy(*keys, F.col(predicted).alias("class")).agg(F.sum("n").alias("given"))
    out = actual.join(given, [*keys, "class"], "full").na.fill(0, ["support", "hits", "given"])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumn("precision", zero(rate(F.col("hits"), F.col("given")))).withColumn("recall", zero(rate(F.col("hits"), F.col("support"))))
    return out.withColumn("f1", zero(rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).drop("given")


def overall(classes: DataFrame, keys: Names, strict: float = 0.9) -> DataFrame:
    """accuracy, macro F1, the least precision and recall, and whether all of them reach ``strict``; from ``by_class``."""
    out = classes.groupBy(*keys).agg(rate(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.min("precision").alias("min_precision"), F.min("recall").alias("min_recall"))
    return out.withColumn("strict", (F.col("min_precision") >= strict) & (F.col("min_recall") >= strict))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: Sequence) -> DataFrame:
    """A row a true label, a column a predicted one, in the given order; absent pairs count 0."""
    return df.groupBy(truth).pivot(predicted, list(labels)).count().na.fill(0)


def summary(df: DataFrame, keys: Names, truth: str, predicted: str, margin: str) -> DataFrame:
    """n, accuracy, and mean and least margin of each group (trial, fold or class)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"), F.avg(margin).alias("mean_margin"), F.min(margin).alias("min_margin"))


def alarm_rates(df: DataFrame, keys: Names, file: Names, flag: str) -> DataFrame:
    """Rate of alarmed windows, and of files with any alarm, of each group."""
    files = df.groupBy(*keys, *file).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("hits"))
    out = files.groupBy(*keys).agg(F.sum("n").alias("windows"), F.sum("hits").alias("alarms"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("hits") > 0).alias("alarmed_files"))
    return out.withColumn("window_rate", rate(F.col("alarms"), F.col("windows"))).withColumn("file_rate", rate(F.col("alarmed_files"), F.col("files")))


def leaderboard(df: DataFrame, most: int = 1) -> DataFrame:
    """The best candidates: least precision or recall, then macro F1, then fewer features, then name."""
    weakest = F.least("min_precision", "min_recall")
    return df.withColumn("weakest", weakest).orderBy(F.desc("weakest"), F.desc("macro_f1"), "n_features", "name").limit(most)


def top_margin(scores: Column) -> Column:
    """The best score less the second best."""
    s = F.sort_array(scores, asc=False)
    return s[0] - s[1]


def nearest_centroid(train: DataFrame, test: DataFrame, label: str, vector: str, id_col: str) -> DataFrame:
    """(id, predicted): the class whose mean vector is nearest; ties to the smaller label.

    Centroids are a row a class: few, and gathered into one broadcast row.
    """
    long = train.select(label, F.posexplode(vector).alias("i", "x"))
    centres = long.groupBy(label, "i").agg(F.avg("x").alias("x")).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centre"))
    all_ = centres.agg(F.collect_list(F.struct(F.col(label).alias("label"), "centre")).alias("centres"))
    away = lambda c: F.aggregate(F.zip_with(c["centre"], F.col(vector), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)
    best = F.array_min(F.transform("centres", lambda c: F.struct(away(c).alias("d"), c["label"].alias("label"))))
    return test.join(F.broadcast(all_), how="cross").select(id_col, best["label"].alias("predicted"), best["d"].alias("distance"))


def held_out_centroids(df: DataFrame, label: str, vector: str, fold: str, id_col: str) -> DataFrame:
    """(id, label, fold, predicted, distance): each fold by the nearest class mean of the other folds; ties to the smaller label.

    Sums by class and fold are made once; a fold's means are all sums less its own.
    """
    return _nearest_of_folds(df, df.select(label, vector, F.col(fold).alias("_f")), label, vector, fold, id_col, leave_out=True)


def _nearest_of_folds(df: DataFrame, train: DataFrame, label: str, vector: str, fold: str, id_col: str, leave_out: bool) -> DataFrame:
    """By class means for each fold: of the rows of other folds (``leave_out``), or of the rows that ``train`` gives to the fold."""
    parts = train.select(label, "_f", F.posexplode(vector).alias("i", "x")).groupBy(label, "_f", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    if leave_out:
        whole = parts.groupBy(label, "i").agg(F.sum("s").alias("ws"), F.sum("n").alias("wn"))
        folds_ = df.select(F.col(fold).alias("_f")).distinct()
        each = whole.join(F.broadcast(folds_), how="cross")  # as many rows a class and component as folds
        parts = each.join(parts, [label, "_f", "i"], "left").select(label, "_f", "i", (F.col("ws") - F.coalesce("s", F.lit(0.0))).alias("s"), (F.col("wn") - F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    means = parts.groupBy(label, "_f").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("x")))), lambda e: e["x"]).alias("centre"))
    models = means.groupBy("_f").agg(F.collect_list(F.struct(F.col(label).alias("label"), "centre")).alias("centres"))  # a row a fold, a centre a class
    away = lambda c: F.aggregate(F.zip_with(c["centre"], F.col(vector), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)
    best = F.array_min(F.transform("centres", lambda c: F.struct(away(c).alias("d"), c["label"].alias("label"))))
    out = df.join(F.broadcast(models), F.col(fold) == F.col("_f"), "left").withColumn("_b", best)
    return out.select(id_col, label, fold, F.col("_b.label").alias("predicted"), F.col("_b.d").alias("distance"))


def centroid_learning_curve(df: DataFrame, label: str, vector: str, trial: str, fold: str, id_col: str, holdouts: Sequence[int], counts: Sequence[int]) -> DataFrame:
    """(trials, n, hits, accuracy): held-out folds by class means of the first 1, 2, ... trials of each class."""
    out = None
    for count in counts:
        dealt = memberships(df, label, trial, fold, holdouts, count)
        train = dealt.where("role = 'train'").select(label, vector, F.col("holdout").alias("_f"))
        told = _nearest_of_folds(df, train, label, vector, fold, id_col, leave_out=False)
        one = told.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col("predicted")).alias("hits")).select(F.lit(count).alias("trials"), "n", "hits", rate(F.col("hits"), F.col("n")).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


def bootstrap(df: DataFrame, stratum: str, cluster: str, hits: str, n: str, replicates: int = 1000, seed: str = "bootstrap") -> DataFrame:
    """(lo, mid, hi): 2.5, 50 and 97.5 % quantiles of accuracy when whole clusters are drawn again within strata.

    ``df`` has a row a cluster with its hits and rows.  Draw d of a replicate takes
    the cluster at a position that follows from an MD5, so runs repeat exactly.
    """
    size = Window.partitionBy(stratum)
    numbered = df.withColumn("_i", F.row_number().over(size.orderBy(cluster)) - 1).withColumn("_size", F.count(F.lit(1)).over(size))
    draws = numbered.select(stratum, F.col("_i").alias("_d"), "_size", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    draws = draws.withColumn("_i", F.floor(drawn_share(F.lit(seed), F.col("replicate"), F.col(stratum), F.col("_d")) * F.col("_size")).cast("int"))
    drawn = draws.join(numbered.select(stratum, "_i", hits, n), [stratum, "_i"])
    accuracy = drawn.groupBy("replicate").agg((F.sum(hits) / F.sum(n)).alias("a"))
    q = F.percentile("a", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return accuracy.agg(q.alias("q")).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("hi"))


def folds(df: DataFrame, stratum: str, group: str, k: int = 5) -> DataFrame:
    """Adds ``fold``: whole groups, dealt in order of name within each stratum."""
    groups = df.select(stratum, group).distinct()
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(group)) - 1
    return df.join(groups.withColumn("fold", (rank % k).cast("int")), [stratum, group])


def spaced_sample(df: DataFrame, order: Names, k: int) -> DataFrame:
    """``k`` rows spaced evenly from the first to the last (a sampling operator).

    Rows are range-partitioned and sorted; a row's number is its place in its partition
    after the counts of the partitions before.  No task sees the whole table.  The sorted rows
    are written once: borders of ranges are sampled, and each new plan would draw its own.
    """
    if k < 1:
        raise ValueError("k must be positive")
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = settled(sorted_).withColumn("_p", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).agg(F.array_sort(F.collect_list(F.struct("_p", "_c"))).alias("_counts"))  # a row a partition
    before = F.aggregate(F.filter("_counts", lambda x: x["_p"] < F.col("_p")), F.lit(0).cast("long"), lambda t, x: t + x["_c"])
    whole = F.aggregate("_counts", F.lit(0).cast("long"), lambda t, x: t + x["_c"])
    ranked = placed.join(F.broadcast(counts), how="cross").withColumn("_i", before + F.col("_at")).withColumn("_n", whole)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.rint(j * (F.col("_n") - 1) / max(k - 1, 1)).cast("long"))
    return ranked.where((F.col("_n") <= k) | F.array_contains(wanted, F.col("_i"))).select(*[F.col(f"`{c}`") for c in df.columns])


def assert_contract(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df``; its evaluation fails where an aggregate check does not hold.  Each value is a boolean aggregate."""
    told = df.agg(*[c.alias(f"_{i}") for i, c in enumerate(checks.values())])
    bad = [F.assert_true(F.coalesce(f"_{i}", F.lit(False)), F.lit(name)).isNull() for i, name in enumerate(checks)]
    ok = told.select(*[b.alias(f"_{i}") for i, b in enumerate(bad)])
    names = [f"_{i}" for i in range(len(bad))]
    return df.join(F.broadcast(ok), how="cross").where(" AND ".join(names)).drop(*names)


def shared_content(df: DataFrame, content: str, role: str) -> DataFrame:
    """(content, roles): contents that stand under more than one role."""
    return df.groupBy(content).agg(F.sort_array(F.collect_set(role)).alias("roles")).where(F.size("roles") > 1)
