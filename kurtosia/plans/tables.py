"""Queries of metrics over documents and their labels (quality as truth, toxic as verdict) and over order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kurtosia.functions import numbers
from kurtosia.operators import baseline, boosting, isolation, metrics


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with truth and flag; NULL where there is no label."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 1).alias("flag"))
    return _read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


_JUDGED = "j AS (SELECT d.doc_id, lang, source, n_chars, quality = 1 AS truth, toxic = 1 AS flag FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.confusion(judged(spark, sf_dir), ["lang"], "truth", "flag")
    return out.withColumns({c: _r(c) for c in ("recall", "precision", "fpr")})


CONFUSION_SQL = f"""
WITH {_JUDGED}, c AS (SELECT lang, count(*) FILTER (NOT truth AND NOT flag) AS tn, count(*) FILTER (NOT truth AND flag) AS fp, count(*) FILTER (truth AND NOT flag) AS fn, count(*) FILTER (truth AND flag) AS tp, count(*) AS available, count(truth) AS scored FROM j GROUP BY lang)
SELECT *, available - scored AS unscored, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 6) END AS fpr FROM c
"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    available = _read(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 1500).alias("long"))
    flags = _read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("flag"))
    out = metrics.coverage(available, flags, ["lang"], "doc_id", "long", "flag")
    return out.withColumns({c: _r(c) for c in ("conditional_recall", "overall_capture", "normal_fpr")})


COVERAGE_SQL = """
WITH j AS (SELECT lang, n_chars > 1500 AS t, quality = 1 AS p FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT lang, count(*) FILTER (t) AS positive_available, count(*) FILTER (NOT t) AS normal_available, count(*) FILTER (t AND p) AS tp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn FROM j GROUP BY lang)
SELECT *, positive_available + normal_available - tp - fn - fp - tn AS unscored, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS conditional_recall, CASE WHEN positive_available > 0 THEN round(tp / positive_available, 6) END AS overall_capture, CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn), 6) END AS normal_fpr FROM c
"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a truth (return flag) and a made-up prediction from their status."""
    predicted = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") > 25, "A").otherwise("R")
    return _read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("truth"), predicted.alias("predicted"), F.month("l_shipdate").cast("string").alias("month"), "l_suppkey", (F.col("l_discount") * 10).cast("double").alias("margin"))


_CLASSIFIED = "c AS (SELECT l_returnflag AS truth, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity > 25 THEN 'A' ELSE 'R' END AS predicted, CAST(month(l_shipdate) AS VARCHAR) AS month, l_suppkey, CAST(l_discount * 10 AS DOUBLE) AS margin FROM lineitem)"
_BY_CLASS = f"""{_CLASSIFIED},
a AS (SELECT month, truth AS class, count(*) AS support, count(*) FILTER (truth = predicted) AS hits FROM c GROUP BY ALL), g AS (SELECT month, predicted AS class, count(*) AS given FROM c GROUP BY ALL),
m AS (SELECT coalesce(a.month, g.month) AS month, coalesce(a.class, g.class) AS class, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, coalesce(CASE WHEN given > 0 THEN hits / given END, 0) AS precision, coalesce(CASE WHEN support > 0 THEN hits / support END, 0) AS recall
      FROM a FULL JOIN g ON a.month = g.month AND a.class = g.class),
k AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)"""


def by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.by_class(_classified(spark, sf_dir), ["month"], "truth", "predicted")
    return out.withColumns({c: _r(c) for c in ("precision", "recall", "f1")})


BY_CLASS_SQL = f"WITH {_BY_CLASS} SELECT month, class, support, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM k"


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months as candidates: the best three."""
    classes = metrics.by_class(_classified(spark, sf_dir), ["month"], "truth", "predicted")
    board = metrics.overall(classes, ["month"]).withColumn("n_features", F.length("month")).withColumnRenamed("month", "name")
    return metrics.leaderboard(board, 3).withColumns({c: _r(c) for c in ("accuracy", "macro_f1", "min_precision", "min_recall", "weakest")})


LEADERBOARD_SQL = f"""
WITH {_BY_CLASS}, o AS (SELECT month AS name, sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1, min(precision) AS min_precision, min(recall) AS min_recall FROM k GROUP BY month)
SELECT name, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(min_precision, 6) AS min_precision, round(min_recall, 6) AS min_recall, min_precision >= 0.9 AND min_recall >= 0.9 AS strict, CAST(length(name) AS INT) AS n_features, round(least(min_precision, min_recall), 6) AS weakest
FROM o ORDER BY least(min_precision, min_recall) DESC, o.macro_f1 DESC, length(name), name LIMIT 3
"""


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(_classified(spark, sf_dir), "truth", "predicted", ["A", "N", "R"])


MATRIX_SQL = f"WITH {_CLASSIFIED} SELECT truth, count(*) FILTER (predicted = 'A') AS A, count(*) FILTER (predicted = 'N') AS N, count(*) FILTER (predicted = 'R') AS R FROM c GROUP BY truth"


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_classified(spark, sf_dir), ["month", "truth"], "truth", "predicted", "margin").withColumns({c: _r(c) for c in ("accuracy", "mean_margin", "min_margin")})


SUMMARIES_SQL = f"WITH {_CLASSIFIED} SELECT month, truth, count(*) AS n, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(margin), 6) AS mean_margin, round(min(margin), 6) AS min_margin FROM c GROUP BY month, truth"


def alarm_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir).withColumn("flag", F.col("truth") != F.col("predicted"))
    return metrics.alarm_rates(rows, ["month"], ["l_suppkey"], "flag").withColumns({c: _r(c) for c in ("window_rate", "file_rate")})


ALARM_SQL = f"""
WITH {_CLASSIFIED}, f AS (SELECT month, l_suppkey, count(*) AS n, count(*) FILTER (truth <> predicted) AS h FROM c GROUP BY ALL)
SELECT month, CAST(sum(n) AS BIGINT) AS windows, CAST(sum(h) AS BIGINT) AS alarms, count(*) AS files, count(*) FILTER (h > 0) AS alarmed_files, round(sum(h) / sum(n), 6) AS window_rate, round(count(*) FILTER (h > 0) / count(*), 6) AS file_rate FROM f GROUP BY month
"""


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as trials, nations as strata: whole trials held out in five folds."""
    rows = _read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return metrics.folds(rows, "s_nationkey", "s_suppkey").groupBy("s_nationkey", "fold").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("s_acctbal"), 2).alias("balance"))


FOLDS_SQL = """
SELECT s_nationkey, CAST(fold AS INT) AS fold, count(*) AS n, round(sum(s_acctbal), 2) AS balance
FROM (SELECT s_nationkey, s_acctbal, (dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) % 5 AS fold FROM supplier) GROUP BY ALL
"""


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as clusters of order lines within their nation."""
    hits = _classified(spark, sf_dir).groupBy("l_suppkey").agg(F.count_if(F.col("truth") == F.col("predicted")).alias("hits"), F.count(F.lit(1)).alias("n"))
    rows = hits.join(_read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", "s_suppkey", "hits", "n")
    return metrics.bootstrap(rows, "s_nationkey", "s_suppkey", "hits", "n", 200).select(*[_r(c) for c in ("lo", "mid", "hi")]).toDF("lo", "mid", "hi")


BOOTSTRAP_SQL = f"""
WITH {_CLASSIFIED}, h AS (SELECT l_suppkey, count(*) FILTER (truth = predicted) AS hits, count(*) AS n FROM c GROUP BY l_suppkey),
b AS (SELECT s_nationkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS size, hits, n FROM h JOIN supplier ON l_suppkey = s_suppkey WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
d AS (SELECT s_nationkey, r.range AS replicate, CAST(floor(CAST('0x' || substr(md5(concat_ws(':', 'bootstrap', r.range, s_nationkey, i)), 1, 8) AS BIGINT) / 4294967296.0 * size) AS BIGINT) AS i FROM b, range(1, 201) r),
a AS (SELECT replicate, sum(hits) / sum(n) AS a FROM d JOIN b ON d.s_nationkey = b.s_nationkey AND d.i = b.i GROUP BY replicate)
SELECT round(quantile_cont(a, 0.025), 6) AS lo, round(quantile_cont(a, 0.5), 6) AS mid, round(quantile_cont(a, 0.975), 6) AS hi FROM a
"""


def shared_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand under more than one source."""
    rows = _read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content"), "source")
    return metrics.shared_content(rows, "content", "source").select("content", F.array_join("roles", ",").alias("roles"))


SHARED_SQL = "SELECT sha256(text) AS content, string_agg(DISTINCT source, ',' ORDER BY source) AS roles FROM documents GROUP BY sha256(text) HAVING count(DISTINCT source) > 1"


def labels_of_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event kinds as condition labels in two spellings."""
    kind = F.col("event_type")
    label = F.when(kind == "error", "베어링불량").when(kind == "view", "normal").when(kind == "click", "벨트느슨함").otherwise(kind)
    rows = _read(spark, sf_dir, "events").select(numbers.condition(label).alias("condition"), "value")
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("value")).alias("mean"))


CONDITIONS_SQL = "SELECT CASE event_type WHEN 'error' THEN 'bearing' WHEN 'view' THEN 'normal' WHEN 'click' THEN 'belt' END AS condition, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1"


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", "user_id", "event_type")
    return _read(spark, sf_dir, "events").select("event_id", numbers.fold31(key).alias("fold31"), numbers.fnv1a(key).alias("fnv1a"))


CHECKSUMS_SQL = """
WITH k AS (SELECT event_id, list_transform(string_split(concat_ws(':', user_id, event_type), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS cs FROM events)
SELECT event_id, list_reduce(list_prepend(CAST(0 AS BIGINT), cs), lambda h, c: (h * 31 + c) % 4294967296) AS fold31, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), cs), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS fnv1a FROM k
"""


def equipment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of order values by region and nation: the equipment hierarchy of a grouped report."""
    orders = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nations = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = orders.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("price", F.col("o_totalprice").cast("double"))
    out = baseline.fit_mean_std(rows, ["r_name", "n_name"], ["price"])
    return out.select("r_name", "n_name", "n", _r("price_mean", 2).alias("mean"), _r("price_std", 2).alias("std"))


REPORT_SQL = """
SELECT r_name, n_name, count(*) AS n, round(avg(CAST(o_totalprice AS DOUBLE)), 2) AS mean, round(stddev_pop(CAST(o_totalprice AS DOUBLE)), 2) AS std
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name
"""


def isolation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How soon random cuts part each order line from others, by quantity, price, discount and tax."""
    ids, features = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = _read(spark, sf_dir, "lineitem").select(*ids, *features)
    return isolation.score(rows, isolation.fit(rows, ids, features), features).select(*ids, _r("anomaly", 9).alias("anomaly"))


def boosted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of each order line by two rounds of boosted trees over quantity, discount and tax."""
    ids, features = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"]
    rows = _read(spark, sf_dir, "lineitem").select(*ids, *features, "l_extendedprice")
    model = boosting.boosted(rows, "l_extendedprice", features, boosting.even_edges(rows, features, 16), rounds=2, depth=2, rate=0.5)
    return boosting.predicted(rows, model, features).select(*ids, _r(F.col("predicted")[0], 4).alias("price"))


def _boosted_sql(rounds: int = 2, depth: int = 2, rate: float = 0.5, bins: int = 16, scale: int = boosting.SCALE) -> str:
    """The same rounds and levels as a chain of tables: rows with their node and value, sums by bin, and the best cut of each node."""
    features = ("l_quantity", "l_discount", "l_tax")
    limits = ", ".join(f"min(CAST({f} AS DOUBLE)) AS lo{i}, max(CAST({f} AS DOUBLE)) AS hi{i}" for i, f in enumerate((*features, "l_extendedprice")))
    cell = ", ".join(f"1 + len(list_filter(range(1, {bins}), lambda j: lo{i} + (hi{i} - lo{i}) * j / {bins} <= CAST({f} AS DOUBLE))) AS b{i}" for i, f in enumerate(features))
    part = lambda g, n: f"(CAST({g} AS DOUBLE) / {scale}) * (CAST({g} AS DOUBLE) / {scale}) / (CAST({n} AS DOUBLE) + 1)"
    value = lambda g, n: f"-{rate} * (CAST({g} AS DOUBLE) / {scale}) / (CAST({n} AS DOUBLE) + 1)"
    steps = [
        f"m AS (SELECT {limits} FROM lineitem)",
        f"x AS MATERIALIZED (SELECT l_orderkey, l_linenumber, {cell}, (CAST(l_extendedprice AS DOUBLE) - lo3) / (hi3 - lo3) AS y FROM lineitem, m)",
        f"f0 AS MATERIALIZED (SELECT *, (SELECT CAST(sum(CAST(floor(y * {scale} + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / {scale} FROM x) AS f FROM x)",
    ]
    for r in range(rounds):
        steps.append(f"r{r}_0 AS MATERIALIZED (SELECT *, CAST(floor((f - y) * {scale} + 0.5) AS BIGINT) AS g, 0 AS node, CAST(0 AS DOUBLE) AS v FROM f{r})")
        for d in range(depth):
            at = f"r{r}_{d}"
            steps += [
                f"s{at} AS (SELECT node, k, b, CAST(sum(g) AS BIGINT) AS g, count(*) AS n FROM (SELECT node, g, unnest([0, 1, 2]) AS k, unnest([b0, b1, b2]) AS b FROM {at} WHERE node >= {2**d - 1}) GROUP BY ALL)",
                f"w{at} AS (SELECT *, sum(g) OVER u AS lg, sum(n) OVER u AS ln, sum(g) OVER t AS tg, sum(n) OVER t AS tn FROM s{at} WINDOW u AS (PARTITION BY node, k ORDER BY b), t AS (PARTITION BY node, k))",
                f"c{at} AS (SELECT *, {part('lg', 'ln')} + {part('tg - lg', 'tn - ln')} - {part('tg', 'tn')} AS gain FROM w{at} WHERE ln >= 20 AND tn - ln >= 20)",
                f"t{at} AS MATERIALIZED (SELECT node AS parted, k, b AS cut, {value('lg', 'ln')} AS below, {value('tg - lg', 'tn - ln')} AS above FROM c{at} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, k, b) = 1)",
                f"r{r}_{d + 1} AS MATERIALIZED (SELECT * EXCLUDE (node, v, parted, k, cut, below, above), CASE WHEN parted IS NULL THEN node WHEN [b0, b1, b2][k + 1] <= cut THEN 2 * node + 1 ELSE 2 * node + 2 END AS node, CASE WHEN parted IS NULL THEN v WHEN [b0, b1, b2][k + 1] <= cut THEN below ELSE above END AS v FROM {at} LEFT JOIN t{at} ON parted = node)",
            ]
        steps.append(f"f{r + 1} AS MATERIALIZED (SELECT l_orderkey, l_linenumber, b0, b1, b2, y, f + v AS f FROM r{r}_{depth})")
    return f"WITH {', '.join(steps)} SELECT l_orderkey, l_linenumber, round(lo3 + (hi3 - lo3) * f, 4) AS price FROM f{rounds}, m"


def extra_trees_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each order line came back, by a forest of random cuts on quantity, price, discount and day of shipping."""
    ids, features = ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "day"]
    rows = _read(spark, sf_dir, "lineitem").select(*ids, *features[:3], F.unix_date(F.to_date("l_shipdate")).alias("day"), (F.col("l_returnflag") == "R").cast("int").alias("back"))
    model = boosting.extra_trees(rows, "back", features, boosting.even_edges(rows, features), trees=10, depth=4)
    return boosting.predicted(rows, model, features).select(*ids, "back", _r(F.col("predicted")[1], 6).alias("share"))


QUERIES = {
    "boosted_prices": (boosted_prices, _boosted_sql()),
    "extra_trees_flags": (extra_trees_flags, None),
    "isolation_scores": (isolation_scores, None),
    "confusion": (confusion, CONFUSION_SQL),
    "coverage": (coverage, COVERAGE_SQL),
    "by_class": (by_class, BY_CLASS_SQL),
    "leaderboard": (leaderboard, LEADERBOARD_SQL),
    "confusion_matrix": (confusion_matrix, MATRIX_SQL),
    "summaries": (summaries, SUMMARIES_SQL),
    "alarm_rates": (alarm_rates, ALARM_SQL),
    "group_folds": (group_folds, FOLDS_SQL),
    "bootstrap": (bootstrap, BOOTSTRAP_SQL),
    "shared_content": (shared_content, SHARED_SQL),
    "conditions": (labels_of_conditions, CONDITIONS_SQL),
    "checksums": (checksums, CHECKSUMS_SQL),
    "equipment_report": (equipment_report, REPORT_SQL),
}
