from pyspark.sql import functions as F

from kurtosia.operators import sequences


def test_a_fold_gathers_no_key_and_keeps_its_state_over_batches(spark):
    """One key holds nearly all rows, more than a batch of Arrow has."""
    n = 45_000
    df = spark.range(n).select(F.when(F.col("id") % 1000 == 7, "b").otherwise("a").alias("k"), F.col("id").alias("seq"), (F.col("id") % 97).cast("double").alias("x"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 5).alias("e"))
    out = sequences.smooth(df.repartition(5), ["k"], ["seq"], "x", "s", "e", 0.4, 15)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    want, mean, count, last = {}, None, 0, None
    for i in range(n):
        if i % 1000 == 7:
            continue
        near = last is not None and i * 10 - last <= 15
        mean, count = (mean + 0.4 * (i % 97 - mean), count + 1) if near else (float(i % 97), 1)
        last = i * 10 + 5
        want[i] = (mean, count)
    assert {r.seq: (r.value, r["count"]) for r in out.where("k = 'a'").collect()} == want
