"""Splits, batches, losses and metrics, worked by hand."""

import math

from pyspark.sql import functions as F

from turfgrid.operators import metrics, splits, surfaces


def _ids(spark, n):
    # ids far apart and uneven, one game with most rows
    return spark.range(n).select((F.col("id") * F.col("id")).alias("pass_id"), F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 7).alias("game_id"))


def test_exact_split_and_batches(spark):
    passes = _ids(spark, 1003)
    sizes = {r.split: r["count"] for r in splits.split(passes).groupBy("split").count().collect()}
    assert sizes == {"train": 802, "validation": 201}
    again = splits.split(passes.repartition(13))
    assert splits.split(passes).exceptAll(again).count() == 0
    in_order = sorted((r.pass_id, r.batch_id) for r in splits.batches(passes).collect())
    assert [b for _, b in in_order] == [i // 32 for i in range(1003)]
    shuffled = splits.batches(passes, shuffle=True).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in shuffled) == [11] + [32] * 31
    assert splits.pick_position(passes, 122).first().pass_id == 122 * 122
    assert splits.row_count(passes).first().n == 1003


def test_split_by_game_keeps_games_whole(spark):
    sides = splits.split_by_game(_ids(spark, 500)).groupBy("game_id").agg(F.countDistinct("split").alias("n"))
    assert {r.n for r in sides.collect()} == {1}


def test_metrics_with_a_class_never_predicted(spark):
    rows = [(0, 0), (0, 0), (1, 0), (1, 1), (2, 1)]
    p = spark.createDataFrame(rows, "y_true int, y_pred int")
    row = metrics.metrics(p).first()
    assert math.isclose(row.accuracy, 3 / 5)
    assert math.isclose(row.precision, (2 / 3 + 1 / 2 + 0) / 3)
    assert math.isclose(row.recall, (1 + 1 / 2 + 0) / 3)
    assert math.isclose(row.f1, (4 / 5 + 1 / 2 + 0) / 3)
    report = {r.label: r for r in metrics.class_report(p).collect()}
    assert report["2"].support == 1 and report["2"].f1 == 0
    assert math.isclose(report["weighted avg"].recall, 3 / 5) and report["macro avg"].support == 5
    assert math.isclose(metrics.macro_f1(p).first().macro_f1, row.f1)


def test_losses(spark):
    rows = [(0, 1, 0.5), (0, 0, 0.5), (1, 1, 0.0), (1, 0, 1.0), (1, 1, 1.0)]
    p = spark.createDataFrame(rows, "batch_id int, y_true int, p double")
    loss = {r.batch_id: r.loss for r in metrics.batch_bce(p).collect()}
    assert math.isclose(loss[0], math.log(2)) and math.isclose(loss[1], 200 / 3)
    assert math.isclose(metrics.epoch_loss(metrics.batch_bce(p)).first().loss, (math.log(2) + 200 / 3) / 2)
    assert math.isclose({r.batch_id: r.loss for r in metrics.selection_loss(p).collect()}[1], 100 / 3)


def test_checkpoints(spark):
    history = [("a", e, 0.0, v) for e, v in enumerate([3.0, 4.0, 3.0, 2.0, 2.0, 1e13])] + [("b", 0, 0.0, 1e13)]
    table = spark.createDataFrame(history, "run string, epoch int, train_loss double, val_loss double")
    kept = {(r.run, r.epoch) for r in metrics.checkpoints(table).collect() if r.kept}
    assert kept == {("a", 0), ("a", 3)}
    assert {r.run: r.epoch for r in metrics.best_epoch(table).collect()} == {"a": 3, "b": None}


def test_softmax_within_pass_and_batch(spark):
    z = spark.range(40).select((F.col("id") % 4).alias("pass_id"), (F.col("id") % 4 / 2).cast("int").alias("batch_id"), (F.col("id") * 30.0).alias("z"))
    for within in ("pass_id", "batch_id"):
        sums = surfaces.surface_softmax(z, within).groupBy(within).agg(F.sum("p").alias("s")).collect()
        assert all(math.isclose(r.s, 1.0) for r in sums)


def test_random_stack_does_not_depend_on_partitions(spark):
    keys = spark.range(20).withColumnRenamed("id", "pass_id")
    a = surfaces.random_stack(keys, 2, 5, 7, seed=1)
    b = surfaces.random_stack(keys.repartition(7), 2, 5, 7, seed=1)
    assert a.count() == 20 * 70 and a.exceptAll(b).count() == 0
    mean, spread = a.agg(F.avg("value"), F.stddev("value")).first()
    assert abs(mean) < 0.1 and abs(spread - 1) < 0.1


def test_ranks_with_missing_keys_and_no_rows(spark):
    rows = [(None if i % 10 == 0 else i,) for i in range(40)]
    table = spark.createDataFrame(rows, "pass_id bigint")
    for ranked in (splits.ordered_rank(table, "pass_id", 5), splits.shuffled_rank(table, "pass_id", 5)):
        assert sorted(r["rank"] for r in ranked.collect()) == list(range(40)) and ranked.first()["size"] == 40
    ordered = {r["pass_id"]: r["rank"] for r in splits.ordered_rank(table, "pass_id", 5).collect() if r["pass_id"]}
    assert [k for k, _ in sorted(ordered.items(), key=lambda x: x[1])] == sorted(ordered) and min(ordered.values()) == 4
    empty = table.limit(0)
    assert splits.batches(empty).count() == 0 and splits.batches(empty, shuffle=True).count() == 0 and splits.split(empty).count() == 0


def test_class_report_reads_once(spark, capsys):
    predictions = spark.createDataFrame([(i % 3, i % 2) for i in range(30)], "y_true int, y_pred int")
    metrics.class_report(predictions).explain()
    plan = capsys.readouterr().out
    assert plan.count("Scan") + plan.count("LocalTableScan") <= 2 and plan.count("ExistingRDD") <= 1


def test_positions_over_buckets(spark):
    draw = [None, None, 7.5, 7.5, 7.5, float("nan"), float("inf"), -float("inf")] + [float(k * k % 97) for k in range(300)]
    table = spark.createDataFrame([(v, i) for i, v in enumerate(draw)], "pass_id double, row int")
    ordered = [r.pass_id for r in table.orderBy("pass_id").collect()]
    same = lambda a, b: a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))
    for position in (0, 1, 2, 40, 133, 250, 306, 307):
        for rows in (10, 1000):
            assert same(splits.pick_position(table, position, bucket_rows=rows).first().pass_id, ordered[position])
    assert splits.pick_position(table, 308).count() == 0 and splits.pick_position(table, -1).count() == 0
    assert splits.pick_position(table.limit(0), 0).count() == 0
    ranked = {r.row: r.rank for r in splits.ordered_rank(table, "pass_id", 10).collect()}
    by_rank = [draw[row] for row, _ in sorted(ranked.items(), key=lambda p: p[1])]
    assert sorted(ranked.values()) == list(range(308)) and all(same(a, b) for a, b in zip(by_rank, ordered, strict=True))


def test_one_bucket_is_sorted(spark):
    """The bucket that holds the position is a range of the key, so other rows are left out before the sort."""
    found = splits.pick_position(spark.range(10_000).withColumnRenamed("id", "pass_id"), 5_000, bucket_rows=500)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.first().pass_id == 5_000 and "Filter" in plan and "Window" not in plan
