"""Classification measures and parity against small brute-force figures."""

import random

import pytest

from brevia.operators import metrics, parity


def scored(spark, scores, labels):
    return spark.createDataFrame(list(zip(scores, labels)), "scores array<double>, label int")


def predicted(spark, pairs):
    return spark.createDataFrame(pairs, "label int, pred int")


def test_perfect(spark):
    scores = [[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9]]
    assert metrics.compute_metrics(scored(spark, scores, [0, 1, 2])).first().asDict() == {
        "accuracy": 1.0, "f1_macro": 1.0}


def test_partly_right(spark):
    scores = [[0.9, 0.05, 0.05], [0.9, 0.05, 0.05], [0.05, 0.05, 0.9]]
    row = metrics.compute_metrics(scored(spark, scores, [0, 1, 2])).first()
    assert row.accuracy == pytest.approx(2 / 3) and row.f1_macro == pytest.approx(5 / 9)


def test_only_classes_seen_count(spark):
    row = metrics.compute_metrics(scored(spark, [[0.9, 0.05, 0.05]], [0])).first()
    assert (row.accuracy, row.f1_macro) == (1.0, 1.0)


def test_argmax_takes_the_first_of_equals(spark):
    cases = [([1.0, 1.0, 0.0], 0), ([0.0, 2.0, 2.0], 1), ([0.0, 0.0, 0.0], 0),
             ([float("nan"), 5.0, 1.0], 0), ([-3.0, -2.0, -1.0], 2)]
    rows = metrics.with_prediction(scored(spark, [c for c, _ in cases], [p for _, p in cases]))
    assert all(r.pred == r.label for r in rows.collect())


def brute(pairs):
    classes = sorted({x for pair in pairs for x in pair})
    out = {}
    for c in classes:
        tp = sum(t == c and p == c for t, p in pairs)
        truth, guess = sum(t == c for t, _ in pairs), sum(p == c for _, p in pairs)
        out[c] = (tp / guess if guess else 0.0, tp / truth if truth else 0.0,
                  2 * tp / (truth + guess), truth)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_report_and_matrix(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice([0, 1]) if seed == 1 else rng.randrange(3), rng.randrange(3))
             for _ in range(60)]
    expected = brute(pairs)
    df = predicted(spark, pairs)
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    for c, (p, r, f, n) in expected.items():
        assert tuple(report[str(c)])[1:] == pytest.approx((p, r, f, n))
    total = sum(v[3] for v in expected.values())
    macro = [sum(v[i] for v in expected.values()) / len(expected) for i in range(3)]
    weighted = [sum(v[i] * v[3] for v in expected.values()) / total for i in range(3)]
    assert list(report["macro avg"])[1:4] == pytest.approx(macro)
    assert list(report["weighted avg"])[1:4] == pytest.approx(weighted)
    accuracy = sum(t == p for t, p in pairs) / total
    assert report["accuracy"].f1_score == pytest.approx(accuracy)
    assert report["accuracy"].precision is None and report["accuracy"].support == total
    matrix = {r.label: [r.pred_0, r.pred_1, r.pred_2] for r in metrics.confusion_matrix(df).collect()}
    assert matrix == {t: [pairs.count((t, p)) for p in range(3)] for t in range(3)}
    row = metrics.evaluate(df).first()
    assert (row.accuracy, row.f1_macro) == pytest.approx((accuracy, macro[2]))


def test_no_rows(spark):
    none = spark.createDataFrame([], "label int, pred int")
    assert tuple(metrics.evaluate(none).first()) == (None, None)
    assert [tuple(r)[1:] for r in metrics.confusion_matrix(none).collect()] == [(0, 0, 0)] * 3


def outputs(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, value string")


def test_parity(spark):
    left = outputs(spark, ["a", "b", None, "", "x" * 100])
    same = parity.parity_check(left, left, "value").first()
    assert tuple(same) == (5, 5, True, 0)
    right = outputs(spark, ["a", "B", "", None, "x" * 99 + "y"])
    assert tuple(parity.parity_check(left, right, "value").first()) == (5, 5, False, 4)
    shown = parity.parity_mismatches(left, right, "value").collect()
    assert [r.id for r in shown] == [1, 2, 3] and (shown[0].left_text, shown[0].right_text) == (
        "b...", "B...")


def test_parity_with_other_row_counts(spark):
    left, right = outputs(spark, ["a", "b", "c"]), outputs(spark, ["x"])
    assert tuple(parity.parity_check(left, right, "value").first()) == (3, 1, False, 2)


def test_parity_of_a_repeated_key_does_not_multiply(spark):
    many = spark.range(0, 2000).selectExpr("1 AS id", "'v' AS value")
    assert tuple(parity.parity_check(many, many, "value").first()) == (2000, 2000, True, 0)
    plan = parity.parity_check(many, many, "value")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_confusion_matrix_refuses_unknown_classes(spark):
    df = spark.createDataFrame([(0, 3), (3, 0), (0, 0)], "label int, pred int")
    for part in (df, df.filter("label = 3"), df.filter("pred = 3")):
        with pytest.raises(Exception, match="none of 3 classes"):
            metrics.confusion_matrix(part).collect()
    assert metrics.confusion_matrix(df, classes=4).count() == 4


def test_null_keys_are_compared(spark):
    def one(*rows):
        return spark.createDataFrame(list(rows), "id int, text string")

    left, right = one((None, "a"), (1, "x")), one((None, "b"), (1, "x"))
    assert tuple(parity.parity_check(left, right, "text").first()) == (2, 2, False, 1)
    assert [tuple(r) for r in parity.parity_mismatches(left, right, "text").collect()] == [
        (None, "a...", "b...")]
    assert parity.parity_check(left, left, "text").first().all_match
