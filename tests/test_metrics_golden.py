"""Metric goldens: the published 4-class confusion matrix reproduces its report."""
from faultline.operators import metrics as mt

MATRIX = [[45, 0, 1, 0], [0, 115, 0, 0], [0, 0, 91, 0], [0, 0, 0, 78]]


def test_report_from_matrix(spark):
    rows = mt.report_from_matrix(spark, MATRIX)
    assert rows.count() == 330
    rep = {r["class"]: r for r in mt.class_report(rows, "label", "pred").collect()}
    assert round(rep["accuracy"].f1, 4) == 0.9970
    assert (round(rep["macro avg"].precision, 4), round(rep["macro avg"].recall, 4),
            round(rep["macro avg"].f1, 4)) == (0.9973, 0.9946, 0.9959)
    assert (round(rep["weighted avg"].precision, 4), round(rep["weighted avg"].recall, 4),
            round(rep["weighted avg"].f1, 4)) == (0.9970, 0.9970, 0.9970)
    assert (round(rep["0"].recall, 4), round(rep["2"].precision, 4)) == (0.9783, 0.9891)
    s = mt.summary_scores(rows, "label", "pred").first()
    assert (round(s.accuracy, 4), round(s.f1_macro, 4), round(s.f1_micro, 4)) == (0.9970, 0.9959, 0.9970)


def test_confusion_full_grid(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label INT, pred INT")
    cm = {(r.label, r.pred): r.n for r in mt.confusion_long(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 0} or cm == {(0, 0): 2, (1, 0): 1, (0, 1): 0, (1, 1): 0}
    wide = mt.confusion_matrix(df).orderBy("label").collect()
    assert [tuple(r) for r in wide] == [(0, 2, 0), (1, 1, 0)]
