from quillspark.operators import classify


def test_fit_may_take_as_many_iterations_as_the_reference(spark):
    rows = [(i, "ab"[i % 2], [float(i % 2), 1.0 + (i % 5) / 10]) for i in range(30)]
    m = classify.LinearClassifier().fit(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"))
    assert {model.getMaxIter() for model, _ in m.models} == {1000}
