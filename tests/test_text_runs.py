from pyspark.sql import functions as F

from quillspark.functions import text


def test_runs_of_any_length(spark):
    blank, close = "\n" * 300, "」" * 20
    rows = [("甲" + blank + "乙\n\n丙。\n\n丁" + blank, "甲\n。" + close + "\n乙\n\n丙\n丁", "甲。" + close + " 乙！ 丙。 丁")]
    out = spark.createDataFrame(rows, "a string, b string, c string").select(text.joined_hard_wraps("a"), text.joined_broken_lines("b"), text.sentences(F.col("c"))).first()
    assert out[0] == "甲" + " " * 300 + "乙  丙。\n丁"
    assert out[1] == "甲 。" + close + "\n乙\n\n丙 丁"
    assert out[2] == ["甲。" + close, "乙！", "丙。", "丁"]


def test_repeated_short_lines_inside_a_row(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import text
    from quillspark.operators import lines

    rows = [(1, "\n".join(["head", " head ", "主旨", "主旨", "", "", "y" * 30, "y" * 30] + [f"line {i}" for i in range(32)])), (2, "a\na"), (3, "\n".join(["a"] * 39)), (4, "\n".join(["a"] * 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = docs.select("doc_id", F.inline(text.let(text.lines("text"), lambda ls: lines.without_repeated_short_lines(ls))))
    want = lines.drop_repeated_short_lines(lines.explode_lines(docs))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, want.collect()))
