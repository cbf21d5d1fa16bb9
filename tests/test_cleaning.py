"""Cell-level steps on small frames with hand-computed results."""

import pytest
from pyspark.sql import functions as F

from scrubline.functions import dates, text
from scrubline.operators import cleaning as c
from scrubline.operators.dedup import RemoveDuplicates, exact_duplicate_groups, remove_exact_duplicates
from scrubline.operators.fill import FillDirection
from scrubline.operators.steps import fit_all


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, c {kind}")


def cells(df):
    return [r["c"] for r in df.orderBy("id").collect()]


def run(spark, step, values, kind="string"):
    return cells(step.run(frame(spark, values, kind)))


def test_trim_removes_all_whitespace(spark):
    assert run(spark, c.TrimWhitespace("c"), [" a ", "\tb\n", " c　", "", None]) == ["a", "b", "c", "", None]


@pytest.mark.parametrize("case", ["lower", "upper", "title"])
def test_case_matches_python(spark, case):
    values = ["o'neil mcDONALD", "they're bill's friends", "ÉTÉ à paris", "x-ray 3d", ""]
    assert run(spark, c.NormalizeCase("c", case), values) == [getattr(v, case)() for v in values]


def test_unknown_case_changes_nothing(spark):
    assert run(spark, c.NormalizeCase("c", "camel"), ["Ab"]) == ["Ab"]


def test_fix_encoding(spark):
    good = ["café", "naïve", "日本", "plain", "Ünïcödé €5", None]
    garbled = [None if v is None else v.encode().decode("cp1252", "ignore") if v != "日本" else "æ—¥æœ¬" for v in good]
    assert run(spark, c.FixEncoding("c"), garbled) == good
    assert run(spark, c.FixEncoding("c"), good) == good


def test_convert_price(spark):
    assert run(spark, c.ConvertType("c", "float", ["$", ","]), ["$1,234.56", "$29.99", "N/A"]) == [1234.56, 29.99, None]


def test_convert_rejects_words_that_look_like_numbers(spark):
    assert run(spark, c.ConvertType("c", "float"), ["inf", "nan", "1d", "0x1", "1e3", " 5 ", "."]) == [None] * 4 + [1000.0, 5.0, None]


def test_convert_int_rounds_half_to_even(spark):
    assert run(spark, c.ConvertType("c", "int"), ["0.5", "1.5", "2.5", "-1.5", "x"]) == [0, 2, 2, -2, None]


def test_convert_bool(spark):
    assert run(spark, c.ConvertType("c", "bool"), ["TRUE", "no", "1", "f", "y", "maybe"]) == [True, False, True, False, True, None]


def test_convert_unknown_target_changes_nothing(spark):
    assert run(spark, c.ConvertType("c", "complex"), ["1"]) == ["1"]


def test_parse_dates(spark):
    values = [
        "2024-01-15", "01/22/2024", "Jan 28 2024", "15-03-2024", "June 30, 2022", "2022/01/15", "2024-02-30",
        "5 March 2020", "1st Feb 2021", "2024-01-15T10:20:30Z", "20240115", "N/A", "12", "no date here", None,
    ]
    expected = [
        "2024-01-15", "2024-01-22", "2024-01-28", "2024-03-15", "2022-06-30", "2022-01-15", None,
        "2020-03-05", "2021-02-01", "2024-01-15", "2024-01-15", None, None, None, None,
    ]
    assert run(spark, c.ParseDates("c"), values) == expected
    assert run(spark, c.ParseDates("c", "%d.%m.%Y %H:%M"), ["2024-01-15 10:20"]) == ["15.01.2024 10:20"]


def test_date_formats():
    assert dates.java_format("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    with pytest.raises(ValueError):
        dates.java_format("%Q")


def test_standardize_missing(spark):
    values = ["1", "N/A", "3", "null", " - ", "999", "Na", None]
    assert run(spark, c.StandardizeMissing("c"), values) == ["1", None, "3", None, None, None, "Na", None]
    assert run(spark, c.StandardizeMissing("c", ["?"]), ["?", "N/A"]) == [None, "N/A"]


def test_fills(spark):
    qty = ["1", "N/A", "3", "null", "2"]
    assert run(spark, c.fill_step("c", "mean"), qty) == [1.0, 2.0, 3.0, 2.0, 2.0]
    assert run(spark, c.fill_step("c", "median"), ["1", "", "3", "2", "10"]) == [1.0, 2.5, 3.0, 2.0, 10.0]
    assert run(spark, c.fill_step("c", "mode"), ["b", "a", "b", "a", "-"]) == ["b", "a", "b", "a", "a"]
    assert run(spark, c.fill_step("c", "custom", 0), qty) == ["1", "0", "3", "0", "2"]
    assert run(spark, c.fill_step("c", "drop"), qty) == ["1", "3", "2"]
    assert run(spark, c.fill_step("c", "no such strategy"), qty) == ["1", None, "3", None, "2"]


def test_fill_of_an_empty_column(spark):
    assert run(spark, c.fill_step("c", "mode"), ["-", None]) == [None, None]
    assert run(spark, c.fill_step("c", "median"), ["-", None]) == [None, None]


def test_integer_marker_is_missing(spark):
    assert run(spark, c.fill_step("c", "median"), [1, 999, 3], "int") == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("strategy", ["ffill", "bfill"])
@pytest.mark.parametrize("parts", [1, 7])
def test_directional_fill(spark, strategy, parts):
    values = [None, "a", None, None, "b", "N/A", None] * 30 + [None]
    known = [None if v in (None, "N/A") else v for v in values]
    order = range(len(values)) if strategy == "ffill" else range(len(values) - 1, -1, -1)
    expected, last = [None] * len(values), None
    for i in order:
        last = known[i] if known[i] is not None else last
        expected[i] = last
    df = frame(spark, values).repartition(parts)
    assert cells(FillDirection("c", strategy, "id").run(df)) == expected


def test_directional_fill_within_groups(spark):
    rows = [(i, "x" if i < 180 else f"g{i % 3}", None if i % 5 else str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, c string").repartition(5)
    got = {r["id"]: r["c"] for r in FillDirection("c", "ffill", "id", ["g"]).run(df).collect()}
    last = {}
    for i, g, v in rows:
        last[g] = v if v is not None else last.get(g)
        assert got[i] == last[g]


def test_directional_fill_needs_an_order():
    with pytest.raises(ValueError):
        FillDirection("c", "ffill", None)


def test_outliers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    # Q1 = 2, Q3 = 4: fences at -1 and 7
    assert run(spark, c.HandleOutliers("c", "cap"), values, "double") == [1.0, 2.0, 3.0, 4.0, 7.0, None]
    assert run(spark, c.HandleOutliers("c", "remove"), values, "double") == [1.0, 2.0, 3.0, 4.0, None]
    assert run(spark, c.HandleOutliers("c", "flag"), values, "double") == [1.0, 2.0, 3.0, 4.0, None, None]
    # text without outliers stays text
    assert run(spark, c.HandleOutliers("c", "cap"), ["1", "2", "x"]) == ["1", "2", "x"]


def test_map_categories_small_and_large(spark):
    small = c.MapCategories("c", {"USA": "US", "U.S.": "US"})
    assert run(spark, small, [" USA", "U.S.", "DE", None]) == ["US", "US", "DE", None]
    large = c.MapCategories("c", {str(i): f"v{i}" for i in range(200)})
    assert run(spark, large, ["7", "x", None]) == ["v7", "x", None]


def test_rename_and_drop(spark):
    df = frame(spark, ["a"])
    assert c.RenameColumn("c", "d").run(df).columns == ["id", "d"]
    assert c.DropColumn("c").run(df).columns == ["id"]
    assert c.DropColumn("absent").run(df).columns == ["id", "c"]


def test_duplicates(spark):
    df = spark.createDataFrame([(0, 1, "x"), (1, 2, "y"), (2, 1, "x"), (3, 1, None), (4, 1, None)], "id int, a int, b string")
    ids = lambda out: sorted(r["id"] for r in out.collect())
    assert ids(remove_exact_duplicates(df, "first", order_by="id")) == [0, 1, 3]
    assert ids(remove_exact_duplicates(df, "last", order_by="id")) == [1, 2, 4]
    assert ids(remove_exact_duplicates(df, False, order_by="id")) == [1]
    assert ids(remove_exact_duplicates(df, "first", ["a"], "id")) == [0, 1]
    assert remove_exact_duplicates(df.drop("id")).count() == 3
    groups = {(r["group_id"], r["row_id"], r["n"]) for r in exact_duplicate_groups(df, "id").collect()}
    assert groups == {(0, 0, 2), (0, 2, 2), (3, 3, 2), (3, 4, 2)}
    with pytest.raises(ValueError):
        RemoveDuplicates("middle")


def test_text_and_null_are_different_rows(spark):
    df = spark.createDataFrame([(0, "a", None), (1, None, "a"), (2, "null", "a")], "id int, x string, y string")
    assert exact_duplicate_groups(df, "id").count() == 0


@pytest.mark.parametrize("step", [c.TrimWhitespace("c"), c.NormalizeCase("c", "title"), c.FixEncoding("c"), c.StandardizeMissing("c")])
def test_idempotent(spark, step):
    once = step.run(frame(spark, [" a B", "cafÃ©", "N/A", None, "x"]))
    assert cells(step.run(once)) == cells(once)


def test_fits_are_shared_and_reusable(spark):
    df = frame(spark, ["1", None, "3"]).withColumn("d", F.lit(2.0))
    fitted = fit_all(df, [c.fill_step("c", "mean"), c.fill_step("d", "median")])
    assert fitted[0].stats["fill"] == 2.0 and fitted[1].stats["fill"] == [2.0]
    later = frame(spark, [None]).withColumn("d", F.lit(1.0))
    assert cells(fitted[0].transform(later)) == [2.0]


def test_strip_covers_python_whitespace():
    assert all(ch.isspace() for ch in text.WHITESPACE)
