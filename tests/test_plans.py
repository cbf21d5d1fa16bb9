"""Plans, profiles, validation, audit and sources on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from scrubline.operators import profile as p
from scrubline.operators import validate as v
from scrubline.plans import audit
from scrubline.plans.actions import Action, Plan, register_action
from scrubline.plans.execute import run_plan
from scrubline.plans.prepare import prepare, propose
from scrubline.plans.recommend import recommend_features
from scrubline.session import shared_path
from scrubline.sources import readers, sinks

SALES = [
    ("1", " Ann ", "ann@x.org", "$1,234.56", "2", "2024-01-15", "US"),
    ("2", "Bob", "bob@x.org", "$29.99", "N/A", "01/22/2024", "us"),
    ("3", "Cy", "cy@x.org", "$49.99", "3", "Jan 28 2024", "US"),
    ("4", "Di", "di@x.org", "$59.99", "null", "15-03-2024", "US"),
    ("5", "Ed", "ed@x.org", "$39.99", "4", "2024-05-01", "DE"),
    ("3", "Cy", "cy@x.org", "$49.99", "3", "Jan 28 2024", "US"),
] + [(str(i), f"N{i}", f"n{i}@x.org", f"${i}.50", str(i % 5), "2024-06-01", "US") for i in range(20, 40)]
COLUMNS = ["order_id", "name", "email", "price", "qty", "day", "country"]


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(i, *r) for i, r in enumerate(SALES)]
    return spark.createDataFrame(rows, ["row_id", *COLUMNS])


def test_profile(sales):
    rows = {r["column_name"]: r for r in p.profile_table(sales.drop("row_id")).collect()}
    kinds = {c: rows[c]["detected_type"] for c in COLUMNS}
    assert kinds == {
        "order_id": "numeric", "name": "text", "email": "text", "price": "numeric", "qty": "numeric",
        "day": "datetime", "country": "categorical",
    }
    assert rows["qty"]["missing_count"] == 2 and rows["qty"]["encoded_as"] == ["N/A", "null"]
    assert rows["email"]["semantic_type"] == "email" and rows["price"]["semantic_type"] == "currency"
    assert rows["country"]["normalised_count"] == 2
    assert [t["value"] for t in rows["country"]["top_values"]][:1] == ["US"]
    assert any(i.startswith("spellings=") and i.endswith("/2") for i in rows["country"]["issues"])
    assert rows["price"]["outlier_count"] >= 1
    assert 0 <= rows["qty"]["quality_score"] < 100


def test_profile_types(spark):
    df = spark.createDataFrame(
        [("yes", "x1", None, 1, 0.5), ("No", "x2", "-", 0, 999.0), ("t", "x3", "", 1, None)],
        "b string, t string, u string, i int, d double",
    )
    rows = {r["column_name"]: r for r in p.profile_table(df).collect()}
    assert [rows[c]["detected_type"] for c in "btuid"] == ["boolean", "text", "unknown", "boolean", "numeric"]
    assert rows["u"]["missing_count"] == 3 and rows["d"]["missing_count"] == 1
    assert rows["u"]["quality_score"] == 0.0


def test_profile_does_not_depend_on_partitioning(sales):
    one = p.profile_table(sales.coalesce(1)).collect()
    assert one == p.profile_table(sales.repartition(7)).collect()


def test_scores(spark):
    df = spark.createDataFrame([(str(i),) for i in range(50)] + [("100000",)], "c string")
    by_mean = p.profile_table(df).first()["quality_score"]
    by_rows = p.profile_table(df, score="rate").first()["quality_score"]
    assert by_mean != by_rows and 0 <= min(by_mean, by_rows)


def test_approximate_cardinality(sales):
    exact = {r[0]: r[1] for r in p.cardinality_profile(sales).collect()}
    rough = {r[0]: r[1] for r in p.cardinality_profile(sales, exact=False).collect()}
    assert exact.keys() == rough.keys()
    assert all(abs(exact[c] - rough[c]) <= 1 + 0.05 * exact[c] for c in exact)


def test_plan_runs_in_order_and_logs(sales):
    plan = Plan(
        [
            Action("a1", "trim_whitespace", "name"),
            Action("a2", "convert_type", "price", {"target_type": "float"}),
            Action("a3", "fill_missing", "qty", {"strategy": "median"}),
            Action("a4", "normalize_case", "country", {"case": "upper"}),
            Action("a5", "parse_dates", "day"),
            Action("a6", "handle_outlier", "price", {"action": "cap"}),
            Action("a7", "remove_duplicates", None),
            Action("a8", "drop_column", "email"),
            Action("a9", "rename_column", "day", {"new_name": "date"}),
            Action("b1", "trim_whitespace", "absent"),
            Action("b2", "parse_dates", "date", {"target_format": "%Q"}),
            Action("b3", "normalize_case", "name", {"case": "upper"}, approved=False),
        ]
    )
    run = run_plan(sales, plan, "row_id")
    rows = {r["action_id"]: r for r in run.log().collect()}
    assert run.df.columns == ["row_id", "order_id", "name", "price", "qty", "date", "country"]
    assert run.df.count() == len(SALES) - 1
    changed = {k: r["rows_affected"] for k, r in rows.items()}
    # the text "2" and the number 2.0 are the same number: only filled cells count
    assert changed == {
        "a1": 1, "a2": 26, "a3": 2, "a4": 1, "a5": 4, "a6": 2, "a7": 1, "a8": 1, "a9": 1, "b1": 0, "b2": 0,
    }
    assert rows["b1"]["status"] == "skipped" and rows["b2"]["status"] == "failed"
    assert rows["a1"]["before_sample"][0] == " Ann " and rows["a1"]["after_sample"][0] == "Ann"
    assert run.executed == 11 and run.succeeded == 10
    assert run.totals()["total_rows_modified"] == sum(changed.values())


def test_one_bad_action_does_not_spoil_its_batch(sales):
    plan = Plan(
        [
            Action("a", "fill_missing", "qty", {"strategy": "mean"}),
            Action("b", "target_encode", "name", {"target_column": "absent"}),
            Action("c", "power_transform", "price", {"method": "box-cox"}),
            Action("d", "trim_whitespace", "name"),
        ]
    )
    run = run_plan(sales, plan, "row_id")
    assert [r.status for r in run.records] == ["succeeded", "failed", "failed", "succeeded"]


def test_feature_plan(spark):
    df = spark.createDataFrame([(float(i), "AB"[i % 2], ["low", "high"][i % 2], float(2**i)) for i in range(12)], "age double, kind string, tier string, pay double")
    plan = Plan(
        [
            Action("f1", "one_hot_encode", "kind", {"drop_first": True}),
            Action("f2", "label_encode", "tier", {"order": ["low", "high"]}),
            Action("f3", "log_transform", "pay"),
            Action("f4", "standard_scale", "age"),
            Action("f5", "min_max_scale", "pay", approved=False),
            Action("f6", "interaction_features", None, {"column_pairs": [["age", "pay"]]}),
            Action("f7", "min_max_scale", "age_x_pay"),
            Action("f8", "standard_scale", "age", {"nonsense": 1}),
        ]
    )
    run = run_plan(df, plan)
    assert [r.status for r in run.records] == ["succeeded"] * 6 + ["failed"]
    assert run.df.columns == ["age", "tier", "pay", "kind_B", "age_x_pay"]
    row = run.df.agg(F.avg("age").alias("m"), F.min("age_x_pay").alias("lo"), F.max("age_x_pay").alias("hi")).first()
    assert row["m"] == pytest.approx(0) and (row["lo"], row["hi"]) == (0.0, 1.0)
    assert run.totals()["columns_added_total"] == 2 and run.totals()["columns_removed_total"] == 1


def test_plan_json_review_and_tables(spark):
    plan = Plan.from_json(json.dumps({"actions": [
        {"id": "x", "action_type": "trim_whitespace", "column_name": "c", "priority": "high"},
        {"action_type": "fill_missing", "column_name": "c", "parameters": {"strategy": "mode"}},
        {"action_type": "launch_rocket"},
    ], "estimated_rows_affected": 9}))
    assert [a.id for a in plan.actions] == ["x", "action_002"]
    plan = plan.reject().approve("x").edit("action_002", strategy="median")
    assert [a.id for a in plan.approved()] == ["x"]
    assert plan.actions[1].parameters == {"strategy": "median"}
    assert Plan.from_json(plan.to_json()) == plan
    assert tuple(plan.summary(spark).first()) == (2, 1, 1, 9)


def test_own_action_type(spark):
    from scrubline.operators.cleaning import CellStep

    class Reverse(CellStep):
        def cell(self, df, stats):
            return F.reverse(self.column)

    register_action("reverse_text", lambda a, order: Reverse(a.column_name))
    df = spark.createDataFrame([("ab",)], "c string")
    assert run_plan(df, Plan([Action("a", "reverse_text", "c")])).df.first()["c"] == "ba"


def test_prepare(spark, sales):
    path = shared_path(spark, "audit")
    done = prepare(sales, "row_id", features=True, target_column="price", audit_path=path)
    passed = {c[0]: c[1] for c in done.report.checks}
    assert passed["no_repeated_rows"] and passed["rows_kept"] and passed["actions_succeeded"]
    assert done.report.summary["after_quality_score"] >= done.report.summary["before_quality_score"]
    assert done.cleaned.count() == len(SALES) - 1 == done.features.df.count()
    assert done.features.succeeded == done.features.executed
    history = audit.audit_history(spark, path).collect()
    assert sorted(e["event_type"] for e in history) == ["cleaning", "feature_engineering"]
    assert done.summary().first()["rows_before"] == len(SALES)


def test_recommended_plans(sales):
    _, plan = propose(sales, "row_id")
    kinds = [a.action_type for a in plan.actions]
    assert kinds == sorted(kinds, key=__import__("scrubline.plans.recommend", fromlist=["x"]).CLEANING_ORDER.index)
    assert kinds[-1] == "remove_duplicates" and len({a.id for a in plan.actions}) == len(kinds)
    assert ("qty", "fill_missing") in {(a.column_name, a.action_type) for a in plan.actions}
    features = recommend_features(sales.drop("row_id"))
    assert {a.action_type for a in features.actions if a.column_name == "country"} == {"one_hot_encode"}


def test_addresses_that_differ_in_case_are_lowered(spark):
    rows = [(i, f"user{i % 40}@mail.example") for i in range(120)]
    mixed = rows + [(200 + i, f"User{i}@Mail.example") for i in range(20)]
    for table, wanted in ((rows, False), (mixed, True)):
        df = spark.createDataFrame(table, "row_id long, email string")
        _, plan = propose(df, "row_id")
        kinds = {a.action_type for a in plan.actions if a.column_name == "email"}
        assert ("normalize_case" in kinds) == wanted and "standardize_categorical" not in kinds
        assert run_plan(df, plan, "row_id").df.select("email").distinct().count() == 40


def test_other_errors_end_the_run(sales, monkeypatch):
    """A fault of the plan is logged; a lost task must not look like a finished run."""
    from scrubline.operators import cleaning

    def lost(self, df, stats):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(cleaning.TrimWhitespace, "cell", lost)
    with pytest.raises(RuntimeError):
        run_plan(sales, Plan([Action("a", "trim_whitespace", "name")]), "row_id")


def test_text_cells_of_a_number_fill(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["1", "twenty", "N/A", "3"])], "id long, q string")
    run = run_plan(df, Plan([Action("a", "fill_missing", "q", {"strategy": "mean"})]), "id")
    assert run.records[0].status == "failed" and run.df.collect() == df.collect()
    run = run_plan(df, Plan([Action("a", "fill_missing", "q", {"strategy": "mean", "text_cells": "fill"})]), "id")
    assert [r["q"] for r in run.df.orderBy("id").collect()] == [1.0, 2.0, 2.0, 3.0]


def test_identifiers_stay_whole(spark):
    df = spark.createDataFrame([(i, 10**17 + i if i else 999, f"{i}") for i in range(60)], "row_id long, order_id long, code string")
    out = prepare(df, "row_id").cleaned
    assert dict(out.dtypes) == {"row_id": "bigint", "order_id": "bigint", "code": "bigint"}
    assert out.agg({"order_id": "max"}).first()[0] == 10**17 + 59


def test_header_names():
    assert readers.header_names("a,b,a,,A", ",") == ["a", "b", "a.1", "column_4", "A.2"]


def test_rejected_lines_are_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,2\n3,4,5\n6,7,8,9\n')
    source = readers.read_delimited(spark, str(tmp_path))
    assert [tuple(r) for r in source.df.collect()] == [("1", "2")]
    assert sorted(r[readers.LINE] for r in source.rejected.collect()) == ["3,4,5", "6,7,8,9"]
    assert source.warnings == ["2 rows with more cells than the header"]
    assert readers.file_metadata(spark, str(tmp_path), "csv").first()["rejected_rows"] == 2


def test_checks(spark):
    assert v.row_count_check(100, 85) == ("rows_kept", True, 100.0, 85.0, [], "warning")
    assert not v.row_count_check(100, 80)[1] and not v.row_count_check(5, 0)[1]
    assert v.success_rate_check(0, 0)[1] and not v.success_rate_check(8, 10)[1]
    assert v.after_score(70, 10, 4, 30, 0) == 92.0 and v.after_score(99, 50, 0, 50, 0) == 100.0
    df = spark.createDataFrame([("1", None), ("two", None), ("3", None)], "m string, n string")
    assert v.mixed_types_check(v.text_facts(df).collect())[4] == ["m(number,text)"]
    assert v.null_columns_check(v.table_counts(df))[4] == ["n"]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;name\n1;"x;y"\n2;b;extra\n3\n', encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("id,name,more\n4,café,z\n".encode("cp1252"))
    source = readers.read_delimited(spark, str(tmp_path))
    rows = sorted(tuple(r[c] for c in ("id", "name", "more")) for r in source.df.collect())
    assert [r[0] for r in rows] == ["1", "3", "4"] and rows[0][1] == "x;y" and rows[1][1] is None and rows[2][1:] == ("café", "z")
    assert [r["id"] for r in source.rejected.collect()] == ["2"]
    sniffed = {r["path"][-5:]: (r["delimiter"], r["encoding"]) for r in readers.sniff_files(spark, str(tmp_path)).collect()}
    assert sniffed == {"a.csv": (";", "UTF-8"), "b.csv": (",", "windows-1252")}
    meta = {r["file_name"]: (r["row_count"], r["col_count"]) for r in readers.file_metadata(spark, str(tmp_path), "csv").collect()}
    assert meta == {"a.csv": (2, 2), "b.csv": (1, 3)}


def test_utf8_ranges():
    data = "aé日x".encode()
    for cut in range(len(data) + 1):
        assert readers._valid_utf8(data[:cut], True) and readers._valid_utf8(data[cut:], cut == 0)
    assert not readers._valid_utf8(b"caf\xe9 au lait", True)


def test_json(spark, tmp_path):
    doc = {"status": "ok", "data": {"users": [{"id": 1, "at": {"city": "X"}, "tags": ["a"]}, {"id": "2", "at": None, "tags": []}]}, "page": {"n": 1}}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    out = readers.read_any(spark, str(tmp_path / "d.json")).df
    assert sorted(out.columns) == ["at.city", "id", "tags"]
    assert sorted((r["id"], r["at.city"], r["tags"]) for r in out.collect()) == [("1", "X", '["a"]'), ("2", None, "[]")]
    (tmp_path / "l.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert readers.read_any(spark, str(tmp_path / "l.json")).df.count() == 2
    (tmp_path / "r.json").write_text(json.dumps({"a": {"b": 1}}))
    root = readers.read_any(spark, str(tmp_path / "r.json"))
    assert root.df.columns == ["a.b"] and root.warnings


def test_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<?xml version="1.0"?><!-- <no> --><c><p id="1"><n>A</n><price cur="USD">9</price><t>x</t><t>y</t></p><p id="2"><n>B</n></p></c>')
    out = readers.read_any(spark, str(tmp_path / "c.xml")).df
    assert sorted(out.columns) == ["id", "n", "price.cur", "price.value", "t"]
    assert sorted((r["id"], r["price.value"], r["t"]) for r in out.collect()) == [("1", "9", "x|y"), ("2", None, None)]


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        readers.read_any(spark, "x.docx")
    assert ".csv" in readers.supported_formats()


def test_ingest(spark):
    df = spark.createDataFrame([(" a", None, " "), (None, None, ""), ("b", None, None)], "` x ` string, y string, z string")
    out = readers.ingest_normalize(df, "row_id")
    assert out.columns == ["x", "row_id"] and [r["x"] for r in out.collect()] == [" a", "b"]


def test_file_hash(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert readers.file_hashes(spark, str(tmp_path)).first()["sha256"].startswith("ba7816bf")


def test_sinks(spark, sales, tmp_path):
    nested = sales.withColumn("tags", F.array("name"))
    sinks.write_csv(nested, str(tmp_path / "o"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "o"))
    assert back.columns == nested.columns and back.count() == len(SALES)
    changed = sinks.changed_cells(sales, sales.withColumn("name", F.trim("name")), "row_id").collect()
    assert [tuple(r) for r in changed] == [(0, "name", " Ann ", "Ann")]


def staged_plan():
    steps = [
        ("trim_whitespace", "t", {}), ("normalize_case", "t", {"case": "upper"}), ("convert_type", "x", {"target_type": "float"}),
        ("fill_missing", "x", {"strategy": "median"}), ("handle_outlier", "x", {"action": "cap"}), ("rename_column", "t", {"new_name": "u"}),
        ("fill_missing", "u", {"strategy": "mode"}), ("fill_missing", "y", {"strategy": "ffill"}), ("remove_duplicates", None, {"keep": "first"}),
        ("trim_whitespace", "absent", {}),
    ]
    return Plan([Action(f"a{i}", kind, name, params) for i, (kind, name, params) in enumerate(steps)])


def staged_rows(spark, n=300):
    cell = lambda i, xs: xs[i * 7 % len(xs)]
    rows = [(i, cell(i, [" a", "b", None, "N/A", "A "]), cell(i, ["1", "2", " 3", None, "900", "4.0"]), cell(i, [None, 5, None, 7])) for i in range(n)]
    rows += [(n + i, *rows[i][1:]) for i in range(20)]
    return spark.createDataFrame(rows, "id long, t string, x string, y long")


def test_a_staged_run_gives_the_same_frame_and_log(spark):
    df = staged_rows(spark).repartition(4)
    lazy, staged = run_plan(df, staged_plan(), "id"), run_plan(df, staged_plan(), "id", staged=True)
    assert [r.status for r in staged.records] == [r.status for r in lazy.records]
    assert sorted(map(str, staged.df.collect())) == sorted(map(str, lazy.df.collect()))
    counted = [r.rows_affected for r in staged.records if r.action.action_type in ("trim_whitespace", "convert_type", "handle_outlier") and r.step]
    assert len(counted) == 3 and None not in counted
    assert [tuple(r) for r in staged.log().collect()] == [tuple(r) for r in lazy.log().collect()]


def test_samples_look_further_when_the_first_rows_hold_too_few(spark, monkeypatch):
    from scrubline.plans import execute

    df = staged_rows(spark)
    want = [tuple(r) for r in run_plan(df, staged_plan(), "id").log().collect()]
    monkeypatch.setattr(execute, "SAMPLE_ROWS", 3)
    assert [tuple(r) for r in run_plan(df, staged_plan(), "id", staged=True).log().collect()] == want


def test_counts_that_tasks_reported_twice_are_not_used(spark, monkeypatch):
    from scrubline.plans import execute

    class Twice(execute.Observation):
        @property
        def get(self):
            return {k: 2 * v for k, v in super().get.items()}

    df = staged_rows(spark)
    want = [r["rows_affected"] for r in run_plan(df, staged_plan(), "id").log(samples=False).collect()]
    monkeypatch.setattr(execute, "Observation", Twice)
    run = run_plan(df, staged_plan(), "id", staged=True)
    assert run.records[0].rows_affected is None
    assert [r["rows_affected"] for r in run.log(samples=False).collect()] == want


def test_a_run_from_a_path_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    import hashlib

    from scrubline.plans import prepare as prep

    data = tmp_path / "shop.csv"
    data.write_text("price,kind\n" + "".join(f"${i % 9}.5, toys \n" for i in range(60)) + "N/A,food\n\n")
    home, audit = str(tmp_path / "home"), str(tmp_path / "audit")
    done = []

    def counted(name, at=None):
        real = getattr(prep, name)

        def call(*args, **kw):
            done.append(name)
            if len(done) == at:
                raise RuntimeError("killed")
            return real(*args, **kw)

        monkeypatch.setattr(prep, name, call)

    for name in ("read_any", "propose", "run_plan", "validate"):
        counted(name)
    call = lambda: prep.prepare_path(spark, str(data), home, audit_path=audit)
    real = prep.run_plan
    monkeypatch.setattr(prep, "run_plan", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        call()
    assert done == ["read_any", "read_any", "propose"]
    monkeypatch.setattr(prep, "run_plan", real)
    validate = prep.validate
    monkeypatch.setattr(prep, "validate", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        call()
    monkeypatch.setattr(prep, "validate", validate)
    first = call()
    assert done == ["read_any", "read_any", "propose", "run_plan", "validate"]
    event = spark.read.json(audit).collect()
    assert len(event) == 1
    assert event[0]["file_hash"] == hashlib.sha256(data.read_bytes()).hexdigest()
    assert event[0]["file_format"] == "csv" and event[0]["file_name"] == "shop.csv"
    assert event[0]["rows_modified"] == first.run.totals()["total_rows_modified"] > 0
    assert first.run.log().count() == first.run.executed
    # other content is another run
    data.write_text("price,kind\n1,a\n2,b\n")
    prep.prepare_path(spark, str(data), home)
    assert done.count("propose") >= 2
