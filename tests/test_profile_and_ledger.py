"""Verdicts on tables, and the gates of the ledger on rows made by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger as lg
from tidemark.operators import profile as pr


def test_names_decide_in_their_order(spark):
    t = spark.createDataFrame([(1, 2, 3)], "target int, label int, outcome int")
    assert pr.detect_target(t) == "label" and pr.detect_target(t.drop("label")) == "target" and pr.detect_target(t, target="outcome") == "outcome"
    with pytest.raises(ValueError):
        pr.detect_target(t.select(F.col("target").alias("a"), F.col("label").alias("b")))


@pytest.mark.parametrize(
    "values, kind, want",
    [([1, 2, None, 1], "int", ("binary", "gini")), ([1, 2, 3], "int", ("multiclass", "spearman")), ([1.0, 2.0, 3.0], "double", ("regression", "pearson")), (list(range(21)), "int", ("regression", "pearson")), (["a", "b", "c"], "string", ("regression", "pearson"))],
)
def test_task_and_metric(spark, values, kind, want):
    assert pr.detect_task_metric(spark.createDataFrame([(v,) for v in values], f"y {kind}"), "y") == want


@pytest.mark.parametrize("values", [[], [None, None], [3, 3]])
def test_a_target_needs_two_values(spark, values):
    with pytest.raises(ValueError):
        pr.detect_task_metric(spark.createDataFrame([(v,) for v in values], "y int"), "y")


def test_ids_and_categories(spark):
    rows = [(i, f"k{i}", i if i else None, i // 2, "ab"[i % 2], i % 20, float(i)) for i in range(60)]
    t = spark.createDataFrame(rows, "a long, b string, once_null long, half int, cat string, few int, real double")
    assert pr.detect_ids(t) == ["a", "b", "once_null"] and pr.detect_categoricals(t, ["half", "cat", "few", "real"]) == ["cat", "few"]
    assert pr.detect_ids(t.limit(0)) == []


def test_time_by_name_by_type_and_by_likeness(spark):
    day = datetime.date(2020, 1, 1)
    assert pr.detect_time(spark.createDataFrame([(1, 2)], "a int, UpdateTimes int"), ["a"]) == ("temporal", "UpdateTimes")
    assert pr.detect_time(spark.createDataFrame([(1, day)], "a int, d date"), ["a"]) == ("temporal", "d")
    trend = spark.createDataFrame([(i, float(i), float("nan")) for i in range(400)], "row_idx long, x double, y double")
    assert pr.detect_time(trend, ["x", "y"]) == ("temporal", None) and pr.detect_time(trend.limit(150), ["x"]) == ("tabular", None)
    noise = spark.createDataFrame([(i, float(i * 7919 % 101)) for i in range(400)], "row_idx long, x double")
    assert pr.detect_time(noise.withColumn("x", F.rand(3)), ["x"]) == ("tabular", None) and pr.detect_time(noise.drop("row_idx"), ["x"]) == ("tabular", None)


def test_a_whole_profile(spark):
    rows = [(i, i % 4, "xyz"[i % 3], float(i * 31 % 17), i % 3) for i in range(300)]
    t = spark.createDataFrame(rows, "key long, season int, kind string, x double, label int")
    p = pr.profile_table(t)
    assert (p["target"], p["task"], p["metric"], p["id_cols"], p["categorical_cols"], p["group_col"], p["n_rows"], p["n_features"]) == ("label", "multiclass", "spearman", ["key"], ["season", "kind"], "season", 300, 3)
    assert len(p["notes"]) == 4 and pr.profile_row(spark, p).count() == 1


def test_sensor_recommends_gini_for_all_classes(spark):
    t = spark.createDataFrame([(i, float(i % 3), float(i % 2), i * 0.5, float(i)) for i in range(300)], "row_idx long, three double, two double, y double, x double")
    got = {y: pr.target_sensor(t, y, ["x"]).first() for y in ("three", "two", "y")}
    assert [(r["task"], r["metric"]) for r in got.values()] == [("multiclass", "gini"), ("binary", "gini"), ("regression", "pearson")] and got["y"]["temporal"]


# --- gates

GOOD = {"impact_id": "i", "surface_id": "s", "source_kind": "operation:route_carve", "source_id": "o", "coordinate": "here", "operator_move": "residual_add", "local_effect": 0.86, "global_effect": 0.78, "false_agreement_risk": 0.04, "false_disagreement_risk": 0.12, "overfit_risk": 0.05, "foundation_stress_delta": 0.06, "branch_priority": 0.72}
CARVE = {"operation_id": "o", "operation_type": "route_carve", "rehab_stage": "residual_add", "lens": "rank", "external_private": 0.086, "external_public": 0.067}


def made(spark, rows, schema):
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def gate(spark, impact, operation, routes=(), against=()):
    out = lg.evidence_gate(
        made(spark, [GOOD | impact], lg.IMPACT), made(spark, [operation] if operation else [], lg.OPERATION),
        spark.createDataFrame([(r,) for r in routes], "operator_type string"), spark.createDataFrame([(a,) for a in against], "scope string"),
    )
    return out.first()


def test_a_stressed_falsely_agreeing_branch_is_a_hazard(spark):
    g = gate(spark, {"local_effect": 0.91, "global_effect": 0.18, "false_agreement_risk": 0.72, "overfit_risk": 0.67, "foundation_stress_delta": 0.66, "branch_priority": 0.80}, CARVE)
    assert (g["promotion_allowed"], g["branch_allowed"], g["decision"]) == (0, 0, "reject_but_remember_as_hazard")


def test_a_supported_candidate_is_retested(spark):
    g = gate(spark, {}, CARVE, ["residual_add:rank"])
    assert (g["evidence_grade"], g["promotion_allowed"], g["decision"], g["support_count"]) == ("A_supported_candidate", 1, "candidate_retest_for_main_world", 2)
    assert "shipping court" in g["required_next_evidence"]


def test_support_elsewhere_does_not_promote(spark):
    g = gate(spark, {"local_effect": 0.90, "global_effect": 0.82, "branch_priority": 0.80}, {k: v for k, v in CARVE.items() if not k.startswith("external")}, ["residual_add:rank"] * 5)
    assert (g["evidence_grade"], g["promotion_allowed"], g["branch_allowed"], g["support_count"]) == ("B_branch_with_retest", 0, 1, 5)


def test_contradictions_raise_the_drift(spark):
    calm, loud = gate(spark, {}, CARVE, ["residual_add:rank"]), gate(spark, {}, CARVE, ["residual_add:rank"], ["here"] * 9 + ["there"])
    assert abs(loud["drift_risk"] - calm["drift_risk"] - 0.2) < 1e-9


def test_external_references_carry_no_selection(spark):
    none = spark.createDataFrame([], "x int")
    scores = spark.createDataFrame([("external.csv", "an External Reference"), ("own.csv", "a route carve")], "filename string, description string")
    rows = {r["validation_world"]: r for r in lg.validation_ledger(none, none, none, scores).collect()}
    assert len(rows) == 8 and rows["external_reference_only"]["selection_use_count"] == 0 and rows["external_reference_only"]["policy"] == "reference_only_never_weight"
    assert rows["external_private_score_context"]["candidate_count_seen"] == 1 and rows["blend_review_surface"]["policy"] == "inactive"


def test_stress_names_its_worst_surfaces_and_counts_runless_ones_twice(spark):
    rows = [{"surface_id": f"s{i:02}", "source_kind": "path:x", "run": "r" if i else None, "uncertainty": i / 20, "overfit_risk": float("nan")} for i in range(15)]
    s = made(spark, rows, lg.SURFACE)
    out = {(r["run"], r["source_group"]): r for r in lg.foundation_stress(s, lg.impact_field(s)).collect()}
    assert {k: r["n_surface_records"] for k, r in out.items()} == {("r", "path"): 14, ("global", "path"): 16, ("global", "all"): 15}
    assert out["global", "all"]["top_stress_sources"].split("|") == [f"s{i:02}" for i in range(14, 2, -1)] and out["r", "path"]["mean_overfit"] is None


def test_claims_against_each_other(spark):
    s = made(spark, [{"source_id": "a", "agreement_score": 0.3, "false_agreement_risk": 0.03, "false_disagreement_risk": 0.2, "coordinate": "c"}], lg.SURFACE)
    o = made(spark, [CARVE | {"weight_route_information_gain": -0.5}], lg.OPERATION)
    p = spark.createDataFrame([("p", "pca", 0.2, 1.0), ("q", "pca", 0.2, 0.0)], "projection_id string, method string, hazard_bias double, downstream_path_gain double")
    rows = {r["dst_claim"]: r for r in lg.contradictions(s, made(spark, [GOOD | {"foundation_stress_delta": 0.4}], lg.IMPACT), p, o).collect()}
    assert set(rows) == {"a:false_agreement_risk", "a:false_disagreement_risk", "p:projection_has_hazard", "o:route_information_gain_negative", "o:private_public_gap", "i:foundation_stress_delta_high"}
    assert rows["o:route_information_gain_negative"]["confidence"] == 1.0
