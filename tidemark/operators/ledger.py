"""What a search has learnt so far: effects of moves, stress of the ground they stand on, strength of routes, trust left in validation worlds, gates and contradictions.

All tables are joins, groups and expressions over tables of surfaces (places where a signal was seen), operations (moves that were made)
and scores. A column that an input lacks counts as unknown. Unknown and non-finite numbers are left out of means, and are 0 where a
formula needs a number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import stable_id
from tidemark.operators.scores import is_external

SALTS = 64


def with_all(df: DataFrame, names: str) -> DataFrame:
    """With a null column for every name (names with a type, as in a schema) that it lacks; numbers that aren't finite become null."""
    out = {}
    for part in names.split(", "):
        name, kind = part.split(" ")
        c = F.expr(f"try_cast(`{name}` as {kind})") if name in df.columns else F.lit(None).cast(kind)
        out[name] = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c) if kind == "double" else c
    return df.withColumns(out)


def some(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def known_mean(*parts: Column) -> Column:
    known = F.array_compact(F.array(*parts))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def lasting(df: DataFrame, **steps: Column) -> DataFrame:
    """Columns one after the other, so that later ones may use earlier ones."""
    for name, c in steps.items():
        df = df.withColumn(name, c)
    return df


def first_of_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group: the first n of every slice of a group, and of these the first n, so that a large group is never in one task."""
    part = W.partitionBy(*keys, "_slice").orderBy(*order)
    few = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))).withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= n)
    return few.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_slice")


SURFACE = (
    "surface_id string, source_kind string, source_id string, run string, coordinate_kind string, coordinate string, secondary_coordinate string, suggested_surgery string, reversal_plan string, artifact_source string, "
    "local_signal double, global_stability double, agreement_score double, disagreement_score double, uncertainty double, false_agreement_risk double, false_disagreement_risk double, overfit_risk double, rearrangement_gain double, grokking_priority double"
)
OPERATION = (
    "operation_id string, operation_type string, operation_name string, operation_batch string, source_run string, rehab_stage string, lens string, family string, transform string, artifact_source string, "
    "external_private double, external_public double, operation_strength double, bias_decay double, bias_novelty_from_champion double, bias_corr_prev_best double, weight_route_information_gain double"
)
IMPACT = (
    "impact_id string, surface_id string, source_kind string, source_id string, coordinate string, operator_move string, artifact_source string, "
    "local_effect double, global_effect double, false_agreement_risk double, false_disagreement_risk double, overfit_risk double, foundation_stress_delta double, branch_priority double"
)


def impact_field(surfaces: DataFrame) -> DataFrame:
    """One row per surface: what its suggested move would do near and far, its ripples, its worth as a branch, and its status."""
    s = with_all(surfaces, SURFACE)
    agree, disagree, unsure = some("agreement_score"), some("disagreement_score"), some("uncertainty")
    fa, fd, over = some("false_agreement_risk"), some("false_disagreement_risk"), some("overfit_risk")
    local = some("local_signal")
    out = lasting(
        s,
        impact_id=stable_id(F.lit("impact"), F.col("surface_id")),
        operator_move=F.col("suggested_surgery"),
        local_effect=local,
        stability_effect=F.coalesce("global_stability", 1 - over),
        global_effect=unit(known_mean(F.col("stability_effect"), agree, 1 - disagree, 1 - over)),
        agreement_delta=agree,
        disagreement_delta=disagree,
        uncertainty_delta=unsure,
        ripple_radius=unit(known_mean(disagree, unsure, fa, over)),
        side_effect_load=unit(known_mean(fa, over, unsure)),
        foundation_stress_delta=unit(known_mean(F.col("ripple_radius"), F.col("side_effect_load"), F.greatest(F.lit(0.0), disagree - agree))),
        move_quality=unit(known_mean(local, F.col("global_effect"), some("rearrangement_gain"), 1 - over, 1 - fa)),
        branch_priority=unit(known_mean(some("grokking_priority"), local, fd, 1 - fa, 1 - over)),
    )
    stress, far, branch = F.col("foundation_stress_delta"), F.col("global_effect"), F.col("branch_priority")
    status = (
        F.when(stress > 0.55, "foundation_rethink_signal").when((local > 0.55) & (far < 0.15), "route_limited").when((branch > 0.55) & (over < 0.35), "kept_as_branch")
        .when((far > 0.40) & (over < 0.25) & (stress < 0.30), "accepted_candidate_needs_retest").when(over > 0.60, "rejected_but_remembered").otherwise("speculative_branch")
    )
    return out.select(
        "impact_id", "surface_id", "source_kind", "source_id", "run", "coordinate_kind", "coordinate", "secondary_coordinate", "operator_move", "local_effect", "global_effect", "stability_effect",
        "agreement_delta", "disagreement_delta", "uncertainty_delta", fa.alias("false_agreement_risk"), fd.alias("false_disagreement_risk"), over.alias("overfit_risk"), "ripple_radius", "side_effect_load",
        "foundation_stress_delta", "move_quality", "branch_priority", status.alias("move_status"), F.col("operator_move").alias("followup_action"), "reversal_plan", "artifact_source",
    )


def foundation_stress(surfaces: DataFrame, impacts: DataFrame, top: int = 12) -> DataFrame:
    """How much stress lies under each (run, kind of source), each kind over all runs, and everything; with advice and the `top` worst surfaces (ties by id).

    impacts: one row per surface. The kind is what stands before a colon. A surface without a run counts under `global` for itself and for its kind.
    """
    s = with_all(surfaces, SURFACE).join(impacts.select("surface_id", F.col("foundation_stress_delta").alias("_stress")), "surface_id", "left")
    kind = F.coalesce(F.element_at(F.split(F.when(F.col("source_kind") != "", F.col("source_kind")), ":"), 1), F.lit("unknown"))
    run = F.coalesce(F.when(F.col("run") != "", F.col("run")), F.lit("global"))
    scope = lambda r, k: F.struct(r.alias("run"), k.alias("source_group"))
    worst = F.greatest(some("uncertainty"), some("false_agreement_risk"), some("overfit_risk"), some("grokking_priority"))
    risky = F.greatest(some("uncertainty"), some("false_agreement_risk"), some("overfit_risk"), some("disagreement_score")) > 0.35
    facts = ["uncertainty", "false_agreement_risk", "false_disagreement_risk", "overfit_risk", "disagreement_score", "grokking_priority", "_stress"]
    rows = s.select("surface_id", *facts, worst.alias("_worst"), risky.cast("double").alias("_risky"), F.explode(F.array(scope(run, kind), scope(F.lit("global"), kind), scope(F.lit("global"), F.lit("all")))).alias("_s")).select("*", "_s.*").drop("_s")
    keys = ["run", "source_group"]
    g = rows.groupBy(*keys).agg(F.count("*").alias("n_surface_records"), *[F.avg(f).alias(f) for f in facts], F.avg("_risky").alias("high_risk_fraction"))
    g = lasting(
        g,
        stress_score=some(unit(known_mean(*[F.col(c) for c in ("uncertainty", "false_agreement_risk", "overfit_risk", "disagreement_score", "_stress", "high_risk_fraction")]))),
        foundation_rethink_priority=some(unit(known_mean(F.col("stress_score"), F.col("grokking_priority"), F.col("false_disagreement_risk")))),
    )
    advice = (
        F.when(F.col("stress_score") > 0.45, "do_not_stack_more_local_fixes; branch_to_alternate_foundation")
        .when(F.col("foundation_rethink_priority") > 0.35, "keep_branch_pressure_high; require independent retest")
        .otherwise("continue_local_surface_surgery_with_reversal_paths")
    )
    few = first_of_group(rows.select(*keys, "surface_id", "_worst"), keys, [F.desc("_worst"), F.col("surface_id")], top)
    names = few.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "surface_id"))), lambda r: r["surface_id"]), "|").alias("top_stress_sources"))
    return g.join(names, keys, "left").select(
        stable_id(F.lit("foundation_stress"), F.col("run"), F.col("source_group")).alias("foundation_stress_id"), *keys, "n_surface_records", "stress_score", F.col("uncertainty").alias("mean_uncertainty"),
        F.col("false_agreement_risk").alias("mean_false_agreement"), F.col("false_disagreement_risk").alias("mean_false_disagreement"), F.col("overfit_risk").alias("mean_overfit"), F.col("disagreement_score").alias("mean_disagreement"),
        "high_risk_fraction", F.col("grokking_priority").alias("branch_pressure"), "foundation_rethink_priority", advice.alias("recommendation"), "top_stress_sources",
    )


def operator_type() -> Column:
    """What an operation does: a carve's stage and lens, a blend, a path's family and transform, or its own type."""
    given = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(other))
    kind = F.coalesce("operation_type", F.lit(""))
    return (
        F.when(kind == "route_carve", F.concat_ws(":", given("rehab_stage", "route_carve"), given("lens", "raw")))
        .when(kind == "blend", "linear_prediction_blend")
        .when(kind == "path_transform", F.concat_ws(":", F.lit("path_transform"), given("family", "unknown"), given("transform", "identity")))
        .otherwise(given("operation_type", "unknown_operator"))
    )


def route_strength(operations: DataFrame, impacts: DataFrame, top: int = 12) -> DataFrame:
    """Per terrain (a run, a batch, or `global` for all), kind of operation and operator: expected gain, its spread, risk, worth and status.

    impacts: one row per source_id. An operation's gain is its private score, or else its own strength.
    """
    own = impacts.filter("source_id is not null").select(F.col("source_id").alias("operation_id"), F.col("overfit_risk").alias("_over"), F.col("branch_priority").alias("_branch"))
    o = with_all(operations, OPERATION).join(own, "operation_id", "left")
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c))
    o = o.select(
        "operation_id", F.coalesce(given("operation_type"), F.lit("unknown")).alias("action_type"), operator_type().alias("operator_type"),
        F.explode(F.array(F.coalesce(given("source_run"), given("operation_batch"), F.lit("global")), F.lit("global"))).alias("terrain_signature"),
        F.coalesce("external_private", "operation_strength").alias("_gain"), F.coalesce(nonzero("_over"), "bias_decay").alias("_risk"), "_branch",
        F.coalesce(nonzero("bias_novelty_from_champion"), 1 - F.coalesce(nonzero("bias_corr_prev_best"), F.lit(1.0))).alias("_new"),
    )
    keys = ["terrain_signature", "action_type", "operator_type"]
    g = o.groupBy(*keys).agg(
        F.count("*").alias("n_observations"), F.avg("_gain").alias("expected_gain"), F.when(F.count("_gain") > 1, F.stddev_pop("_gain")).alias("uncertainty"),
        F.avg("_risk").alias("overfit_risk"), F.avg("_branch").alias("_branches"), F.avg("_new").alias("complementarity"),
    )
    g = lasting(
        g,
        uncertainty=some("uncertainty"),
        overfit_risk=some("overfit_risk"),
        complementarity=unit(some("complementarity")),
        success_probability=unit(0.5 + 5.0 * some("expected_gain") - F.col("overfit_risk")),
        transferability=unit(1.0 - F.col("uncertainty") - F.col("overfit_risk")),
        fragility=unit((F.col("uncertainty") + F.col("overfit_risk")) / 2),
        branch_value=some(unit(known_mean(F.col("_branches"), F.col("expected_gain"), F.col("complementarity"), 1.0 - F.col("fragility")))),
    )
    worth, weak = F.col("branch_value"), F.col("fragility")
    status = F.when((worth > 0.55) & (weak < 0.35), "preferred_reusable_move").when(worth > 0.45, "promising_but_needs_retest").when(weak > 0.50, "fragile_or_context_limited").otherwise("background_prior")
    few = first_of_group(o.select(*keys, "operation_id"), keys, [F.col("operation_id")], top)
    names = few.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "operation_id"))), lambda r: r["operation_id"]), "|").alias("evidence_operations"))
    return g.join(names, keys, "left").select(
        stable_id(F.lit("route_strength"), *[F.col(k) for k in keys]).alias("route_strength_id"), *keys, "n_observations", "expected_gain", "uncertainty", "success_probability", "overfit_risk", "transferability", "fragility", "complementarity", "branch_value",
        status.alias("status"), "evidence_operations",
    )


# The validation worlds, their kinds and what guards them.
WORLDS = (
    ("external_private_score_context", "external_score", "use as telemetry only; never as training label"),
    ("external_public_score_context", "external_score", "watch private/public gap; public-positive private-negative is a trap signal"),
    ("external_reference_only", "excluded_reference", "excluded from weight learning; comparative reference only"),
    ("route_carve_review_surface", "operation_review", "route-carves need parent/sibling ablation before main-world promotion"),
    ("blend_review_surface", "operation_review", "blend gains need leave-one-route-out and correlation-crowding checks"),
    ("path_transform_review_surface", "operation_review", "transform gains need raw-parent and alternate-transform comparison"),
    ("robust_memory_score_surface", "internal_robust_oos", "discount if many candidates are searched against the same robust menu"),
    ("runtime_artifact_surface", "run_artifacts", "use for provenance and budget priors, not direct promotion"),
)


def validation_ledger(runs: DataFrame, paths: DataFrame, operations: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per validation world: how often it was seen, selected on and reported on, how far that wears it out, and the policy that follows.

    scores: filename and description tell external references, which no selection may use. One aggregation per input.
    """
    spark = runs.sparkSession
    s = with_all(scores, "filename string, description string").agg(F.count("*").alias("all"), F.count_if(~is_external()).alias("own")).first()
    o = with_all(operations, OPERATION).agg(F.count("*").alias("all"), *[F.count_if(F.col("operation_type") == k).alias(k) for k in ("route_carve", "blend", "path_transform")]).first()
    p = with_all(paths, "robust_memory_score double, promoted int, shipped int").agg(F.count("robust_memory_score").alias("robust"), F.count_if(F.coalesce("promoted", F.lit(0)) != 0).alias("promoted"), F.count_if(F.coalesce("shipped", F.lit(0)) != 0).alias("shipped")).first()
    n = runs.count()
    outside = s["all"] - s["own"]
    uses = [
        (s["own"], s["own"], s["all"]), (s["own"], s["own"] // 2, s["all"]), (outside, 0, outside), *[(o[k], o[k], o[k]) for k in ("route_carve", "blend", "path_transform")],
        (p["robust"], p["promoted"] + p["shipped"], p["robust"]), (n, n, n),
    ]
    rows = [(i, *w, *map(int, u), int(o["all"])) for i, (w, u) in enumerate(zip(WORLDS, uses))]
    t = spark.createDataFrame(rows, "turn int, validation_world string, world_kind string, guard string, candidate_count_seen long, selection_use_count long, reporting_use_count long, _ops long")
    t = lasting(
        t,
        reuse_pressure=unit(F.col("selection_use_count") / 25.0),
        redundancy_pressure=unit(F.col("reporting_use_count") / F.greatest(F.lit(10.0), F.col("_ops").cast("double"))),
        trust_discount=unit(1.0 / (1.0 + F.col("reuse_pressure") + 0.5 * F.col("redundancy_pressure"))),
        remaining_trust_budget=unit(1.0 - F.col("reuse_pressure")),
    )
    worn = F.col("reuse_pressure")
    policy = (
        F.when(F.col("world_kind") == "excluded_reference", "reference_only_never_weight").when(worn > 0.70, "mutate_or_hold_back; do_not_treat_as_independent")
        .when(worn > 0.35, "discount_for_selection; require independent world").when(F.col("candidate_count_seen") == 0, "inactive").otherwise("usable_with_standard_guard")
    )
    return t.select(
        stable_id(F.lit("validation_world"), F.col("validation_world")).alias("validation_world_id"), "validation_world", "world_kind", "candidate_count_seen", "selection_use_count", "reporting_use_count",
        "reuse_pressure", "redundancy_pressure", "trust_discount", "remaining_trust_budget", policy.alias("policy"), "guard",
    )


def evidence_gate(impacts: DataFrame, operations: DataFrame, routes: DataFrame, contradictions: DataFrame) -> DataFrame:
    """One row per impact: the evidence for it, its drift risk, a grade, and what that allows.

    Only an operation with an external score of its own can be promoted; support of its operator elsewhere makes a branch at most.
    operations: one row per operation_id; routes: (operator_type); contradictions: (scope). Supports and contradictions are counted before they are joined.
    """
    ops = with_all(operations, OPERATION).filter("operation_id is not null").select(F.col("operation_id").alias("source_id"), operator_type().alias("_operator"), F.col("external_private").alias("_private"), F.col("external_public").alias("_public"), F.lit(True).alias("_op"))
    i = with_all(impacts, IMPACT).join(ops, "source_id", "left")
    i = i.withColumn("_operator", F.when(F.col("_op"), F.col("_operator")).otherwise(F.coalesce(F.when(F.col("operator_move") != "", F.col("operator_move")), F.lit("unknown"))))
    i = i.join(routes.groupBy(F.col("operator_type").alias("_operator")).agg(F.count("*").alias("_routes")), "_operator", "left")
    i = i.withColumn("_scope", F.coalesce("coordinate", F.lit(""))).join(contradictions.groupBy(F.coalesce(F.col("scope").cast("string"), F.lit("")).alias("_scope")).agg(F.count("*").alias("_against")), "_scope", "left")
    seen = (F.col("_private").isNotNull() | F.col("_public").isNotNull()).cast("double")
    fa, over, stress, branch = some("false_agreement_risk"), some("overfit_risk"), some("foundation_stress_delta"), some("branch_priority")
    gap = F.coalesce(F.abs(F.col("_private") - F.col("_public")), F.lit(0.0))
    i = lasting(
        i,
        support_count=(F.coalesce("_routes", F.lit(0)) + seen).cast("long"),
        independent_support=unit(0.20 * F.col("support_count") + 0.30 * seen),
        worst_world_proxy=unit(F.least(some("global_effect"), 1.0 - over, 1.0 - stress, 1.0 - gap)),
        drift_risk=unit(known_mean(fa, over, stress, gap, F.least(F.lit(1.0), F.coalesce("_against", F.lit(0)) / 5.0))),
        evidence_score=unit(known_mean(some("local_effect"), some("global_effect"), F.col("worst_world_proxy"), branch * 0.75, F.col("independent_support"), 1.0 - F.col("drift_risk"))),
    )
    score, drift = F.col("evidence_score"), F.col("drift_risk")
    hard = (stress > 0.55) | (fa > 0.55) | (over > 0.60)
    best, second, third, last = "A_supported_candidate", "B_branch_with_retest", "C_route_limited_or_quarantine", "D_reject_or_hazard_memory"
    plain = F.when((score >= 0.72) & (drift <= 0.22) & (F.col("independent_support") >= 0.50), best).when((score >= 0.58) & (drift <= 0.35), second).when((score >= 0.42) & (drift <= 0.50), third).otherwise(last)
    i = lasting(
        i,
        evidence_grade=F.when(hard, last).when((plain == best) & (seen == 0), second).otherwise(plain),
        promotion_allowed=((seen > 0) & (F.col("evidence_grade") == best) & (stress < 0.25) & (fa < 0.18)).cast("int"),
        branch_allowed=(F.col("evidence_grade").isin(best, second) & (drift < 0.45) & ~hard).cast("int"),
        grokking_allowed=((F.col("branch_allowed") == 1) & (branch > 0.55) & (over < 0.35) & (fa < 0.22)).cast("int"),
    )
    promoted = F.col("promotion_allowed") == 1
    decision = F.when(promoted, "candidate_retest_for_main_world").when(F.col("branch_allowed") == 1, "branch_only_requires_independent_retest").when(F.col("evidence_grade") == third, "route_limited_or_quarantine").otherwise("reject_but_remember_as_hazard")
    needs = F.when(promoted, "promotion still requires shipping court and sealed/forward confirmation").otherwise("independent seed/split plus parent/sibling ablation before promotion")
    return i.select(
        stable_id(F.lit("evidence_gate"), F.col("impact_id")).alias("evidence_gate_id"), "impact_id", "surface_id", "source_kind", "source_id", "coordinate", "operator_move", some("local_effect").alias("local_effect"), some("global_effect").alias("global_effect"),
        "worst_world_proxy", "support_count", "independent_support", fa.alias("false_agreement_risk"), some("false_disagreement_risk").alias("false_disagreement_risk"), over.alias("overfit_risk"), stress.alias("foundation_stress_delta"),
        branch.alias("branch_priority"), "evidence_score", "drift_risk", "evidence_grade", "promotion_allowed", "branch_allowed", "grokking_allowed", decision.alias("decision"), needs.alias("required_next_evidence"), "artifact_source",
    )


def contradictions(surfaces: DataFrame, impacts: DataFrame, projections: DataFrame, operations: DataFrame) -> DataFrame:
    """Claims that speak against each other: (claim_edge_id, src_claim, relation, dst_claim, confidence, scope, recommended_test, evidence), from all rows of every table."""
    s, i, o = with_all(surfaces, SURFACE), with_all(impacts, IMPACT), with_all(operations, OPERATION)
    p = with_all(projections, "projection_id string, method string, hazard_bias double, downstream_path_gain double").withColumn("_file", F.lit("projection_memory_matrix.csv"))

    def edges(t: DataFrame, when: Column, key: str, kind: str, src: tuple[str, str], relation: str, dst: tuple[str, str], confidence: Column, scope: str, test: str, evidence: str) -> DataFrame:
        claim = lambda c: F.concat(F.coalesce(F.col(c[0]), F.lit("")), F.lit(f":{c[1]}"))
        return t.filter(when).select(
            stable_id(F.lit("claim_edge"), F.col(key), F.lit(kind)).alias("claim_edge_id"), claim(src).alias("src_claim"), F.lit(relation).alias("relation"), claim(dst).alias("dst_claim"),
            confidence.cast("double").alias("confidence"), F.col(scope).alias("scope"), F.lit(test).alias("recommended_test"), F.col(evidence).alias("evidence"),
        )

    fa, fd = some("false_agreement_risk"), some("false_disagreement_risk")
    gain, gap = F.col("weight_route_information_gain"), F.col("external_private") - F.col("external_public")
    parts = [
        edges(s, (some("agreement_score") > 0.25) & (fa > 0.02), "source_id", "false_agreement", ("source_id", "local_agreement_is_real"), "weakened_by", ("source_id", "false_agreement_risk"), fa, "coordinate", "adversarial split, bootstrap, and parent-surface comparison", "artifact_source"),
        edges(s, fd > 0.05, "source_id", "false_disagreement", ("source_id", "signal_is_noise_or_should_be_quarantined"), "contradicted_by", ("source_id", "false_disagreement_risk"), fd, "coordinate", "revive signal in branch, recombine with adjacent surface, retest globally", "artifact_source"),
        edges(p, (some("downstream_path_gain") > 0) & (some("hazard_bias") > 0.01), "projection_id", "projection_hazard", ("projection_id", "projection_should_be_prior"), "weakened_by", ("projection_id", "projection_has_hazard"), F.col("hazard_bias"), "method", "branch before projection and compare lower-rank/no-projection variants", "_file"),
        edges(o, F.col("external_private").isNotNull() & (gain < 0), "operation_id", "score_gain_conflict", ("operation_id", "external_score_supports_operation"), "contradicted_by", ("operation_id", "route_information_gain_negative"), F.least(F.lit(1.0), F.abs(gain) * 50.0), "operation_name", "route ablation and private-public gap replay", "artifact_source"),
        edges(o, gap > 0.018, "operation_id", "public_private_gap", ("operation_id", "public_score_generalizes"), "weakened_by", ("operation_id", "private_public_gap"), F.least(F.lit(1.0), gap), "operation_name", "check public-specific trap and hidden split sensitivity", "artifact_source"),
        edges(i, some("foundation_stress_delta") > 0.30, "impact_id", "foundation_stress", ("surface_id", "local_move_is_safe"), "contradicted_by", ("impact_id", "foundation_stress_delta_high"), F.col("foundation_stress_delta"), "coordinate", "stop stacking local fixes; branch to alternate normalization or partition", "artifact_source"),
    ]
    return reduce(DataFrame.unionByName, parts)
