"""Queries on the ledger of a search: surfaces, operations, paths and scores are made from rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ledger as lg
from tidemark.plans.queries import query, rounded, table

# Every number is a share in hundredths, drawn from a key; some are unknown.
_SURFACE_NUMBERS = {"local_signal": 7, "global_stability": 11, "agreement_score": 13, "disagreement_score": 17, "uncertainty": 19, "false_agreement_risk": 23, "false_disagreement_risk": 29, "overfit_risk": 31, "rearrangement_gain": 37, "grokking_priority": 41}
_OPERATION_NUMBERS = {"operation_strength": 7, "bias_decay": 11, "bias_novelty_from_champion": 13, "bias_corr_prev_best": 17}

CTE = (
    """
with surfaces as (
  select 's' || event_id as surface_id, event_type || case when event_id % 2 = 0 then ':deep' else '' end as source_kind, 'o' || (event_id % 500) as source_id,
    case when event_id % 6 > 0 then 'r' || (event_id % 6) end as run, 'c' || (event_id % 40) as coordinate, 'move' || (event_id % 4) as suggested_surgery,
    """
    + ",\n    ".join(f"case when event_id % {k} > 2 then (event_id * {k} % 101) / 100.0::double end as {n}" for n, k in _SURFACE_NUMBERS.items())
    + """
  from events
)
, operations as (
  select 'o' || o_orderkey as operation_id, case o_orderkey % 4 when 0 then 'route_carve' when 1 then 'blend' when 2 then 'path_transform' end as operation_type,
    'n' || (o_orderkey % 30) as operation_name, case when o_orderkey % 5 > 0 then 'r' || (o_orderkey % 5) end as source_run, case when o_orderkey % 3 > 0 then 'st' || (o_orderkey % 3) end as rehab_stage, case when o_orderkey % 2 > 0 then 'rank' end as lens,
    case when o_orderkey % 7 > 2 then (o_orderkey * 3 % 101) / 1000.0::double end as external_private, case when o_orderkey % 7 > 3 then (o_orderkey * 5 % 101) / 1000.0::double end as external_public,
    ((o_orderkey * 19 % 101) - 50) / 1000.0::double as weight_route_information_gain,
    """
    + ",\n    ".join(f"case when o_orderkey % {k} > 2 then (o_orderkey * {k} % 101) / 100.0::double end as {n}" for n, k in _OPERATION_NUMBERS.items())
    + """
  from orders
)
, n as (
  select *, coalesce(agreement_score, 0) as ag, coalesce(disagreement_score, 0) as dis, coalesce(uncertainty, 0) as un, coalesce(false_agreement_risk, 0) as fa, coalesce(false_disagreement_risk, 0) as fd, coalesce(overfit_risk, 0) as ov,
    coalesce(local_signal, 0) as lo, coalesce(rearrangement_gain, 0) as re, coalesce(grokking_priority, 0) as gr
  from surfaces
)
, n2 as (
  select *, coalesce(global_stability, 1 - ov) as stability_effect, (coalesce(global_stability, 1 - ov) + ag + (1 - dis) + (1 - ov)) / 4 as global_effect, (dis + un + fa + ov) / 4 as ripple_radius, (fa + ov + un) / 3 as side_effect_load from n
)
, n3 as (
  select *, (ripple_radius + side_effect_load + greatest(0, dis - ag)) / 3 as stress, (lo + global_effect + re + (1 - ov) + (1 - fa)) / 5 as move_quality, (gr + lo + fd + (1 - fa) + (1 - ov)) / 5 as branch_priority from n2
)
, impacts as (
  select substr(sha1('impact|' || surface_id), 1, 16) as impact_id, *, suggested_surgery as operator_move,
    case when stress > 0.55 then 'foundation_rethink_signal' when lo > 0.55 and global_effect < 0.15 then 'route_limited' when branch_priority > 0.55 and ov < 0.35 then 'kept_as_branch'
      when global_effect > 0.40 and ov < 0.25 and stress < 0.30 then 'accepted_candidate_needs_retest' when ov > 0.60 then 'rejected_but_remembered' else 'speculative_branch' end as move_status
  from n3
)
"""
)
_OPERATOR = """
case operation_type when 'route_carve' then coalesce(rehab_stage, 'route_carve') || ':' || coalesce(lens, 'raw') when 'blend' then 'linear_prediction_blend'
  when 'path_transform' then 'path_transform:unknown:identity' else 'unknown_operator' end
"""


def surfaces(spark, d):
    e, at = table(spark, d, "events"), F.col("event_id")
    numbers = [F.when(at % k > 2, (at * k % 101) / F.lit(100.0)).alias(n) for n, k in _SURFACE_NUMBERS.items()]
    return e.select(
        F.concat(F.lit("s"), at).alias("surface_id"), F.concat("event_type", F.when(at % 2 == 0, ":deep").otherwise("")).alias("source_kind"), F.concat(F.lit("o"), at % 500).alias("source_id"),
        F.when(at % 6 > 0, F.concat(F.lit("r"), at % 6)).alias("run"), F.concat(F.lit("c"), at % 40).alias("coordinate"), F.concat(F.lit("move"), at % 4).alias("suggested_surgery"), *numbers,
    )


def operations(spark, d):
    o, at = table(spark, d, "orders"), F.col("o_orderkey")
    numbers = [F.when(at % k > 2, (at * k % 101) / F.lit(100.0)).alias(n) for n, k in _OPERATION_NUMBERS.items()]
    return o.select(
        F.concat(F.lit("o"), at).alias("operation_id"), F.when(at % 4 == 0, "route_carve").when(at % 4 == 1, "blend").when(at % 4 == 2, "path_transform").alias("operation_type"), F.concat(F.lit("n"), at % 30).alias("operation_name"),
        F.when(at % 5 > 0, F.concat(F.lit("r"), at % 5)).alias("source_run"), F.when(at % 3 > 0, F.concat(F.lit("st"), at % 3)).alias("rehab_stage"), F.when(at % 2 > 0, "rank").alias("lens"),
        F.when(at % 7 > 2, (at * 3 % 101) / F.lit(1000.0)).alias("external_private"), F.when(at % 7 > 3, (at * 5 % 101) / F.lit(1000.0)).alias("external_public"),
        ((at * 19 % 101 - 50) / F.lit(1000.0)).alias("weight_route_information_gain"), *numbers,
    )


def one_impact_per_source(spark, d):
    """The impact of the first surface of each source."""
    i = lg.impact_field(surfaces(spark, d))
    return i.groupBy("source_id").agg(F.min_by("overfit_risk", "surface_id").alias("overfit_risk"), F.min_by("branch_priority", "surface_id").alias("branch_priority"))


_EFFECTS = ("local_effect", "global_effect", "stability_effect", "ripple_radius", "side_effect_load", "foundation_stress_delta", "move_quality", "branch_priority")


@query("impact_field", CTE + """
select impact_id, surface_id, round(lo, 6) as local_effect, round(global_effect, 6) as global_effect, round(stability_effect, 6) as stability_effect, round(ripple_radius, 6) as ripple_radius, round(side_effect_load, 6) as side_effect_load,
  round(stress, 6) as foundation_stress_delta, round(move_quality, 6) as move_quality, round(branch_priority, 6) as branch_priority, move_status
from impacts
""")
def _(spark, d):
    return rounded(lg.impact_field(surfaces(spark, d)).select("impact_id", "surface_id", *_EFFECTS, "move_status"), *_EFFECTS)


@query("foundation_stress", CTE + """
, x as (
  select *, greatest(un, fa, ov, gr) as worst, (greatest(un, fa, ov, dis) > 0.35)::int::double as risky,
    unnest([{'run': coalesce(run, 'global'), 'source_group': split_part(source_kind, ':', 1)}, {'run': 'global', 'source_group': split_part(source_kind, ':', 1)}, {'run': 'global', 'source_group': 'all'}]) as s
  from impacts
)
, g as (
  select s.run as run, s.source_group as source_group, count(*) as n, avg(uncertainty) as u, avg(false_agreement_risk) as a, avg(false_disagreement_risk) as f, avg(overfit_risk) as o, avg(disagreement_score) as d,
    avg(stress) as st, avg(risky) as r, avg(grokking_priority) as b
  from x group by all
)
, h as (select *, (u + a + o + d + st + r) / 6 as stress_score from g)
, k as (select *, (stress_score + b + f) / 3 as rethink from h)
, few as (select s.run as run, s.source_group as source_group, surface_id, row_number() over (partition by s.run, s.source_group order by worst desc, surface_id) as rk from x qualify rk <= 12)
, names as (select run, source_group, string_agg(surface_id, '|' order by rk) as top_stress_sources from few group by all)
select run, source_group, n::bigint as n_surface_records, round(stress_score, 6) as stress_score, round(r, 6) as high_risk_fraction, round(b, 6) as branch_pressure, round(rethink, 6) as foundation_rethink_priority,
  case when stress_score > 0.45 then 'do_not_stack_more_local_fixes; branch_to_alternate_foundation' when rethink > 0.35 then 'keep_branch_pressure_high; require independent retest'
    else 'continue_local_surface_surgery_with_reversal_paths' end as recommendation, top_stress_sources
from k join names using (run, source_group)
""")
def _(spark, d):
    s = surfaces(spark, d)
    numbers = ("stress_score", "high_risk_fraction", "branch_pressure", "foundation_rethink_priority")
    return rounded(lg.foundation_stress(s, lg.impact_field(s)).select("run", "source_group", "n_surface_records", *numbers, "recommendation", "top_stress_sources"), *numbers)


_STRENGTH = ("expected_gain", "uncertainty", "success_probability", "overfit_risk", "transferability", "fragility", "complementarity", "branch_value")
_ROUTES = """
, own as (select source_id, arg_min(ov, surface_id) as over, arg_min(branch_priority, surface_id) as branch from impacts group by 1)
, y as (
  select operation_id, coalesce(operation_type, 'unknown') as action_type, """ + _OPERATOR + """ as operator_type, unnest([coalesce(source_run, 'global'), 'global']) as terrain_signature,
    coalesce(external_private, operation_strength) as gain, coalesce(nullif(over, 0), bias_decay) as risk, branch, coalesce(nullif(bias_novelty_from_champion, 0), 1 - coalesce(nullif(bias_corr_prev_best, 0), 1.0)) as fresh
  from operations left join own on source_id = operation_id
)
, g as (
  select terrain_signature, action_type, operator_type, count(*) as n, avg(gain) as e, coalesce(case when count(gain) > 1 then stddev_pop(gain) end, 0) as u, coalesce(avg(risk), 0) as r, avg(branch) as b, greatest(0, least(1, coalesce(avg(fresh), 0))) as c
  from y group by all
)
, h as (select *, greatest(0, least(1, (u + r) / 2)) as fragility from g)
, k as (select *, greatest(0, least(1, list_avg(list_filter([b, e, c, 1 - fragility], lambda v: v is not null)))) as worth from h)
, routes as (
  select *, case when worth > 0.55 and fragility < 0.35 then 'preferred_reusable_move' when worth > 0.45 then 'promising_but_needs_retest' when fragility > 0.50 then 'fragile_or_context_limited' else 'background_prior' end as status from k
)
"""


@query("route_strength", CTE + _ROUTES + """
, few as (select terrain_signature, action_type, operator_type, operation_id, row_number() over (partition by terrain_signature, action_type, operator_type order by operation_id) as rk from y qualify rk <= 12)
, names as (select terrain_signature, action_type, operator_type, string_agg(operation_id, '|' order by rk) as evidence_operations from few group by all)
select terrain_signature, action_type, operator_type, n::bigint as n_observations, round(e, 6) + 0.0 as expected_gain, round(u, 6) as uncertainty, round(greatest(0, least(1, 0.5 + 5 * coalesce(e, 0) - r)), 6) as success_probability, round(r, 6) as overfit_risk,
  round(greatest(0, least(1, 1 - u - r)), 6) as transferability, round(fragility, 6) as fragility, round(c, 6) as complementarity, round(worth, 6) as branch_value, status, evidence_operations
from routes join names using (terrain_signature, action_type, operator_type)
""")
def _(spark, d):
    out = lg.route_strength(operations(spark, d), one_impact_per_source(spark, d)).drop("route_strength_id")
    return rounded(out, *_STRENGTH)


@query("validation_ledger", CTE + """
, scores as (select count(*) as n, count(*) filter (where event_id % 9 > 0) as own from events)
, ops as (select count(*) as n, count_if(operation_type = 'route_carve') as carve, count_if(operation_type = 'blend') as blend, count_if(operation_type = 'path_transform') as path from operations)
, paths as (select count(case when c_custkey % 3 > 0 then 1 end) as robust, count_if(c_custkey % 50 = 0) as promoted, count_if(c_custkey % 70 = 0) as shipped from customer)
, runs as (select count(*) as n from nation)
, w as (
  select unnest([
    {'name': 'external_private_score_context', 'k': 'external_score', 'c': own, 's': own, 'r': scores.n}, {'name': 'external_public_score_context', 'k': 'external_score', 'c': own, 's': own // 2, 'r': scores.n},
    {'name': 'external_reference_only', 'k': 'excluded_reference', 'c': scores.n - own, 's': 0, 'r': scores.n - own}, {'name': 'route_carve_review_surface', 'k': 'operation_review', 'c': carve, 's': carve, 'r': carve},
    {'name': 'blend_review_surface', 'k': 'operation_review', 'c': blend, 's': blend, 'r': blend}, {'name': 'path_transform_review_surface', 'k': 'operation_review', 'c': path, 's': path, 'r': path},
    {'name': 'robust_memory_score_surface', 'k': 'internal_robust_oos', 'c': robust, 's': promoted + shipped, 'r': robust}, {'name': 'runtime_artifact_surface', 'k': 'run_artifacts', 'c': runs.n, 's': runs.n, 'r': runs.n}
  ]) as spec, ops.n as ops
  from scores, ops, paths, runs
)
, v as (select spec.name as validation_world, spec.k as world_kind, spec.c as c, spec.s as s, spec.r as r, least(1, spec.s / 25.0::double) as reuse, least(1, spec.r / greatest(10, ops)::double) as red from w)
select validation_world, c::bigint as candidate_count_seen, s::bigint as selection_use_count, r::bigint as reporting_use_count, round(reuse, 6) as reuse_pressure, round(red, 6) as redundancy_pressure, round(1 / (1 + reuse + 0.5 * red), 6) as trust_discount,
  round(1 - reuse, 6) as remaining_trust_budget,
  case when world_kind = 'excluded_reference' then 'reference_only_never_weight' when reuse > 0.70 then 'mutate_or_hold_back; do_not_treat_as_independent' when reuse > 0.35 then 'discount_for_selection; require independent world'
    when c = 0 then 'inactive' else 'usable_with_standard_guard' end as policy
from v
""")
def _(spark, d):
    at = F.col("event_id")
    scores = table(spark, d, "events").select(F.concat(F.lit("f"), at).alias("filename"), F.when(at % 9 == 0, "an External Reference").otherwise("own").alias("description"))
    key = F.col("c_custkey")
    paths = table(spark, d, "customer").select(F.when(key % 3 > 0, 0.1).alias("robust_memory_score"), (key % 50 == 0).cast("int").alias("promoted"), (key % 70 == 0).cast("int").alias("shipped"))
    out = lg.validation_ledger(table(spark, d, "nation"), paths, operations(spark, d), scores)
    return rounded(out.drop("validation_world_id", "world_kind", "guard"), "reuse_pressure", "redundancy_pressure", "trust_discount", "remaining_trust_budget")


_CLAIMS = """
, claims as (
  select source_id || ':local_agreement_is_real' as src_claim, 'weakened_by' as relation, fa as confidence, coordinate as scope from surfaces_n where ag > 0.25 and fa > 0.02
  union all select source_id || ':signal_is_noise_or_should_be_quarantined', 'contradicted_by', fd, coordinate from surfaces_n where fd > 0.05
  union all select 'p' || p_partkey || ':projection_should_be_prior', 'weakened_by', p_size / 100.0::double, p_brand from part where p_size > 1 and p_partkey % 3 > 0
  union all select operation_id || ':external_score_supports_operation', 'contradicted_by', least(1, abs(weight_route_information_gain) * 50.0), operation_name from operations where external_private is not null and weight_route_information_gain < 0
  union all select operation_id || ':public_score_generalizes', 'weakened_by', least(1, external_private - external_public), operation_name from operations where external_private - external_public > 0.018
  union all select surface_id || ':local_move_is_safe', 'contradicted_by', stress, coordinate from impacts where stress > 0.30
)
"""


def _contradictions(spark, d):
    s = surfaces(spark, d)
    p = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("projection_id"), F.col("p_brand").alias("method"), (F.col("p_size") / 100.0).alias("hazard_bias"), (F.col("p_partkey") % 3).cast("double").alias("downstream_path_gain"))
    return lg.contradictions(s, lg.impact_field(s), p, operations(spark, d))


@query("contradictions", CTE + _CLAIMS.replace("surfaces_n", "n") + "select src_claim, relation, round(confidence, 6) as confidence, scope from claims")
def _(spark, d):
    return rounded(_contradictions(spark, d).select("src_claim", "relation", "confidence", "scope"), "confidence")


@query("evidence_gate", CTE + _ROUTES + _CLAIMS.replace("surfaces_n", "n") + """
, ro as (select operator_type, count(*) as routes from routes group by 1)
, cl as (select scope, count(*) as against from claims group by 1)
, j as (
  select i.*, o.operation_id, external_private as pr, external_public as pu, case when o.operation_id is not null then o.op else operator_move end as operator,
    (external_private is not null or external_public is not null)::int as seen, coalesce(abs(external_private - external_public), 0) as gap
  from impacts i left join (select *, """ + _OPERATOR + """ as op from operations) o on o.operation_id = i.source_id
)
, k2 as (
  select j.*, coalesce(routes, 0) + seen as support_count, greatest(0, least(1, 0.20::double * (coalesce(routes, 0) + seen) + 0.30::double * seen)) as independent_support,
    greatest(0, least(1, least(global_effect, 1 - ov, 1 - stress, 1 - gap))) as worst_world_proxy, (fa + ov + stress + gap + least(1, coalesce(against, 0) / 5.0)) / 5 as drift_risk
  from j left join ro on ro.operator_type = operator left join cl on cl.scope = j.coordinate
)
, e2 as (select *, (lo + global_effect + worst_world_proxy + branch_priority * 0.75 + independent_support + (1 - drift_risk)) / 6 as evidence_score, stress > 0.55 or fa > 0.55 or ov > 0.60 as hard from k2)
, g2 as (
  select *, case when hard then 'D_reject_or_hazard_memory' when evidence_score >= 0.72 and drift_risk <= 0.22 and independent_support >= 0.50 then case when seen = 1 then 'A_supported_candidate' else 'B_branch_with_retest' end
    when evidence_score >= 0.58 and drift_risk <= 0.35 then 'B_branch_with_retest' when evidence_score >= 0.42 and drift_risk <= 0.50 then 'C_route_limited_or_quarantine' else 'D_reject_or_hazard_memory' end as evidence_grade
  from e2
)
, p2 as (select *, (seen = 1 and evidence_grade[1] = 'A' and stress < 0.25 and fa < 0.18)::int as promotion_allowed, (evidence_grade[1] in ('A', 'B') and drift_risk < 0.45 and not hard)::int as branch_allowed from g2)
select impact_id, surface_id, support_count::bigint as support_count, round(independent_support, 6) as independent_support, round(worst_world_proxy, 6) as worst_world_proxy, round(evidence_score, 6) as evidence_score, round(drift_risk, 6) as drift_risk,
  evidence_grade, promotion_allowed, branch_allowed, (branch_allowed = 1 and branch_priority > 0.55 and ov < 0.35 and fa < 0.22)::int as grokking_allowed,
  case when promotion_allowed = 1 then 'candidate_retest_for_main_world' when branch_allowed = 1 then 'branch_only_requires_independent_retest' when evidence_grade[1] = 'C' then 'route_limited_or_quarantine' else 'reject_but_remember_as_hazard' end as decision
from p2
""")
def _(spark, d):
    ops = operations(spark, d)
    routes = lg.route_strength(ops, one_impact_per_source(spark, d))
    out = lg.evidence_gate(lg.impact_field(surfaces(spark, d)), ops, routes, _contradictions(spark, d))
    numbers = ("independent_support", "worst_world_proxy", "evidence_score", "drift_risk")
    return rounded(out.select("impact_id", "surface_id", "support_count", *numbers, "evidence_grade", "promotion_allowed", "branch_allowed", "grokking_allowed", "decision"), *numbers)
