"""Refit experiments (§2.11) and behaviour certification (§2.12) over models fitted on the corpus.

The fits have no SQL; the experiments' own logic is tested on given rows and models in tests/."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import certify as CE
from ..operators import evaluate as E
from ..operators import experiments as X
from ..operators import model as M
from ..sources.tables import posts, posts_all
from .q_train import tables_state, trained
from .registry import query

_FITS: dict = {}


def fits(spark, sf) -> X.BoostFits:
    """Fits of this session over the tables as they are now, like :func:`trained`."""
    files = tables_state(spark, sf)
    held = _FITS.get(files)
    if held is None or held.spark is not spark:
        _FITS.clear()
        held = _FITS[files] = X.BoostFits(posts(spark, sf))
    return held


def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@query("exp_feature_sets")
def q_exp_feature_sets(spark, sf):
    return X.run_feature_experiments(fits(spark, sf).base, X.feature_sets())


@query("exp_cumulative_lexicon")
def q_exp_cumulative_lexicon(spark, sf):
    return X.run_feature_experiments(fits(spark, sf).base, X.cumulative_sets())


def _cases_at(spark, sf, boosts, cases, veto, extended_cases=False):
    """Cases scored by the base-word model of each boost; the cases' own words may be the extended lists."""
    models = fits(spark, sf).fit_all([(b, False) for b in boosts])
    rows = X.case_rows(spark, cases, extended_cases)
    return union_all([X.cases_scored(models[(b, False)][1], rows, b, veto) for b in boosts])


@query("exp_boost_floor")
def q_exp_boost_floor(spark, sf):
    return X.boost_floor(_cases_at(spark, sf, X.BOOSTS_FLOOR, X.CONFLICT_CASES, "original"))


@query("exp_boost_ceiling")
def q_exp_boost_ceiling(spark, sf):
    r = _cases_at(spark, sf, X.BOOSTS_CEILING, X.CEILING_CASES, "original")
    return X.pass_rate_pivot(r.withColumn("correct", F.col("passed")), "boost", "category",
                             ("agreement", "sarcasm", "text-dominant"))


@query("exp_veto_boundary")
def q_exp_veto_boundary(spark, sf):
    r = _cases_at(spark, sf, (L.EMOJI_BOOST,), X.BOUNDARY_CASES, "original")
    return E.veto_misfire_rate(r, fired="fired")


@query("exp_guard")
def q_exp_guard(spark, sf):
    r = _cases_at(spark, sf, (L.EMOJI_BOOST,), X.BOUNDARY_CASES, "production", extended_cases=True)
    return r.groupBy("category").agg(F.sum(F.col("fired").cast("int")).cast("bigint").alias("fires"),
                                     F.sum(F.col("passed").cast("int")).cast("bigint").alias("passed"),
                                     F.count(F.lit(1)).cast("bigint").alias("total"))


@query("exp_veto_strategy")
def q_exp_veto_strategy(spark, sf):
    bf = fits(spark, sf)
    model = bf.fit_all([(L.EMOJI_BOOST, True)])[(L.EMOJI_BOOST, True)][1]
    return X.veto_strategy(model, bf.scored_text("val"), X.case_rows(spark, X.INTEGRITY_CASE, extended=True))


def _run_grid(spark, sf, boosts, proportional):
    """Every (boost, guard): validation accuracy / F1 and behaviour-case pass counts."""
    bf = fits(spark, sf)
    models = bf.fit_all([(b, True) for b in boosts])
    cases = X.case_rows(spark, CE.BEHAVIOURAL_CASES, extended=True)
    thr = {b: (b if proportional else L.EMOJI_BOOST) for b in boosts}
    # the validation texts' TF-IDF rows are read once for all boosts
    val = X.grid_labels(bf.text_logits("val", {b: models[(b, True)][1] for b in boosts}), bf.ext.rows("val"),
                        {b: models[(b, True)][1] for b in boosts}, thr)
    c = union_all([X.grid_case_labels(models[(b, True)][1], cases, b, thr[b]) for b in boosts])
    return X.grid_table("B" if proportional else "A", val, c)


@query("exp_grid_fixed")
def q_exp_grid_fixed(spark, sf):
    return _run_grid(spark, sf, X.BOOSTS_GRID_A, False)


@query("exp_grid_proportional")
def q_exp_grid_proportional(spark, sf):
    return _run_grid(spark, sf, X.BOOSTS_GRID_B, True)


@query("exp_decision")
def q_exp_decision(spark, sf):
    return X.decision(_run_grid(spark, sf, X.BOOSTS_GRID_A, False), _run_grid(spark, sf, X.BOOSTS_GRID_B, True))


# ---------------------------------------------------------------- §2.12 certification

def _records(spark, sf, cases, schema):
    t = trained(spark, sf)
    cf = CE.cases_frame(spark, cases, schema)
    return cf, M.predict_sentiment(cf.select("id", "text"), t.model)


@query("golden_behaviour")
def q_golden_behaviour(spark, sf):
    cf, rec = _records(spark, sf, CE.GOLDEN_CASES, "text string, expected string, expected_driver string")
    return CE.golden_behaviour(rec, cf)


@query("verify_behaviour")
def q_verify_behaviour(spark, sf):
    cf, rec = _records(spark, sf, CE.VERIFICATION_CASES + CE.KNOWN_LIMITATIONS, "text string, expected int, category string")
    return CE.verify_behaviour(rec, cf)


@query("confidence_audit")
def q_confidence_audit(spark, sf):
    t = trained(spark, sf)
    return CE.confidence_audit(M.predict_sentiment(t.val.select("id", "text"), t.model))


@query("audit_report")
def q_audit_report(spark, sf):
    t = trained(spark, sf)
    return CE.audit_report(M.predict_sentiment(t.val.select("id", "text"), t.model))


@query("health_report")
def q_health_report(spark, sf):
    t = trained(spark, sf)
    records = M.predict_sentiment(posts_all(spark, sf), t.model)
    cf, rec = _records(spark, sf, CE.GOLDEN_CASES, "text string, expected string, expected_driver string")
    g = CE.golden_behaviour(rec, cf)
    golden = g.select(F.concat(F.lit("test_golden_"), F.col("id").cast("string"), F.lit("_"), F.col("expected_driver")).alias("check"),
                      F.lit(None).cast("bigint").alias("violations"), (F.col("label_ok") & F.col("driver_ok")).alias("passed"))
    checks = CE.check_rows(records).unionByName(golden)
    return CE.health_report(checks)


@query("sink_report_json")
def q_sink_report_json(spark, sf):
    from ..operators import persist as PS
    rep = q_health_report(spark, sf)
    return PS.sink_report_json(rep, PS.scratch_path(spark, "health_report"))
