"""Registered queries: one per inventory id, each ``(spark, sf_dir) -> DataFrame``.

Each query reads the driver tables through the main adapter (events as
user-weeks, process model ``EVENTS_MODEL``), runs one operator over the whole
log and rounds doubles for the oracle comparison (6 places; 4 for sums that
grow with the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions.time import format_ts
from caseflow.model import EVENTS_MODEL
from caseflow.operators import clean as cl
from caseflow.operators import waits
from caseflow.operators.util import bucketed, materialised
from caseflow.plans import journal
from caseflow.sources import adapters

MODEL = EVENTS_MODEL
QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6, sums: tuple = (), sum_places: int = 4) -> DataFrame:
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        if t in ("double", "float"):
            p = sum_places if f.name in sums else places
            out.append(F.round(F.col(f.name), p).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.main_log(spark, sf_dir)


# attribute columns each family of analyses needs beyond case/activity/ts/seq
ALL_ATTRS = None
CASE_ATTRS = ("resource", "loan_goal", "requested_amount", "application_type")
NO_ATTRS = ()


def clean_log(spark: SparkSession, sf_dir: str, keep=ALL_ATTRS) -> DataFrame:
    return cl.clean(raw_log(spark, sf_dir), keep, MODEL.slice_hours)


def _valid(spark, sf_dir):
    log = clean_log(spark, sf_dir, NO_ATTRS)
    return waits.valid_transitions(waits.transitions(log, MODEL), MODEL)


# --- 2.2 cleaning -----------------------------------------------------------

@register("cln_clean_log")
def q_clean_log(spark, sf_dir):
    df = clean_log(spark, sf_dir)
    return rounded(df.select("case_id", "activity",
                             format_ts("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                             "resource", "requested_amount", "event_seq"))


@register("cln_profile")
def q_clean_profile(spark, sf_dir):
    prof = cl.clean_profile(raw_log(spark, sf_dir), clean_log(spark, sf_dir, NO_ATTRS))
    return prof.withColumn("first_date", F.date_format("first_date", "yyyy-MM-dd")) \
               .withColumn("last_date", F.date_format("last_date", "yyyy-MM-dd"))


# --- 2.5 / 2.7 sequence and bottlenecks --------------------------------------

@register("win_transitions")
def q_transitions(spark, sf_dir):
    tr = waits.transitions(clean_log(spark, sf_dir, NO_ATTRS), MODEL)
    return rounded(tr.select("case_id", "activity", "event_seq", "prev_activity",
                             format_ts("prev_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("prev_ts"),
                             "waiting_hours", "position"))


@register("btn_bottleneck")
def q_bottleneck(spark, sf_dir):
    st = waits.bottleneck_stats(_valid(spark, sf_dir), MODEL)
    return rounded(st, sums=("total_wait_hours", "total_wait_days", "bottleneck_score"))


@register("btn_transition_waits")
def q_transition_waits(spark, sf_dir):
    return rounded(waits.transition_waits(_valid(spark, sf_dir)))


# --- 2.3 case level -------------------------------------------------------------

from caseflow.operators import cases as cs  # noqa: E402
from caseflow.operators import conformance as cf  # noqa: E402
from caseflow.operators import digests as dg  # noqa: E402
from caseflow.operators import rework as rw  # noqa: E402
from caseflow.operators import variants as vr  # noqa: E402


def _aggs(spark, sf_dir, keep=CASE_ATTRS):
    return cs.case_aggregates(clean_log(spark, sf_dir, keep), MODEL)


def _cases(spark, sf_dir, keep=NO_ATTRS):
    """The case table with what ``keep`` names beyond times and activities:
    the scan reads only the columns that these need."""
    return cs.case_table(_aggs(spark, sf_dir, keep), MODEL)


@register("cas_case_table")
def q_case_table(spark, sf_dir):
    df = cs.case_table(_aggs(spark, sf_dir, CASE_ATTRS), MODEL, format_times=True)
    return rounded(df)


@register("cas_duration_profile")
def q_duration_profile(spark, sf_dir):
    return rounded(cs.duration_profile(_cases(spark, sf_dir)))


@register("cas_outcome_distribution")
def q_outcome_distribution(spark, sf_dir):
    return rounded(cs.outcome_distribution(_cases(spark, sf_dir)))


@register("cas_completed_cases")
def q_completed(spark, sf_dir):
    df = cs.completed_cases(_cases(spark, sf_dir), MODEL)
    return rounded(df.select("case_id", "outcome", "duration_days", "sla_breach"))


# --- 2.6 variants ----------------------------------------------------------------

def _digests(spark, sf_dir):
    return dg.case_digests(clean_log(spark, sf_dir, NO_ATTRS), MODEL.slice_hours)


def _counts(spark, sf_dir):
    return vr.variant_counts(_digests(spark, sf_dir))


def _variant_tables(spark, sf_dir):
    """Clean log, digests and counts, each written once: ranks read all of
    them more than once."""
    log = bucketed(clean_log(spark, sf_dir, NO_ATTRS), "clean-log")
    digests = materialised(dg.case_digests(log, MODEL.slice_hours), "digests")
    return log, digests, materialised(vr.variant_counts(digests), "variant-counts")


def _ranked(log, counts):
    """Ranks and texts of all variants."""
    return vr.variant_texts(log, vr.variant_ranks(counts, log, MODEL.slice_hours), MODEL.slice_hours)


@register("var_case_variants")
def q_case_variants(spark, sf_dir):
    log, digests, counts = _variant_tables(spark, sf_dir)
    out = vr.attach_variants(digests.select("case_id"), digests, _ranked(log, counts))
    return out.select("case_id", "variant", "variant_rank", "is_top3_variant", "is_top10_variant")


@register("var_counts")
def q_variant_counts(spark, sf_dir):
    log, _, counts = _variant_tables(spark, sf_dir)
    return vr.ranked_variants(counts, log, MODEL.slice_hours)


@register("var_activity_frequency")
def q_activity_frequency(spark, sf_dir):
    return rounded(vr.activity_frequency(clean_log(spark, sf_dir, NO_ATTRS)))


@register("var_coverage")
def q_coverage(spark, sf_dir):
    return rounded(vr.variant_coverage(_counts(spark, sf_dir)))


@register("var_top5")
def q_top5(spark, sf_dir):
    log, _, counts = _variant_tables(spark, sf_dir)
    return rounded(vr.top_variants(counts, log, 5, MODEL.slice_hours))


@register("var_pareto")
def q_pareto(spark, sf_dir):
    return rounded(vr.variant_pareto(_counts(spark, sf_dir), 20))


@register("var_breach_by_rank_bucket")
def q_breach_by_bucket(spark, sf_dir):
    log, digests, counts = _variant_tables(spark, sf_dir)
    cases = cs.case_table(cs.case_aggregates(log, MODEL), MODEL).select("case_id", "sla_breach")
    cv = vr.attach_variants(cases, digests, vr.bucket_ranks(counts, log, MODEL.slice_hours))
    return rounded(vr.breach_by_rank_bucket(cv))


# --- 2.7 rework ---------------------------------------------------------------------

def _acounts(spark, sf_dir):
    return rw.activity_counts(clean_log(spark, sf_dir, NO_ATTRS))


@register("rwk_activity_counts")
def q_activity_counts(spark, sf_dir):
    return _acounts(spark, sf_dir)


@register("rwk_prevalence")
def q_rework_prevalence(spark, sf_dir):
    return rounded(rw.rework_prevalence(_acounts(spark, sf_dir)))


@register("rwk_by_activity")
def q_rework_by_activity(spark, sf_dir):
    return rounded(rw.rework_by_activity(_acounts(spark, sf_dir), 10))


@register("rwk_case_flags")
def q_rework_flags(spark, sf_dir):
    return rw.case_rework_flags(_acounts(spark, sf_dir))


# --- 2.7 conformance ----------------------------------------------------------------

def _conf(spark, sf_dir):
    # conformance needs activities and order only: no attribute columns
    return cf.conformance(_aggs(spark, sf_dir, NO_ATTRS), MODEL)


@register("cnf_case_conformance")
def q_conformance(spark, sf_dir):
    return _conf(spark, sf_dir).drop("deviations")


@register("cnf_rate")
def q_conformance_rate(spark, sf_dir):
    return rounded(cf.conformance_rate(_conf(spark, sf_dir)))


@register("cnf_deviations")
def q_deviations(spark, sf_dir):
    return cf.deviation_breakdown(_conf(spark, sf_dir))


@register("cnf_breach_by_conformance")
def q_breach_by_conformance(spark, sf_dir):
    return rounded(cf.breach_by_conformance_of(_aggs(spark, sf_dir, NO_ATTRS), MODEL))


@register("btn_top_bottlenecks")
def q_top_bottlenecks(spark, sf_dir):
    st = waits.bottleneck_stats(_valid(spark, sf_dir), MODEL)
    top = waits.top_bottlenecks(st, 10)
    return rounded(top.select("activity", "mean_wait_hours", "n_occurrences", "total_wait_days",
                              "bottleneck_score", "bottleneck_rank"),
                   sums=("total_wait_days", "bottleneck_score"))


# --- 2.8 chart data -------------------------------------------------------------------

from caseflow.operators import charts as ch  # noqa: E402
from caseflow.operators import kpi  # noqa: E402


@register("cht_duration_histogram")
def q_duration_hist(spark, sf_dir):
    return rounded(ch.histogram(_cases(spark, sf_dir), "duration_days", 40, 60.0))


@register("cht_events_histogram")
def q_events_hist(spark, sf_dir):
    return rounded(ch.histogram(_cases(spark, sf_dir), "n_events", 30, 50.0))


@register("cht_activities_histogram")
def q_activities_hist(spark, sf_dir):
    return rounded(ch.histogram(_cases(spark, sf_dir), "n_unique_activities", 20, 20.0))


@register("cht_breach_by_month")
def q_breach_by_month(spark, sf_dir):
    return rounded(ch.breach_by_month(_cases(spark, sf_dir)))


@register("cht_duration_box_by_outcome")
def q_duration_box(spark, sf_dir):
    return rounded(ch.duration_box_by_outcome(_cases(spark, sf_dir)))


@register("cht_breach_by_amount_quintile")
def q_amount_quintile(spark, sf_dir):
    return rounded(ch.breach_by_amount_quintile(_cases(spark, sf_dir, ("requested_amount",))))


@register("cht_event_volume")
def q_event_volume(spark, sf_dir):
    return ch.event_volume_by_month(clean_log(spark, sf_dir, NO_ATTRS))


@register("btn_wait_box_top5")
def q_wait_box(spark, sf_dir):
    return rounded(waits.wait_box_top(_valid(spark, sf_dir), None, 5, 0.95).select(
        "activity", "bottleneck_rank", "n", "q1", "median", "q3", "whisker_low",
        "whisker_high", "n_outliers"))


# --- 2.9 KPI tables --------------------------------------------------------------------

@register("kpi_discovery_summary")
def q_kpi_discovery(spark, sf_dir):
    log = bucketed(clean_log(spark, sf_dir, NO_ATTRS), "clean-log")  # three branches read it
    cases = cs.case_table(cs.case_aggregates(log, MODEL), MODEL)
    counts = vr.variant_counts(dg.case_digests(log, MODEL.slice_hours))
    return rounded(kpi.discovery_summary(log, cases, counts))


def _bottleneck_report(spark, sf_dir, ml_row=None):
    log = bucketed(clean_log(spark, sf_dir, NO_ATTRS), "clean-log")  # three branches read it
    st = waits.bottleneck_stats(waits.valid_transitions(waits.transitions(log, MODEL), MODEL), MODEL)
    conf = cf.conformance(cs.case_aggregates(log, MODEL), MODEL)
    return kpi.bottleneck_summary(st, rw.rework_prevalence(rw.activity_counts(log)),
                                  cf.conformance_rate(conf), ml_row)


@register("kpi_bottleneck_summary")
def q_kpi_bottleneck(spark, sf_dir):
    return rounded(_bottleneck_report(spark, sf_dir), sums=("top_total_wait_days",))


@register("kpi_monthly_trend")
def q_kpi_monthly(spark, sf_dir):
    return rounded(kpi.monthly_trend(_cases(spark, sf_dir)))


@register("kpi_outcome_sla")
def q_kpi_outcome_sla(spark, sf_dir):
    return kpi.outcome_sla_matrix(_cases(spark, sf_dir))


@register("kpi_complexity")
def q_kpi_complexity(spark, sf_dir):
    return rounded(kpi.complexity_vs_duration(_cases(spark, sf_dir)))


# --- 2.1 sources and sinks (round trips through the shared scratch folder) --------------

from caseflow.session import scratch_path  # noqa: E402
from caseflow.sources import csv as csv_src  # noqa: E402
from caseflow.sources import sinks, xes  # noqa: E402


@register("src_xes_roundtrip")
def q_xes_roundtrip(spark, sf_dir):
    """SNK (XES) then SRC-1: the cleaned log written as XES and read back."""
    path = sinks.write_xes(clean_log(spark, sf_dir, ("resource",)), scratch_path(spark, "xes"))
    back = cl.clean(xes.read_xes(spark, path))
    return back.select("case_id", "activity",
                       format_ts("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "resource")


@register("src_csv_event_roundtrip")
def q_csv_event_roundtrip(spark, sf_dir):
    """SNK-1 (CSV) then SRC-2: cleaned log through CSV with a typed schema."""
    path = sinks.write_event_log(clean_log(spark, sf_dir), scratch_path(spark, "evcsv"), "csv")
    back = csv_src.read_event_csv(spark, path)
    return rounded(back.select("case_id", "activity",
                               format_ts("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                               "resource", "requested_amount", "event_seq"))


@register("src_csv_case_roundtrip")
def q_csv_case_roundtrip(spark, sf_dir):
    """SNK-1 (CSV) then SRC-3: the case table with its variants, as the
    discovery job writes it, through CSV."""
    log, digests, counts = _variant_tables(spark, sf_dir)
    full = vr.attach_variants(_cases(spark, sf_dir, CASE_ATTRS), digests, _ranked(log, counts))
    path = sinks.write_table(full, scratch_path(spark, "casecsv"), "csv")
    back = csv_src.read_case_csv(spark, path)
    return rounded(back.withColumn("case_start", format_ts("case_start"))
                   .withColumn("case_end", format_ts("case_end")))


@register("snk_sanitized_cases")
def q_sanitized_cases(spark, sf_dir):
    """SNK-3 on the case table (strings cleaned, timestamps as text)."""
    return rounded(sinks.sanitize_for_export(_cases(spark, sf_dir, CASE_ATTRS)))


@register("snk_sanitize_conversations")
def q_sanitize_conversations(spark, sf_dir):
    """SNK-3 on whole conversation texts (which do hold line breaks)."""
    return sinks.sanitize_for_export(adapters.table(spark, sf_dir, "conversations"))


# --- SRC-5 other adapters ------------------------------------------------------------------

from caseflow.model import REFERENCE_MODEL  # noqa: E402


@register("adp_orders_bottleneck")
def q_orders_bottleneck(spark, sf_dir):
    """Orders + line items as a log: waits are days to years, so the 60-day
    cut of the reference model decides what counts."""
    log = cl.clean(adapters.orders_lineitems(adapters.table(spark, sf_dir, "orders"),
                                             adapters.table(spark, sf_dir, "lineitem")), ())
    valid = waits.valid_transitions(waits.transitions(log, REFERENCE_MODEL), REFERENCE_MODEL)
    return rounded(waits.bottleneck_stats(valid, REFERENCE_MODEL),
                   sums=("total_wait_hours", "total_wait_days", "bottleneck_score"))


@register("adp_conversation_variants")
def q_conversation_variants(spark, sf_dir):
    """Conversations as a log (role per turn): variant counts and ranks."""
    log = bucketed(cl.clean(adapters.conversations_log(adapters.table(spark, sf_dir, "conversations")), ()),
                   "clean-log")
    return vr.ranked_variants(materialised(vr.variant_counts(dg.case_digests(log)), "variant-counts"), log)


@register("adp_user_case_table")
def q_user_cases(spark, sf_dir):
    """Events with one case per user (long cases): durations and outcome."""
    log = cl.clean(adapters.events_user(adapters.table(spark, sf_dir, "events")), ())
    ct = cs.case_table(cs.case_aggregates(log, MODEL), MODEL)
    return rounded(ct.select("case_id", "duration_days", "n_events", "n_unique_activities",
                             "last_activity", "outcome", "sla_breach"))


# --- 2.10 models ------------------------------------------------------------------------

from caseflow.operators import ml  # noqa: E402

def _prepared(spark, sf_dir):
    return ml.prepare(_cases(spark, sf_dir, CASE_ATTRS))


_MODEL_STORE: dict = {}  # of each application: where its queries keep fitted models


def _fit(spark, sf_dir):
    """One fit for all queries of an application over the same cases."""
    app = spark.sparkContext.applicationId
    if app not in _MODEL_STORE:
        _MODEL_STORE[app] = scratch_path(spark, "models")
    return ml.fit_or_load(materialised(_prepared(spark, sf_dir), "prepared"), _MODEL_STORE[app])


@register("ml_features")
def q_ml_features(spark, sf_dir):
    return rounded(ml.feature_table(_cases(spark, sf_dir, CASE_ATTRS)))


@register("ml_class_balance")
def q_ml_balance(spark, sf_dir):
    return rounded(ml.class_balance(ml.feature_table(_cases(spark, sf_dir, CASE_ATTRS))))


@register("ml_balanced_weights")
def q_ml_weights(spark, sf_dir):
    return rounded(ml.balanced_weights(ml.feature_table(_cases(spark, sf_dir, CASE_ATTRS))))


@register("ml_split")
def q_ml_split(spark, sf_dir):
    return ml.split_and_folds(ml.feature_table(_cases(spark, sf_dir))).select(
        "case_id", "label", "is_test", "fold")


@register("ml_model_comparison")
def q_ml_models(spark, sf_dir):
    return ml.comparison(spark, _fit(spark, sf_dir))


@register("ml_feature_importance")
def q_ml_importance(spark, sf_dir):
    return ml.importances(spark, _fit(spark, sf_dir))


@register("ml_roc_points")
def q_ml_roc(spark, sf_dir):
    return ml.roc_points_by_model(_fit(spark, sf_dir))


@register("ml_confusion")
def q_ml_confusion(spark, sf_dir):
    res = _fit(spark, sf_dir)
    return ml.confusion(ml.scored(res, res.best))


# --- streaming: the same operators over a file stream of the events table ------------

from caseflow.streaming import live  # noqa: E402


def _event_stream(spark, sf_dir):
    # the events parquet as a file stream, through the same adapter projection
    raw = live.file_stream(spark, sf_dir, glob="events*.parquet")
    return adapters.events_user_week(raw)


@register("stm_live_activity_frequency")
def q_live_activity_frequency(spark, sf_dir):
    agg = live.live_activity_frequency(_event_stream(spark, sf_dir))
    return live.run_to_table(agg, scratch_path(spark, "live"), scratch_path(spark, "stream-ckpt"))


@register("stm_live_event_volume")
def q_live_event_volume(spark, sf_dir):
    agg = live.live_event_volume(_event_stream(spark, sf_dir))
    return live.run_to_table(agg, scratch_path(spark, "live"), scratch_path(spark, "stream-ckpt"))


@register("adp_user_transitions")
def q_user_transitions(spark, sf_dir):
    """Previous event and position on month-long cases (one per user): each
    case spans ~30 daily slices, so the two-level sequence operator has to
    stitch many slices per case."""
    log = cl.clean(adapters.events_user(adapters.table(spark, sf_dir, "events")), (),
                   MODEL.slice_hours)
    tr = waits.transitions(log, MODEL)
    return rounded(tr.select("case_id", "event_seq", "prev_activity", "waiting_hours",
                             "position"))


# --- rows the reference's users run that have their own query ------------------------

@register("var_top10_activities")
def q_top_activities(spark, sf_dir):
    """DSC-3: the ten most frequent activities in order, with rank."""
    return rounded(vr.activity_frequency(clean_log(spark, sf_dir, NO_ATTRS), 10))


@register("rwk_attached_cases")
def q_attached_rework(spark, sf_dir):
    """JN-4: rework columns joined to the case table."""
    log = clean_log(spark, sf_dir, NO_ATTRS)
    cases = cs.case_table(cs.case_aggregates(log, MODEL), MODEL).drop("has_rework", "rework_events")
    out = rw.attach_rework(cases, rw.case_rework_flags(rw.activity_counts(log)))
    return out.select("case_id", "n_events", "has_rework", "rework_events")


@register("src_csv_conversation_roundtrip")
def q_csv_conversations(spark, sf_dir):
    """SRC-2 / SNK-1 on whole conversation texts (line breaks, quotes) as the
    resource of an event."""
    conv = adapters.table(spark, sf_dir, "conversations")
    log = adapters.conversations_log(conv)
    text = conv.select(F.col("conv_id").cast("string").alias("case_id"),
                       F.col("turn").cast("long").alias("event_seq"), "text")
    log = log.join(text, ["case_id", "event_seq"]).withColumn("resource", F.col("text")).drop("text")
    path = sinks.write_event_log(log, scratch_path(spark, "convcsv"), "csv")
    return csv_src.read_event_csv(spark, path).select("case_id", "event_seq", "activity", "resource")


# --- the declared journal of orders: every cleaning rule has work to do ---------------

def _journal(spark, sf_dir):
    return journal.orders_journal(adapters.table(spark, sf_dir, "orders"),
                                   adapters.table(spark, sf_dir, "lineitem"))


def _journal_log(spark, sf_dir, keep=NO_ATTRS):
    return cl.clean(_journal(spark, sf_dir), keep, MODEL.slice_hours)


def _journal_cases(spark, sf_dir, keep=NO_ATTRS):
    return cs.case_table(cs.case_aggregates(_journal_log(spark, sf_dir, keep), MODEL), MODEL)


@register("jrn_clean_profile")
def q_journal_profile(spark, sf_dir):
    prof = cl.clean_profile(_journal(spark, sf_dir), _journal_log(spark, sf_dir))
    return prof.withColumn("first_date", F.date_format("first_date", "yyyy-MM-dd")) \
               .withColumn("last_date", F.date_format("last_date", "yyyy-MM-dd"))


@register("jrn_clean_log")
def q_journal_log(spark, sf_dir):
    df = _journal_log(spark, sf_dir, CASE_ATTRS)
    return rounded(df.select("case_id", "activity", format_ts("ts").alias("ts"), "resource",
                             F.col("requested_amount"), "event_seq"))


@register("jrn_case_table")
def q_journal_cases(spark, sf_dir):
    log = cl.squeeze_loan_goal(_journal_log(spark, sf_dir, CASE_ATTRS))
    return rounded(cs.case_table(cs.case_aggregates(log, MODEL), MODEL, format_times=True))


@register("jrn_breach_by_month")
def q_journal_breach(spark, sf_dir):
    return rounded(ch.breach_by_month(_journal_cases(spark, sf_dir)))


@register("jrn_event_volume")
def q_journal_volume(spark, sf_dir):
    return ch.event_volume_by_month(_journal_log(spark, sf_dir))


@register("jrn_monthly_trend")
def q_journal_trend(spark, sf_dir):
    return rounded(kpi.monthly_trend(_journal_cases(spark, sf_dir)))


@register("jrn_breach_by_conformance")
def q_journal_conformance(spark, sf_dir):
    aggs = cs.case_aggregates(_journal_log(spark, sf_dir), MODEL)
    return rounded(cf.breach_by_conformance_of(aggs, MODEL))


@register("jrn_ml_features")
def q_journal_features(spark, sf_dir):
    return rounded(ml.feature_table(_journal_cases(spark, sf_dir, CASE_ATTRS)))


# --- model measures on fixed scores (no fit), so that SQL can check them --------------

def _fixed_scores(spark, sf_dir):
    """A score in hundredths from the md5 of the case, and the label."""
    h = F.conv(F.substring(F.md5("case_id"), 1, 6), 16, 10).cast("long")
    return _cases(spark, sf_dir).select(
        "case_id", F.col("sla_breach").alias("label"), (F.pmod(h, F.lit(101)) / 100.0).alias("score")
    ).withColumn("prediction", (F.col("score") >= 0.5).cast("double"))


@register("ml_roc_fixed")
def q_roc_fixed(spark, sf_dir):
    return rounded(ml.roc_points(_fixed_scores(spark, sf_dir)))


@register("ml_auc_fixed")
def q_auc_fixed(spark, sf_dir):
    return rounded(ml.auc_from_roc(ml.roc_points(_fixed_scores(spark, sf_dir))))


@register("ml_confusion_fixed")
def q_confusion_fixed(spark, sf_dir):
    return ml.confusion(_fixed_scores(spark, sf_dir))


@register("kpi_bottleneck_report_models")
def q_report_models(spark, sf_dir):
    """KPI-2 with the best model's measures (rows only: it depends on a fit)."""
    res = _fit(spark, sf_dir)
    comp = ml.comparison(spark, res)
    best = comp.filter("is_best = 1").select(F.col("model").alias("best_model"), "cv_auc", "test_auc", "test_acc")
    top = (ml.importances(spark, res).filter(F.col("model") == res.best)
           .orderBy(F.desc("importance"), F.asc("feature")).limit(1)
           .select(F.col("feature").alias("top_feature"), F.col("importance").alias("top_feature_importance")))
    return _bottleneck_report(spark, sf_dir, best.crossJoin(top))


# --- a growing log -------------------------------------------------------------------

from caseflow.streaming.casestore import CaseStore  # noqa: E402


@register("stm_incremental_case_table")
def q_incremental_cases(spark, sf_dir):
    """The case table from states that three parts of the log (every part holds
    late events of nearly all cases) and a repeated part were merged into."""
    raw = raw_log(spark, sf_dir)
    store = CaseStore(spark, scratch_path(spark, "casestore"), MODEL, buckets=16)
    for part in (1, 0, 2, 0):
        store.append(raw.where(F.col("event_seq") % 3 == part))
    return rounded(cs.case_table(store.aggregates(), MODEL, format_times=True))


# --- stored sketches -----------------------------------------------------------------

from caseflow.operators import sketches as sk  # noqa: E402


def _sketch_report(stored, df, value, group, probs):
    """The sketches of all days as one, and whether each answer's rank is
    within the bound of the exact one."""
    answers = sk.sketch_quantiles(sk.merged_quantile_sketches(stored, group), probs)
    return sk.rank_checked(df, value, group, answers, probs).select(*group, "n", *[f"{p}_ok" for p in probs])


@register("btn_sketch_waits")
def q_sketch_waits(spark, sf_dir):
    """BTN-1 from daily sketches that were stored and merged."""
    valid = materialised(_valid(spark, sf_dir).select("activity", "ts", "waiting_hours"), "waits")
    stored = materialised(sk.daily_quantile_sketches(valid, "waiting_hours", ["activity"]), "sketches")
    return _sketch_report(stored, valid, "waiting_hours", ["activity"],
                          {"median_wait_hours": 0.5, "p90_wait_hours": 0.9})


@register("cht_sketch_durations")
def q_sketch_durations(spark, sf_dir):
    """CHT-5 quartiles by outcome from sketches of the cases of a start day."""
    cases = materialised(_cases(spark, sf_dir).select("outcome", "case_start", "duration_days"), "cases")
    stored = materialised(sk.daily_quantile_sketches(cases, "duration_days", ["outcome"], "case_start"), "sketches")
    return _sketch_report(stored, cases, "duration_days", ["outcome"], {"q1": 0.25, "median": 0.5, "q3": 0.75})


@register("cas_sketch_distinct")
def q_sketch_distinct(spark, sf_dir):
    """AGG-4/5 of cases from daily distinct sketches."""
    stored = materialised(sk.daily_distinct_sketches(clean_log(spark, sf_dir, ("resource",))), "distinct-sketches")
    return sk.distinct_counts(stored, ["case_id"])
