"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from transitio.operators import pairs as PR
from transitio.operators import sequences as SQ
from transitio.sources import testdata as TD
from transitio.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _records(spark, sf_dir, features, period=14, gate=True, once=False):
    """Gated records, materialised (reliable checkpoint in spark.checkpoint.dir) unless the query
    reads them only ``once``: pairs, histories and nesting each read them several times, and the
    sensor joins below them are the expensive part of the plan."""
    t = TD.panel(spark, sf_dir, period)
    rec = SQ.build_records(SQ.valid_assessments(t["phq"]), t, list(features), period, gate=gate)
    return (rec if once else materialize(rec)), t


def _transition_labels(spark: SparkSession, sf_dir: str, period: int) -> DataFrame:
    rec, _ = _records(spark, sf_dir, [], period)
    return PR.adjacent_pairs(rec, [], period).select("user", "date", "prev_date", "phq9", "prev_phq9", "label")


@register("transition_labels")
def transition_labels(spark, sf_dir):
    """Flagship (F15 with W2, P7, P4, F4, J1, J2): nowcast labels at period 14."""
    return _transition_labels(spark, sf_dir, 14)


@register("transition_labels_p7")
def transition_labels_p7(spark, sf_dir):
    """Same at period 7 (gate: more than 3 missing), where gated records leave gaps."""
    return _transition_labels(spark, sf_dir, 7)


# ---------------------------------------------------------------- daily sensor functions
from pyspark.sql import functions as F  # noqa: E402

from transitio.functions import scalar as S  # noqa: E402
from transitio.operators import prompts as PM  # noqa: E402
from transitio.sources.tables import table  # noqa: E402

FOUR = list(SQ.CONFIG_FEATURES)
RECORD_ORDER = [f for f in SQ.PROMPT_FEATURES if f in FOUR]
KINDS = {"battery_afternoon": "int"}


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events", "user_id", "ts", "event_type", "value", "props")


@register("battery_daily")
def battery_daily(spark, sf_dir):
    """F1 + F3: truncated daily mean level and afternoon level per (user, date)."""
    return SQ.battery_daily(TD.battery(_events(spark, sf_dir))).select(
        "user", "date", "battery_mean", "battery_afternoon")


@register("quadratic_mean_std")
def quadratic_mean_std(spark, sf_dir):
    """quadratic mean of the std columns, truncated, 0 when not positive or missing."""
    return SQ.battery_daily(TD.battery(_events(spark, sf_dir))).select("user", "date", "battery_std")


@register("magnitude_max")
def magnitude_max(spark, sf_dir):
    """daily maximum of the epoch magnitudes, 0 when not positive, 1 decimal."""
    acc = TD.accelerometer(_events(spark, sf_dir))
    return acc.select("user", "date", SQ.feature_catalog()["magnitude_max"].expr.alias("magnitude_max"))


@register("magnitude_afternoon")
def magnitude_afternoon(spark, sf_dir):
    """afternoon magnitude, 1 decimal."""
    acc = TD.accelerometer(_events(spark, sf_dir))
    return acc.select("user", "date", SQ.feature_catalog()["magnitude_afternoon"].expr.alias("magnitude_afternoon"))


@register("app_minutes")
def app_minutes(spark, sf_dir):
    """application minutes for every category and epoch."""
    apps = TD.apps(_events(spark, sf_dir))
    cols = [SQ.app_feature(c, e).expr.alias(f"app_{c}_{e}_min") for c in TD.APP_CATEGORIES for e in TD.EPOCHS]
    return apps.select("user", "date", *cols)


@register("screen_hours")
def screen_hours(spark, sf_dir):
    """F8: screen off / use hours for every epoch."""
    scr = TD.screen(_events(spark, sf_dir))
    cat = SQ.feature_catalog()
    return scr.select("user", "date", *[cat[f"screen_{k}_{e}_duration"].expr.alias(f"screen_{k}_{e}_hours")
                                         for k in ("off", "use") for e in TD.EPOCHS])


@register("location_ratio")
def location_ratio(spark, sf_dir):
    """still / moving ratio; NULL if either is missing, +Infinity if moving is 0."""
    loc = TD.location(_events(spark, sf_dir))
    return loc.select("user", "date", SQ.feature_catalog()["location_ratio"].expr.alias("location_ratio"))


@register("location_bins")
def location_bins(spark, sf_dir):
    """visited-places count per day."""
    loc = TD.location(_events(spark, sf_dir))
    return loc.select("user", "date", SQ.feature_catalog()["location_bins"].expr.alias("location_bins"))


# ---------------------------------------------------------------- assessments and sequences
def _valid(spark, sf_dir, period=14):
    return SQ.valid_assessments(TD.phq(_events(spark, sf_dir), period))


@register("valid_assessments")
def valid_assessments(spark, sf_dir):
    """Drop entry (idx 1) and unanswered assessments."""
    return _valid(spark, sf_dir).select("user", "date", "idx", "phq9")


@register("dedupe_first")
def dedupe_first(spark, sf_dir):
    """First survey row per user in file order."""
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    return SQ.dedupe_survey(TD.survey(cust)).select("user", "bg_sex", "group", "bg_age")


@register("date_slots")
def date_slots(spark, sf_dir):
    """the 14 slot dates of each valid assessment, with the yyyy-MM-dd text of the anchor."""
    s = SQ.slots(_valid(spark, sf_dir), 14)
    return s.select("user", "anchor", "idx", "slot", F.col("date").alias("slot_date"),
                    F.date_format("anchor", "yyyy-MM-dd").alias("anchor_text"))


@register("user_window_filter")
def user_window_filter(spark, sf_dir):
    """Battery rows of the same user with date in (anchor - 14, anchor]."""
    anchors = _valid(spark, sf_dir).select("user", F.col("date").alias("anchor"))
    bat = TD.battery(_events(spark, sf_dir)).select("user", "date")
    return SQ.user_window_filter(bat, anchors, 14).select("user", "anchor", "date")


@register("interval_join_sum")
def interval_join_sum(spark, sf_dir):
    """Per valid assessment, days with a battery row and the sum of their daily mean over
    (anchor-14, anchor], computed by slot explosion + equi-join."""
    t = TD.panel(spark, sf_dir, 14)
    sv = SQ.slot_values(SQ.valid_assessments(t["phq"]), t, [], 14)
    return sv.groupBy("user", F.col("anchor").alias("date"), "idx").agg(
        F.count("battery_mean").alias("n_days"),
        F.coalesce(F.sum("battery_mean"), F.lit(0)).cast("bigint").alias("sum_battery_mean"))


@register("zero_mask")
def zero_mask(spark, sf_dir):
    """per valid assessment, masked slots (truncated mean 0), absent battery days, and
    screen slots present vs kept after the mask (absent battery days do not mask screen)."""
    t = TD.panel(spark, sf_dir, 14)
    sv = SQ.slot_values(SQ.valid_assessments(t["phq"]), t, ["screen_off_night_duration"], 14)
    scr = t["screen"].select(F.col("user").alias("_u"), F.col("date").alias("_d"), F.lit(True).alias("_scr"))
    sv = sv.join(scr, (sv["user"] == scr["_u"]) & (sv["date"] == scr["_d"]), "left")
    return sv.groupBy("user", F.col("anchor").alias("date"), "idx").agg(
        F.sum(F.col("masked").cast("int")).cast("bigint").alias("n_masked"),
        F.sum(F.col("battery_std").isNull().cast("int")).cast("bigint").alias("n_absent"),
        F.sum(F.col("_scr").isNotNull().cast("int")).cast("bigint").alias("n_screen_present"),
        F.sum((F.col("_scr").isNotNull() & ~F.col("masked")).cast("int")).cast("bigint").alias("n_screen_kept"))


@register("quality_gate")
def quality_gate(spark, sf_dir):
    """P4 + A2: missing battery slots per valid assessment and the keep decision (<= 7)."""
    rec, _ = _records(spark, sf_dir, [], 14, gate=False, once=True)
    return rec.select("user", "date", "idx", "n_missing", (F.col("n_missing") <= 7).alias("kept"))


def _kept(spark, sf_dir, features=FOUR, period=14, once=False):
    return _records(spark, sf_dir, features, period, once=once)


@register("align_sequence")
def align_sequence(spark, sf_dir):
    """The masked 14-slot magnitude_max sequence of each kept record, as text."""
    rec, _ = _kept(spark, sf_dir, ["magnitude_max"], once=True)
    return rec.select("user", "date", PM.render_sequence("magnitude_max").alias("magnitude_max_seq"))


@register("feature_projection")
def feature_projection(spark, sf_dir):
    """A two-feature configuration (battery_afternoon, screen_off_night_duration)."""
    rec, _ = _kept(spark, sf_dir, ["battery_afternoon", "screen_off_night_duration"], once=True)
    return rec.select("user", "date", "phq9",
                      PM.render_sequence("battery_afternoon", "int").alias("battery_afternoon_seq"),
                      PM.render_sequence("screen_off_night_duration").alias("screen_off_night_duration_seq"))


@register("survey_join")
def survey_join(spark, sf_dir):
    """Kept records with the first survey row of their user."""
    rec, t = _kept(spark, sf_dir, [], once=True)
    return SQ.attach_survey(rec, t["survey"]).select("user", "date", "phq9", "gender", "group", "age")


@register("reject_rows")
def reject_rows(spark, sf_dir):
    """kept records of users without a survey row (here: of users in the BUILDING segment)."""
    rec, t = _kept(spark, sf_dir, [], once=True)
    return SQ.reject_rows(rec, t["survey"].where(F.col("group") == "patient")).select("user", "date", "phq9")


@register("nest_user_records")
def nest_user_records(spark, sf_dir):
    """Per-user nested records; checked through count and first/last entries."""
    rec, t = _kept(spark, sf_dir, FOUR, once=True)
    nested = SQ.nest_user_records(SQ.attach_survey(rec, t["survey"]), FOUR)
    per_chunk = nested.select(
        "user", "gender", "group", "age", "chunk", F.size("data").alias("n"),
        F.col("data")[0]["date_text"].alias("first"), F.element_at("data", -1)["date_text"].alias("last"),
        F.expr("aggregate(data, 0D, (a, r) -> a + r.PHQ_week2)").alias("total"))
    return per_chunk.groupBy("user", "gender", "group", "age").agg(
        F.sum("n").cast("bigint").alias("n_records"), F.min("first").alias("first_date"),
        F.max("last").alias("last_date"), F.sum("total").alias("phq_total"))


@register("adjacent_pairs")
def adjacent_pairs(spark, sf_dir):
    """W2 + P7 + W5: nowcast pairs with both magnitude sequences and states."""
    rec, _ = _kept(spark, sf_dir, ["magnitude_max"])
    p = PR.adjacent_pairs(rec, ["magnitude_max"], 14)
    return p.select("user", "date", "prev_date", "previous_state", "current_state", "label",
                    PM.render_sequence("magnitude_max").alias("cur_seq"),
                    PM.render_sequence("prev_magnitude_max").alias("prev_seq"))


@register("forecast_pairs")
def forecast_pairs(spark, sf_dir):
    """W1 + P8 + P9: forecast framing, label from this record's score to the next one's."""
    rec, _ = _kept(spark, sf_dir, [])
    return PR.forecast_pairs(rec, 14).select("user", "date", "phq9", "future_phq9", "label")


@register("history_average")
def history_average(spark, sf_dir):
    """Expanding mean over all earlier kept records, per metric."""
    rec, _ = _kept(spark, sf_dir, FOUR)
    h = PR.history_average(rec, FOUR)
    return h.select("user", "date", *[f"hist_{f}" for f in FOUR])


@register("severity_state")
def severity_state(spark, sf_dir):
    """state per kept record."""
    rec, _ = _kept(spark, sf_dir, [], once=True)
    return rec.select("user", "date", "phq9", S.severity_state("phq9").alias("state"))


@register("demographic_context")
def demographic_context(spark, sf_dir):
    """context and initial-state sentences of every panel user with a survey row."""
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    users = _events(spark, sf_dir).select(F.col("user_id").alias("user")).distinct()
    sv = SQ.dedupe_survey(TD.survey(cust)).join(users, "user", "left_semi")
    return sv.select("user", PM.user_context("bg_age", "bg_sex").alias("context"),
                     PM.initial_state("group").alias("initial"))


@register("label_code")
def label_code(spark, sf_dir):
    """F16: label text to code (Remains 0, More 1, Less 2)."""
    return transition_labels(spark, sf_dir).select("user", "date", "label", S.label_code("label").alias("code"))


@register("statistics_text")
def statistics_text(spark, sf_dir):
    """K1: current-period statistics sentence of every kept record (4 features)."""
    rec, _ = _kept(spark, sf_dir, FOUR, once=True)
    return rec.select("user", "date", PM.statistics_text(RECORD_ORDER, KINDS).alias("statistics"))


@register("history_text")
def history_text(spark, sf_dir):
    """K2: history sentence of every kept record."""
    rec, _ = _kept(spark, sf_dir, FOUR)
    h = PR.history_average(rec, FOUR)
    return h.select("user", "date", PM.history_text(RECORD_ORDER).alias("history"))


def prompt_frame(spark, sf_dir, features=FOUR, period=14):
    """K4 composition: records -> history -> pairs -> survey -> prompt texts."""
    order = [f for f in SQ.PROMPT_FEATURES if f in features]
    rec, t = _kept(spark, sf_dir, list(features), period)
    h = PR.history_average(rec, list(features), period)
    p = PR.adjacent_pairs(h, list(features), period)
    p = SQ.attach_survey(p, t["survey"])
    return PM.prompt_table(p, order, KINDS)


@register("prompt_table")
def prompt_table(spark, sf_dir):
    """K4: the full prompt table of the four-feature configuration."""
    return prompt_frame(spark, sf_dir)


@register("prompt_variants")
def prompt_variants(spark, sf_dir):
    """K3: the four variants, checked through length and md5."""
    p = prompt_frame(spark, sf_dir)
    cols = []
    for name in ("Basic", "Health_Informtion", "Statistics", "All"):
        cols += [F.length(name).cast("bigint").alias(f"{name.lower()}_len"), F.md5(name).alias(f"{name.lower()}_md5")]
    return p.select("user", "date", *cols)


# ---------------------------------------------------------------- evaluation
from transitio.operators import evaluate as EV  # noqa: E402
from transitio.operators import sampling as SM  # noqa: E402


def _class(spark, sf_dir):
    return TD.class_table(spark, sf_dir)


def _qt(spark, sf_dir):
    """(true, predicted) = (quality, toxic) as label strings."""
    return _class(spark, sf_dir).select("doc_id", "lang", F.col("quality").cast("string").alias("y"),
                                        F.col("toxic").cast("string").alias("yhat"))


@register("eval_metrics")
def eval_metrics(spark, sf_dir):
    """A5 + A7 (+ J8 by doc_id): accuracy, macro and weighted P/R/F1 per language."""
    return EV.metrics(_qt(spark, sf_dir), "y", "yhat", ["lang"])


@register("confusion_matrix")
def confusion_matrix(spark, sf_dir):
    """A4: confusion cells over the union of labels, zero cells included."""
    return EV.confusion_matrix(_qt(spark, sf_dir), "y", "yhat")


@register("class_report")
def class_report(spark, sf_dir):
    """Per-label precision, recall, F1 and support per language."""
    pl = EV.per_label(_qt(spark, sf_dir), "y", "yhat", ["lang"])
    return pl.select("lang", "label", *[F.round(c, 10).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("class_report_full")
def class_report_full(spark, sf_dir):
    """Report over the fixed labels 0, 1, 2 plus accuracy / macro avg / weighted avg rows."""
    return EV.report(_qt(spark, sf_dir), "y", "yhat", ["0", "1", "2"])


@register("class_counts")
def class_counts(spark, sf_dir):
    """A3 + A12: class sizes, their mean and the number of classes."""
    return EV.class_counts(_class(spark, sf_dir), "label")


# ---------------------------------------------------------------- splitting and sampling
def _split(spark, sf_dir, seed=1):
    return SM.group_split(_class(spark, sf_dir), "source", seed)


@register("group_split")
def group_split(spark, sf_dir):
    """R1 + J5: ceil(0.4 G) sources to test, the rest train, every row follows its source."""
    return _split(spark, sf_dir).select("doc_id", "source", "side")


@register("two_stage_split")
def two_stage_split(spark, sf_dir):
    """R2: test 40% of sources, remaining sources halved into train / eval."""
    return SM.two_stage_split(_class(spark, sf_dir), "source", 1).select("doc_id", "source", "side")


@register("split_all_seeds")
def split_all_seeds(spark, sf_dir):
    """The group split for seeds 1..5 in one plan (seed as a column)."""
    ct = SM.seeds_frame(_class(spark, sf_dir).select("doc_id", "source"), [1, 2, 3, 4, 5])
    return SM.group_split(ct, "source", "seed", keys=["seed"]).select("seed", "doc_id", "side")


@register("oversample")
def oversample(spark, sf_dir):
    """R3 + X1: minority classes of the train side get int(mean) drawn copies appended."""
    train = _split(spark, sf_dir).where("side = 'train'").select("doc_id", "label")
    return SM.oversample(train, "label", "doc_id", 1).select("doc_id", "label", "copy", "draw")


@register("holdout_split")
def holdout_split(spark, sf_dir):
    """First int(0.2 n) rows in hash order are validation."""
    return SM.holdout_split(_class(spark, sf_dir).select("doc_id"), "doc_id", 1).select("doc_id", "side")


@register("stratified_folds")
def stratified_folds(spark, sf_dir):
    """Three balanced folds within each label."""
    ct = _class(spark, sf_dir).select("doc_id", "label")
    return SM.stratified_folds(ct, "label", "doc_id", 1, 3).select("doc_id", "label", "fold")


def _few_shot(spark, sf_dir, n, queries_side=None):
    """Split + few-shot pairs over narrow rows (ids, stratum, label, text hash). The split is
    checkpointed once (it feeds pool and queries), so the document scan and the splitting
    joins run once; full texts are joined back by id only where a chat needs them."""
    ct = _class(spark, sf_dir).select("doc_id", "source", "lang", "label", SM.text_hash("data", 1).alias("th"))
    sp = materialize(SM.group_split(ct, "source", 1))
    pool = sp.where("side = 'train'")
    queries = sp if queries_side is None else sp.where(F.col("side") == queries_side)
    # Examples come from the oversampled train side (R3); ``pool`` stays one row per document.
    drawn = SM.oversample(pool, "label", "doc_id", 1)
    pairs = SM.few_shot_positions(drawn, queries, "lang", "th", "doc_id", "doc_id", n, 1, hashed=True, materialize=True)
    return sp, pool, queries, pairs


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text")


@register("few_shot_pairs")
def few_shot_pairs(spark, sf_dir):
    """5 examples per row from the oversampled train pool, same language, different text."""
    return _few_shot(spark, sf_dir, 5)[3]


@register("same_subject_examples")
def same_subject_examples(spark, sf_dir):
    """3 examples of the same subject (source), excluding the row itself."""
    ct = _class(spark, sf_dir).select("doc_id", "source")
    return SM.few_shot_positions(ct, ct, "source", "doc_id", "doc_id", "doc_id", 3, 1)


@register("any_subject_examples")
def any_subject_examples(spark, sf_dir):
    """3 examples of any subject, excluding the row itself."""
    ct = _class(spark, sf_dir).select("doc_id", F.lit("all").alias("anyone"))
    return SM.few_shot_positions(ct, ct, "anyone", "doc_id", "doc_id", "doc_id", 3, 1)


def _best_votes(pairs, pool, keys=()):
    k = list(keys)
    ex = pairs.join(pool.select(F.col("doc_id").alias("example_id"), F.col("label").alias("ex_label")), "example_id")
    votes = ex.groupBy(*k, "doc_id", "ex_label").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy(*k, "doc_id").orderBy(F.col("votes").desc(), S.label_code("ex_label"))
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*k, "doc_id", F.col("ex_label").alias("predicted"))


def _votes(pairs, pool, queries, keys=()):
    k = list(keys)
    return queries.join(_best_votes(pairs, pool, k), k + ["doc_id"], "left").withColumn(
        "predicted", F.coalesce("predicted", F.lit(S.LABEL_REMAINS)))


from pyspark.sql import Window  # noqa: E402


@register("few_shot_vote")
def few_shot_vote(spark, sf_dir):
    """K16 native predictor: majority label of the row's 5 few-shot examples (ties by label code)."""
    _, pool, queries, pairs = _few_shot(spark, sf_dir, 5, "test")
    return _votes(pairs, pool, queries.select("doc_id", "label")).select("doc_id", "label", "predicted")


@register("aligned_predictions")
def aligned_predictions(spark, sf_dir):
    """The votes of one example per row, aligned with the test rows by row id; rows of an
    odd id are left unanswered."""
    _, pool, queries, pairs = _few_shot(spark, sf_dir, 1, "test")
    votes = _best_votes(pairs, pool).where("doc_id % 2 = 0")
    return EV.align_predictions(queries.select("doc_id", "label"), votes, "doc_id")


SHOTS = [0, 1, 3, 5, 10, 15, 25]
SEEDS = [1, 2, 3, 4, 5]


@register("shots_curve")
def shots_curve(spark, sf_dir):
    """Accuracy and macro F1 of the vote predictor for 0..25 shots, nested samples."""
    _, pool, queries, pairs = _few_shot(spark, sf_dir, max(SHOTS), "test")
    ranked = SM.shuffled_ordinals(pairs, "doc_id", 1)
    shots = F.array(*[F.lit(s) for s in SHOTS])
    ex = ranked.withColumn("n_shots", F.explode(shots)).where(F.col("rank") < F.col("n_shots"))
    q = queries.select("doc_id", "label").withColumn("n_shots", F.explode(shots))
    pred = _votes(ex, pool, q, ["n_shots"])
    m = EV.metrics(pred, "label", "predicted", ["n_shots"])
    return m.select("n_shots", "accuracy", "macro_f1")


#: Prompt style -> its column of the prompt table.
STYLES = {s: PM.style_column(s) for s in ("Basic", "Health_Information", "Statistics", "All")}


def _incontext(spark, sf_dir, n, seeds, styles):
    """The in-context chain on the prompt table, all seeds and styles in one plan: users split per seed, the
    train side oversampled, examples of the query's previous state but another text.

    Returns the prompts (pair, texts), the test rows (seed, style, pair, label) and their examples."""
    prompts = materialize(prompt_frame(spark, sf_dir).withColumn("pair", F.concat_ws(":", "user", "date")))
    keys, seed = ["seed", "style"], F.col("seed")
    rows = SM.seeds_frame(prompts.select("pair", "user", "previous_state", "label"), seeds)
    sides = materialize(SM.group_split(rows, "user", "seed", keys=["seed"], row_id="pair"))
    train = SM.oversample(sides.where("side = 'train'"), "label", "pair", seed, keys=["seed"])
    # texts are compared by hash, one row per seed, style and pair
    texts = SM.seeds_frame(prompts, seeds).select("seed", "pair", F.explode(F.array(*[
        F.struct(F.lit(s).alias("style"), SM.text_hash(STYLES[s], seed).alias("th")) for s in styles])).alias("t")).select("seed", "pair", "t.*")
    pool = train.select("seed", "pair", "previous_state").join(texts, ["seed", "pair"])
    queries = sides.where("side = 'test'").join(texts, ["seed", "pair"])
    pairs = SM.few_shot_positions(pool, queries, "previous_state", "th", "pair", "pair", n, seed, hashed=True, materialize=True, keys=keys)
    return prompts, queries.select(*keys, "pair", "label"), pairs


@register("incontext_curve")
def incontext_curve(spark, sf_dir):
    """K17 on the prompt table: accuracy and macro F1 of the vote predictor for every seed, prompt style and
    number of shots; a row's samples are nested."""
    prompts, queries, pairs = _incontext(spark, sf_dir, max(SHOTS), SEEDS, list(STYLES))
    keys, shots = ["seed", "style", "n_shots"], F.array(*[F.lit(s) for s in SHOTS])
    ranked = SM.shuffled_ordinals(pairs, "pair", F.col("seed"), ["seed", "style"]).where("example_id IS NOT NULL")
    labels = prompts.select(F.col("pair").alias("example_id"), F.col("label").alias("ex_label"))
    votes = ranked.join(labels, "example_id").withColumn("n_shots", F.explode(F.filter(shots, lambda s: s > F.col("rank")))) \
        .groupBy(*keys, "pair", "ex_label").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(*keys, "pair").agg(F.max(F.struct("votes", -S.label_code("ex_label"), "ex_label")).alias("b")) \
        .select(*keys, "pair", F.col("b.ex_label").alias("predicted"))
    asked = queries.withColumn("n_shots", F.explode(shots)).join(best, [*keys, "pair"], "left") \
        .withColumn("predicted", F.coalesce("predicted", F.lit(S.LABEL_REMAINS)))
    return EV.metrics(asked, "label", "predicted", keys).select(*keys, "accuracy", "macro_f1", "n")


@register("incontext_chats")
def incontext_chats(spark, sf_dir):
    """J6 + K6 + K7 on the prompt table: the test chats of seed 1 in every style, with three examples, rendered."""
    prompts, queries, pairs = _incontext(spark, sf_dir, 3, [1], list(STYLES))
    texts = prompts.select("pair", "label", F.explode(F.array(*[F.struct(F.lit(s).alias("style"), F.col(c).alias("data"))
                                                               for s, c in STYLES.items()])).alias("t")).select("pair", "label", "t.*")
    ex = texts.select("style", F.col("pair").alias("example_id"), F.struct("data", "label").alias("ex"))
    given = pairs.join(ex, ["style", "example_id"]).groupBy("style", "pair") \
        .agg(F.sort_array(F.collect_list(F.struct("j", "ex"))).alias("_ex"))  # three at most
    rows = queries.select("style", "pair").join(texts, ["style", "pair"]).join(given, ["style", "pair"], "left")
    text = PM.render_chat(PM.chat_messages(F.col("data"), F.col("label"), F.transform("_ex", lambda e: e["ex"]), False))
    return rows.select("style", "pair", F.coalesce(F.size("_ex"), F.lit(0)).alias("n_examples"), F.length(text).cast("bigint").alias("chat_len"),
                       F.md5(text).alias("chat_md5"))


def _chat_rows(spark, sf_dir, side, n):
    """Query rows with their ordered examples (text + label), texts joined back by id."""
    _, pool, queries, pairs = _few_shot(spark, sf_dir, n, side)
    texts = _texts(spark, sf_dir)
    ex = pairs.join(pool.select(F.col("doc_id").alias("example_id"), F.col("label").alias("ex_label")), "example_id") \
        .join(texts.select(F.col("doc_id").alias("example_id"), F.col("text").alias("ex_data")), "example_id")
    grouped = ex.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("j", "ex_data", "ex_label"))).alias("_ex"))
    own = queries.select("doc_id", "label").join(texts.select("doc_id", F.col("text").alias("data")), "doc_id")
    return own.join(grouped, "doc_id", "left")


def _chats(spark, sf_dir, side, with_answer):
    rows = _chat_rows(spark, sf_dir, side, 3)
    examples = F.transform("_ex", lambda e: F.struct(e["ex_data"].alias("data"), e["ex_label"].alias("label")))
    msgs = PM.chat_messages(F.col("data"), F.col("label"), examples, with_answer)
    out = rows.select("doc_id", msgs.alias("messages"))
    text = PM.render_chat("messages")
    return out.select("doc_id", F.size("messages").cast("bigint").alias("n_messages"),
                      F.length(text).cast("bigint").alias("chat_len"), F.md5(text).alias("chat_md5"))


@register("chat_train")
def chat_train(spark, sf_dir):
    """K5 + K7 + K20: 3-shot training chats of the train side, rendered."""
    return _chats(spark, sf_dir, "train", True)


@register("chat_test")
def chat_test(spark, sf_dir):
    """K6 + K7: 3-shot test chats (no final label), rendered."""
    return _chats(spark, sf_dir, "test", False)


@register("chat_render")
def chat_render(spark, sf_dir):
    """K7: conversations rendered with the explicit fallback template."""
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    msgs = conv.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    msgs = msgs.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    text = PM.render_chat("messages")
    return msgs.select("conv_id", F.size("messages").cast("bigint").alias("n_turns"),
                       F.length(text).cast("bigint").alias("chat_len"), F.md5(text).alias("chat_md5"))


# Fixed test suffixes appended to a prompt to play generated answers.
GENERATED_SUFFIXES = ("\nLabel: Remains", " Label: More Depressed", "Label: Less Depressed.", "no idea")


@register("parse_label")
def parse_label(spark, sf_dir):
    """K8: generated = prompt + suffix chosen by md5(doc_id) mod 4; parse the answer."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    suffix = F.element_at(F.array(*[F.lit(s) for s in GENERATED_SUFFIXES]),
                          (F.pmod(S.md5_int(F.col("doc_id").cast("string")), F.lit(4)) + 1).cast("int"))
    gen = docs.select("doc_id", F.col("text").alias("prompt"), F.concat("text", suffix).alias("generated"))
    label, parsed = PM.parse_answer("generated", "prompt")
    return gen.select("doc_id", label.alias("label"), parsed.alias("parsed"))


# ---------------------------------------------------------------- model preparation
from transitio.operators import prepare as PP  # noqa: E402


def _forecast(spark, sf_dir):
    """Forecast pairs of the four-feature configuration with survey columns."""
    rec, t = _kept(spark, sf_dir, FOUR)
    return SQ.attach_survey(PR.forecast_pairs(rec, 14), t["survey"])


@register("flatten_sequences")
def flatten_sequences(spark, sf_dir):
    """P10 + P11: the flat feature table (4 x 14 step columns) in the fixed column order."""
    return PP.flat_feature_table(_forecast(spark, sf_dir))


@register("sequence_matrix")
def sequence_matrix(spark, sf_dir):
    """K12 + F17: flat columns back to a time-major 14 x 4 matrix, rendered as text."""
    flat = PP.flat_feature_table(_forecast(spark, sf_dir))
    cols = [c for c in flat.columns if c.split("_")[-1].isdigit()]
    m = PP.sequence_matrix(PP.feature_prefixes(cols))
    text = F.array_join(F.transform(m, lambda r: F.array_join(F.transform(r, lambda v: PM.render_number(v)), " ")), "; ")
    return flat.select("user_id", "phq_week2", text.alias("matrix"))


@register("numeric_coerce")
def numeric_coerce(spark, sf_dir):
    """tree path (fill, then coerce: bad text stays missing) vs sequence path (fill again)."""
    ct = _class(spark, sf_dir).select(
        "doc_id", F.col("source").alias("r1"), F.expr("substring(source, 4)").alias("r2"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit("NaN"))
        .otherwise(F.col("lang")).alias("r3"))
    return ct.select("doc_id", *[S.coerce_numeric(f"r{i}", False).alias(f"tree_{i}") for i in (1, 2, 3)],
                     *[S.coerce_numeric(f"r{i}", True).alias(f"seq_{i}") for i in (1, 2, 3)])


def _dims(emb) -> int:
    """Longest embedding of the table (one aggregate)."""
    return emb.agg(F.max(F.size("embedding"))).first()[0] or 0


@register("standard_scale")
def standard_scale(spark, sf_dir):
    """A10 + K10: z-scores of every embedding dimension with train-side mean / population std."""
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    cols = [f"z_{i}" for i in range(_dims(emb))]
    e = emb.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    sp = SM.holdout_split(e, "vec_id", 1)
    stats = PP.standard_stats(sp.where("side = 'train'"), cols)
    return PP.standard_scale(sp, stats, cols, digits=6).select("vec_id", "side", *cols)


@register("minmax_sequences")
def minmax_sequences(spark, sf_dir):
    """A11 + K11: sequences filled with 0, min-max scaled per feature with train-user statistics."""
    fc = SM.group_split(_forecast(spark, sf_dir), "user", 1)
    filled = fc.select("user", "date", "side", *[F.transform(f, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias(f)
                                                 for f in FOUR])
    stats = PP.minmax_stats(filled.where("side = 'train'"), FOUR)
    scaled = PP.minmax_scale(filled, stats, FOUR)
    return scaled.select("user", "date", "side", *[
        F.round(F.aggregate(f, F.lit(0.0), lambda a, x: a + x), 6).alias(f"mm_sum_{f}") for f in FOUR])


@register("label_encode")
def label_encode(spark, sf_dir):
    """X4 + K9: alphabetical label codes fitted on train + eval of the two-stage user split."""
    sp = SM.two_stage_split(_forecast(spark, sf_dir), "user", 1)
    d = PP.label_dictionary([sp.where("side = 'train'"), sp.where("side = 'eval'")], "label")
    return PP.encode_labels(sp, d, "label").select("user", "date", "side", "label", "code")


@register("argmax_class")
def argmax_class(spark, sf_dir):
    """Predicted class = first arg-max of all embedding values."""
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return emb.select("vec_id", "label", PP.argmax_class(F.col("embedding")).alias("predicted"))


# ---------------------------------------------------------------- study, sinks and restart
from transitio import session as SE  # noqa: E402
from transitio.plans import study as ST  # noqa: E402
from transitio.plans import tree_study as TS  # noqa: E402
from transitio.sources import io as IO  # noqa: E402
from transitio.sources import runs as RU  # noqa: E402


def study_detail(spark, sf_dir):
    """Results-table fixture: customer x nation (25-row TPC-H dimension, broadcast by its
    fixed size). Negative account balances play failed runs (NULL macro F1)."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"], "inner")
    k = F.col("c_custkey")
    return j.select(
        k.alias("random_seed"), F.col("c_mktsegment").alias("model"), F.col("n_name").alias("feature_set"),
        ((k % 97) / 97.0).alias("accuracy"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 10000.0).alias("macro_f1"),
        ((k % 89) / 89.0).alias("weighted_f1"), ((k % 83) / 83.0).alias("macro_precision"),
        ((k % 79) / 79.0).alias("macro_recall"), (F.lit(14) * (1 + F.col("n_nationkey") % 4)).cast("int").alias("num_features"))


@register("study_summary")
def study_summary(spark, sf_dir):
    """A9 (+ X5 input, S6 shape): mean / sample std per (model, feature_set), rounded to 4."""
    return ST.summarize(study_detail(spark, sf_dir))


@register("top_performers")
def top_performers(spark, sf_dir):
    """Top 10 cells by mean macro F1."""
    return ST.top_performers(ST.summarize(study_detail(spark, sf_dir))).select(
        "model", "feature_set", "macro_f1_mean", "macro_f1_std", "accuracy_mean")


@register("best_per_group")
def best_per_group(spark, sf_dir):
    """Best model per feature set and best feature set per model."""
    return ST.best_per_group(ST.summarize(study_detail(spark, sf_dir)))


@register("best_params")
def best_params(spark, sf_dir):
    """Best run per cell, strictly greater macro F1 wins, earlier run wins ties, failed skipped."""
    runs = study_detail(spark, sf_dir)
    return EV.best_run(runs, ["model", "feature_set"], "macro_f1", "random_seed").select(
        "model", "feature_set", "random_seed", "macro_f1")


@register("experiment_grid")
def experiment_grid(spark, sf_dir):
    """X3 + R7: the (model, feature_set) cells present in the results, x 5 seeds."""
    cells = study_detail(spark, sf_dir).select("model", "feature_set").distinct()
    return ST.experiment_grid(cells, [1, 2, 3, 4, 5])


@register("feature_power_set")
def feature_power_set(spark, sf_dir):
    """The 15 feature configurations with the records and present values each covers."""
    rec, _ = _kept(spark, sf_dir, FOUR, once=True)
    return ST.configuration_coverage(rec, FOUR)


@register("prompt_length_stats")
def prompt_length_stats(spark, sf_dir):
    """Prompt length per style in characters and whitespace words."""
    return ST.prompt_length_stats(prompt_frame(spark, sf_dir), ["Basic", "Health_Informtion", "Statistics", "All"])


@register("prompt_style_select")
def prompt_style_select(spark, sf_dir):
    """P12 + P13: each accepted style name projects its prompt column to (data, state, label)."""
    p = prompt_frame(spark, sf_dir)
    parts = [PM.select_style(p, s, keep=("user", "date")).withColumn("style", F.lit(s))
             for s in ("Basic", "Health_Information", "Statistics", "All")]
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    return u.select("style", "user", "date", F.length("data").cast("bigint").alias("data_len"),
                    F.md5("data").alias("data_md5"), "previous_state", "label")


@register("csv_roundtrip")
def csv_roundtrip(spark, sf_dir):
    """S1 + S2 + S5: the prompt table written as headered CSV with the reference column
    names, read back with an explicit schema."""
    p = prompt_frame(spark, sf_dir).drop("date")
    path = SE.scratch_dir(spark, "prompts-csv")
    IO.write_csv(p, path, IO.PROMPT_CSV_NAMES)
    schema = T.StructType([T.StructField(IO.PROMPT_CSV_NAMES[c], T.LongType() if c == "user" else
                                         T.DoubleType() if c.endswith("_phq") else T.StringType()) for c in p.columns])
    return IO.read_csv(spark, path, schema)


from pyspark.sql import types as T  # noqa: E402


@register("load_inputs_roundtrip")
def load_inputs_roundtrip(spark, sf_dir):
    """The seven input files written under their names and headers, loaded by header with types checked,
    then the two-feature records of ``feature_projection`` built from them."""
    path = SE.scratch_dir(spark, "inputs")
    IO.write_inputs(TD.panel(spark, sf_dir, 14), f"{path}/csv")
    t, _ = IO.load_inputs(spark, f"{path}/csv", f"{path}/parsed")
    two = ["battery_afternoon", "screen_off_night_duration"]
    rec = SQ.build_records(SQ.valid_assessments(t["phq"]), t, two, 14)
    return rec.select("user", "date", "phq9", PM.render_sequence("battery_afternoon", "int").alias("battery_afternoon_seq"),
                      PM.render_sequence("screen_off_night_duration").alias("screen_off_night_duration_seq"))


@register("sequence_json_unnest")
def sequence_json_unnest(spark, sf_dir):
    """S4 + S3: nested user records written as JSON Lines, read back with a declared
    schema (sequences as text, then try_cast) and unnested to one row per record."""
    rec, t = _kept(spark, sf_dir, FOUR, once=True)
    nested = SQ.nest_user_records(SQ.attach_survey(rec, t["survey"]), FOUR)
    path = SE.scratch_dir(spark, "sequences-json")
    IO.write_nested_json(nested, path)
    flat = IO.read_nested_json(spark, path, FOUR)
    return flat.select("user", "gender", "group", "age", "date", "phq9",
                       *[PM.render_sequence(f, KINDS.get(f, "double")).alias(f"s_{f}") for f in FOUR])


@register("results_sink")
def results_sink(spark, sf_dir):
    """S6 + S7: the shot-count metrics written partitioned by n_shots, read back."""
    path = SE.scratch_dir(spark, "results")
    IO.write_results(shots_curve(spark, sf_dir), path, ["n_shots"], "json", "overwrite")
    return spark.read.json(path).select("n_shots", "accuracy", "macro_f1")


def _manifest_events(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return ev.select(F.col("user_id").alias("user"), F.to_date("ts").alias("date"), "ts", "event_type", "value",
                     F.get_json_object("props", "$.k").cast("int").alias("k"))


def _run_grid(ev):
    start, n_days = TD.panel_range(ev)
    days = F.sequence(F.lit(start), F.date_add(F.lit(start), max(n_days - 1, 0)), F.expr("INTERVAL 1 DAY"))
    return ev.select("user").distinct().select("user", F.explode(days).alias("date"))


@register("pending_runs_both")
def pending_runs_both(spark, sf_dir):
    """Grid keys without both a JSON and a CSV result (kind = json if k is even)."""
    ev = _manifest_events(spark, sf_dir)
    manifest = ev.select("user", "date", F.when(F.col("k") % 2 == 0, "json").otherwise("csv").alias("kind"))
    return IO.pending_runs_both(_run_grid(ev), manifest, ["user", "date"])


@register("pending_runs_latest_valid")
def pending_runs_latest_valid(spark, sf_dir):
    """Grid keys whose newest result (by time) lacks Accuracy or Macro F1."""
    ev = _manifest_events(spark, sf_dir)
    manifest = ev.select("user", "date", F.col("ts").alias("file_time"),
                         F.when(F.col("event_type") != "error", F.col("value")).alias("Accuracy"),
                         F.when(F.col("event_type") != "signup", F.col("value")).alias("Macro F1"))
    return IO.pending_runs_latest_valid(_run_grid(ev), manifest, ["user", "date"], "file_time", ["Accuracy", "Macro F1"])


@register("score_prompts")
def score_prompts(spark, sf_dir):
    """Rendered test chats scored by a predictor through mapInPandas (fallback
    predictor here), answers parsed in SQL."""
    rows = _chat_rows(spark, sf_dir, "test", 3)
    examples = F.transform("_ex", lambda e: F.struct(e["ex_data"].alias("data"), e["ex_label"].alias("label")))
    prompts = rows.select("doc_id", "label", PM.render_chat(PM.chat_messages(F.col("data"), F.col("label"), examples,
                                                                            False)).alias("prompt"))
    return ST.score_prompts(prompts, "prompt", ST.fallback_predictor_factory, ["doc_id", "label"])


@register("score_resumed")
def score_resumed(spark, sf_dir):
    """K16 over two runs: the first scores the even ids and ends; the second, with another predictor, is
    asked for all rows and scores only those without an answer."""
    path = SE.scratch_dir(spark, "answers")
    ct = _class(spark, sf_dir).select("doc_id", "label", F.col("data").alias("prompt"))
    ST.score_resumable(ct.where("doc_id % 2 = 0"), ["doc_id"], "prompt", ST.fallback_predictor_factory, path, slices=4)
    more = lambda: lambda prompts: prompts + "Label: More Depressed"
    return ST.score_resumable(ct, ["doc_id"], "prompt", more, path, slices=4).select("doc_id", "label", "predicted", "parsed")


@register("run_restart")
def run_restart(spark, sf_dir):
    """S7 + S8 + S9 on written files: runs keyed by language and fold are published, published again without a
    metric, broken off before publishing, or never made; then each key's state and newest results."""
    path, keys = SE.scratch_dir(spark, "runs"), ["lang", "fold"]
    rows = materialize(_qt(spark, sf_dir).withColumn("fold", (F.col("doc_id") % 5).cast("int")))
    made = EV.metrics(rows, "y", "yhat", keys).select(*keys, "accuracy", "macro_f1")
    start = dt.datetime(2024, 1, 1)
    RU.write_run(rows.where("fold < 4"), made.where("fold < 4"), path, keys, at=start)
    RU.write_run(rows.where("fold = 1"), made.where("fold = 1").drop("macro_f1"), path, keys, at=start + dt.timedelta(hours=1))
    RU.write_scored(rows.where("fold = 2"), path, keys, "broken-off")
    grid, types = rows.select(*keys).distinct(), T.StructType([rows.schema[k] for k in keys])
    attempts = RU.published(spark, path, types)
    last = RU.newest(attempts, keys)
    metrics = RU.read_evaluation(spark, path, T.StructType([made.schema["accuracy"], made.schema["macro_f1"], *types.fields]), last, keys)
    scored = RU.read_scored(spark, path, T.StructType([f for f in rows.schema.fields if f.name not in keys] + types.fields), last, keys)
    right = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_scored"), F.sum((F.col("y") == F.col("yhat")).cast("bigint")).alias("n_right"))
    both = RU.pending_published(grid, attempts, keys).withColumn("_b", F.lit(True))
    valid = RU.pending_newest_valid(grid, last, metrics, keys, ["accuracy", "macro_f1"]).withColumn("_v", F.lit(True))
    out = grid.join(both, keys, "left").join(valid, keys, "left").join(metrics.drop("attempt"), keys, "left").join(right, keys, "left")
    return out.select(*keys, F.col("_b").isNull().alias("done_both"), F.col("_v").isNull().alias("done_valid"), "accuracy", "macro_f1",
                      F.coalesce("n_scored", F.lit(0)).cast("bigint").alias("n_scored"), "n_right")


def _study_sets() -> dict[str, list[str]]:
    """The 15 feature sets of the four sequence features, 14 columns each."""
    return {name: [f"{f}_{i}" for f, on in zip(FOUR, flags) if on for i in range(1, 15)]
            for _, name, flags in ST.power_set_configs(FOUR)}


def _study_table(spark, sf_dir, seeds):
    """All seeds' rows of the study on the flat forecast features; a row is a user's date."""
    pairs = _forecast(spark, sf_dir)
    rows = pairs.select(F.concat_ws(":", "user", "date").alias("pair"), "user", "label", *PP.flatten_sequences(pairs))
    cols = [f"{f}_{i}" for f in PP.FLAT_FEATURE_ORDER for i in range(1, 15)]
    return TS.study_table(rows, cols, seeds, "pair", "user", "label"), cols


@register("study_inputs")
def study_inputs(spark, sf_dir):
    """K15's inputs: per seed and feature set every train (with drawn) and eval row, its fold, label code and the
    sum of the set's scaled columns (R2, R3, R6, R7, X2, X4, K9, K10, A10)."""
    rows, cols = _study_table(spark, sf_dir, SEEDS)
    z = TS.scaled(rows, cols)
    sums = F.array(*[sum((F.col(f"{f}_{i}") for i in range(2, 15)), F.col(f"{f}_1")) for f in FOUR])
    sets = F.explode(ST.config_array(FOUR)).alias("c")
    one = z.select("random_seed", "pair", "draw", "side", "fold", "code", sums.alias("s"), sets)
    total = sum((F.when(F.col("c.flags")[i], F.col("s")[i]).otherwise(0.0) for i in range(len(FOUR))), F.lit(0.0))
    return one.select("random_seed", F.col("c.feature_set").alias("feature_set"), "pair", "draw", "side", "fold", "code",
                      F.round(total, 6).alias("z_sum"))


@register("rf_study")
def rf_study(spark, sf_dir):
    """Random forests over the full grid (108 cells, 3 folds, up to 200 trees) on all embedding dimensions."""
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    cols = [f"e_{i}" for i in range(_dims(emb))]
    kind = emb.schema["embedding"].dataType.elementType.simpleString()
    data = emb.select("vec_id", F.col("label").cast("string").alias("label"),
                      *[F.col("embedding")[i].cast(kind if kind == "float" else "double").alias(c) for i, c in enumerate(cols)])

    def holdout(rows):
        return SM.holdout_split(rows, "vec_id", 1).withColumn("side", F.when(F.col("side") == "validation", "eval").otherwise("train"))
    rows = TS.study_table(data.withColumn("subject", F.col("vec_id")), cols, [1], "vec_id", "subject", "label", holdout, keep=False)
    return TS.run(rows, {"embedding": cols}, {"random_forest": TS.GRIDS["random_forest"]}, [1])


@register("gbt_study")
def gbt_study(spark, sf_dir):
    """Boosted trees on all 56 flat columns; 8 of the 144 cells (50 rounds, rate 0.1, depth 3 and 4), seed 1."""
    rows, cols = _study_table(spark, sf_dir, [1])
    grid = {**TS.GRIDS["gradient_boosting"], "n_estimators": [50], "learning_rate": [0.1], "max_depth": [3, 4]}
    return TS.run(rows, {"all": cols}, {"gradient_boosting": grid}, [1])


@register("study_runs")
def study_runs(spark, sf_dir):
    """K15 + X5: 5 seeds x 15 feature sets x 2 models; one cell of each grid, 50 trees or 10 rounds."""
    rows, _ = _study_table(spark, sf_dir, SEEDS)
    grids = {"random_forest": {"n_estimators": [50], "max_depth": [5], "min_samples_split": [2], "min_samples_leaf": [1]},
             "gradient_boosting": {"n_estimators": [10], "max_depth": [3], "learning_rate": [0.1], "subsample": [0.8],
                                   "colsample_bytree": [0.8]}}
    return TS.run(rows, _study_sets(), grids, SEEDS)
