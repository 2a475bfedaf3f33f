"""Text rendering: sequence statistics, histories, prompt variants, chats and answer parsing
(K1-K8, P12, P13). All ``concat`` / ``array_join`` / ``transform`` expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitio.functions import scalar as S

# ---- Fixed values: wording that must equal the reference's prompts verbatim. ----
PREVIOUS_DESCRIPTIONS = {
    "battery_afternoon": "Average battery levels in the afternoon over the previous two weeks, reported as a percentage",
    "screen_off_night_duration": "Screen off duration of the phone in the night over the previous two weeks, calculated in hours",
    "magnitude_max": "Maximum magnitude of the phone in the previous two weeks, calculated in g",
    "magnitude_afternoon": "Maximum magnitude of the phone in the afternoon over the previous two weeks, calculated in g",
    "screen_use_duration_afternoon": "Screen use duration in the afternoon over the previous two weeks, calculated in hours",
}
CURRENT_DESCRIPTIONS = {
    "battery_afternoon": "Average battery levels in the afternoon over the current two weeks, reported as a percentage",
    "screen_off_night_duration": "Screen off duration of the phone in the night over the current two weeks, calculated in hours",
    "magnitude_max": "Maximum magnitude of the phone in the current two weeks, calculated in g",
    "magnitude_afternoon": "Maximum magnitude of the phone in the afternoon over the current two weeks, calculated in g",
    "screen_use_duration_afternoon": "Screen use duration in the afternoon over the current two weeks, calculated in hours",
}
HISTORY_REPLACE = ("over the current two weeks", "over the previous weeks")
PRE_DATA_START = "Mobile phone data over the previous two weeks: "
CUR_DATA_START = "Mobile phone data over the current two weeks: "
PRE_STATE = "This person was {state} over the previous two weeks."
CUR_STATE_PREDICTION = "Determine how the mental health state changes and only output the label:"
HISTORY_START = "Within the previous weeks, the average mobile phone usage: "
PHQ_EXPLAIN = ("PHQ-9 is an established diagnostic instrument designed to screen for the presence "
               "and measure the severity of depressive symptoms in individuals. Respondents of the "
               "PHQ-9 are asked to reflect on their experiences over the past two weeks, rating the "
               "frequency of symptoms such as sleep disturbance, loss of interest, energy levels, and mood changes.")
USER_CONTEXT = "The following data comes from a {age}-year-old {gender}. "
INITIAL_STATE = " This person was {initial} when they first entered the experiment. "
SYSTEM_PROMPT = """You are an intelligent healthcare agent skilled in predicting changes in mental health conditions.
TASK: Your task is to determine how the user's mental health state changes based on digital data of mobile sensor readings from an individual.
INPUT: The input contains the following contents: data about mobile phone usage over the previous two-week; whether being depressed or not over the previous two-week; data about mobile phone usage over the current two-week.
OUTPUT: To determine how the user's mental health state changes, you should only respond with "Label: Remains" or "Label: More Depressed" or "Label: Less Depressed". Make sure to only return the label and nothing more.
"""
INSTRUCTION_TURN = "Instructions: {system}\n\nPlease follow these instructions."
ACK_TURN = "I understand."
LABEL_TURN = "Label: {label}\n"
# Explicit fallback chat template: user and assistant turns, system as a model turn with <bos>.
TURN_SYSTEM = "<bos><start_of_turn>model\n{content}<end_of_turn>\n"
TURN_USER = "<start_of_turn>user\n{content}<end_of_turn>\n"
TURN_ASSISTANT = "<start_of_turn>model\n{content}<end_of_turn>\n"
OPEN_MODEL_TURN = "<start_of_turn>model\n"
# Prompt style -> prompt column. Legacy styles name columns the generator no longer writes.
STYLE_COLUMNS = {
    "original": "data",
    "with_init": "data_with_init",
    "with_history": "data_with_history",
    "with_init_history": "data_with_init_his",
    "Basic": "Basic",
    "Health_Information": "Health_Informtion",
    "Health_Informtion": "Health_Informtion",
    "Statistics": "Statistics",
    "All": "All",
}
# Answer parsing: tested in this order; no match falls back to Remains.
ANSWER_PATTERNS = (("Label: Remains", S.LABEL_REMAINS), ("Label: More Depressed", S.LABEL_MORE),
                   ("Label: Less Depressed", S.LABEL_LESS))
# ---- end of fixed values ----


def history_description(metric: str) -> str:
    return CURRENT_DESCRIPTIONS[metric].replace(*HISTORY_REPLACE)


def _lit(s: str) -> Column:
    return F.lit(s)


def render_number(x: Column, kind: str = "double") -> Column:
    """One value as text: missing -> 'NaN', infinity -> 'Inf', ints without a decimal part."""
    if kind == "int":
        return F.coalesce(x.cast("int").cast("string"), _lit("NaN"))
    d = x.cast("double")
    return (F.when(d.isNull() | F.isnan(d), _lit("NaN"))
            .when(F.abs(d) == F.lit(float("inf")), _lit("Inf"))
            .otherwise(d.cast("string")))


def render_number_sql(x: str, kind: str = "double") -> str:
    if kind == "int":
        return f"coalesce(CAST(CAST({x} AS INT) AS STRING), 'NaN')"
    d = f"CAST({x} AS DOUBLE)"
    return (f"CASE WHEN {d} IS NULL OR isnan({d}) THEN 'NaN' WHEN abs({d}) = CAST('Infinity' AS DOUBLE) "
            f"THEN 'Inf' ELSE CAST({d} AS STRING) END")


def render_sequence(arr: Column | str, kind: str = "double") -> Column:
    """K1 helper: ``v1, v2, ..., vn``."""
    if isinstance(arr, str):
        return F.expr(f"array_join(transform({S.q(arr)}, x -> {render_number_sql('x', kind)}), ', ')")
    return F.array_join(F.transform(arr, lambda x: render_number(x, kind)), ", ")


def statistics_text(features: list[str], kinds: dict[str, str], prefix: str = "",
                    descriptions: dict[str, str] = CURRENT_DESCRIPTIONS) -> Column:
    """K1: ``<description>: v1, ..., vn. `` for each metric in record order."""
    parts = []
    for f in features:
        parts += [_lit(descriptions[f] + ": "), render_sequence(f"{prefix}{f}", kinds.get(f, "double")), _lit(". ")]
    return F.concat(*parts) if parts else _lit("")


def history_text(features: list[str]) -> Column:
    """K2: ``<history description>: <mean or NaN>. `` for each metric."""
    parts = []
    for f in features:
        parts += [_lit(history_description(f) + ": "),
                  F.coalesce(F.col(f"hist_{f}").cast("string"), _lit("NaN")), _lit(". ")]
    return F.concat(*parts) if parts else _lit("")


def prompt_variants(pre_stats: Column, cur_stats: Column, pre_state: Column, hist: Column,
                    context: Column, initial: Column) -> dict[str, Column]:
    """K3: the four prompt texts, concatenated without separators between sentences."""
    pre_sentence = F.concat(_lit("This person was "), pre_state, _lit(" over the previous two weeks."))
    basic = F.concat(_lit(PRE_DATA_START), pre_stats, pre_sentence, _lit(CUR_DATA_START), cur_stats,
                     _lit(CUR_STATE_PREDICTION))
    return {
        "Basic": basic,
        "Health_Informtion": F.concat(_lit(PHQ_EXPLAIN), basic),
        "Statistics": F.concat(_lit(HISTORY_START), hist, basic),
        "All": F.concat(_lit(PHQ_EXPLAIN), context, initial, _lit(HISTORY_START), hist, basic),
    }


def user_context(age: Column | str, gender: Column | str) -> Column:
    return F.concat(_lit("The following data comes from a "), S.col(age).cast("string"), _lit("-year-old "),
                    S.gender_text(gender), _lit(". "))


def initial_state(group: Column | str) -> Column:
    return F.concat(_lit(" This person was "), S.initial_state_text(group),
                    _lit(" when they first entered the experiment. "))


def prompt_table(pairs_with_history: DataFrame, features: list[str], kinds: dict[str, str]) -> DataFrame:
    """K4: one prompt row per labelled pair (needs prev_*, hist_*, survey columns)."""
    cur = statistics_text(features, kinds)
    pre = statistics_text(features, kinds, prefix="prev_", descriptions=PREVIOUS_DESCRIPTIONS)
    variants = prompt_variants(pre, cur, F.col("previous_state"), history_text(features),
                               user_context("age", "gender"), initial_state("group"))
    return pairs_with_history.select(
        "user", "date", F.col("phq9").alias("current_phq"), F.col("prev_phq9").alias("previous_phq"),
        "previous_state", "current_state", "label",
        *[c.alias(name) for name, c in variants.items()])


def style_column(style: str) -> str:
    """Prompt style -> source column; unknown styles raise."""
    try:
        return STYLE_COLUMNS[style]
    except KeyError:
        raise ValueError(f"unknown prompt style {style!r}; expected one of {sorted(STYLE_COLUMNS)}") from None


def select_style(prompts: DataFrame, style: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """P12 + P13: project to (data, previous_state, label) plus any key columns."""
    return prompts.select(*keep, F.col(style_column(style)).alias("data"), "previous_state", "label")


def _message(role: str, content: Column) -> Column:
    return F.struct(_lit(role).alias("role"), content.alias("content"))


def chat_messages(data: Column, label: Column, examples: Column | None, with_answer: bool) -> Column:
    """K5 / K6: instruction turn, acknowledgement, (example, label) turns, own text, own label.

    ``examples`` is an ``array<struct<data, label>>`` (ordered) or None for zero-shot.
    """
    head = F.array(_message("user", _lit(INSTRUCTION_TURN.format(system=SYSTEM_PROMPT))),
                   _message("assistant", _lit(ACK_TURN)))
    parts = [head]
    if examples is not None:
        ex_turns = F.flatten(F.transform(examples, lambda e: F.array(
            _message("user", e["data"]),
            _message("assistant", F.concat(_lit("Label: "), e["label"], _lit("\n"))))))
        parts.append(F.coalesce(ex_turns, F.array().cast(
            "array<struct<role:string,content:string>>")))
    tail = [_message("user", data)]
    if with_answer:
        tail.append(_message("assistant", F.concat(_lit("Label: "), label, _lit("\n"))))
    parts.append(F.array(*tail))
    return F.concat(*parts)


def render_chat(messages: Column | str) -> Column:
    """K7: the explicit fallback template, ending with an open model turn."""
    def turn(m):
        role, content = m["role"], m["content"]
        return (F.when(role == "system", F.concat(_lit("<bos><start_of_turn>model\n"), content, _lit("<end_of_turn>\n")))
                .when(role == "user", F.concat(_lit("<start_of_turn>user\n"), content, _lit("<end_of_turn>\n")))
                .when(role == "assistant", F.concat(_lit("<start_of_turn>model\n"), content, _lit("<end_of_turn>\n")))
                .otherwise(_lit("")))
    return F.concat(F.array_join(F.transform(S.col(messages), turn), ""), _lit(OPEN_MODEL_TURN))


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def parse_answer(generated: Column | str, prompt: Column | str) -> tuple[Column, Column]:
    """K8: drop the prompt prefix by length, strip, then containment tests in fixed order.
    Returns (label, parsed); unparseable answers are Remains with parsed = false."""
    out = strip_ws(F.expr("substring({g}, {p} + 1)".format(
        g=_ref(generated), p=f"length({_ref(prompt)})")))
    label = _lit(S.LABEL_REMAINS)
    parsed = F.lit(False)
    for pattern, name in reversed(ANSWER_PATTERNS):
        label = F.when(F.instr(out, pattern) > 0, _lit(name)).otherwise(label)
        parsed = parsed | (F.instr(out, pattern) > 0)
    return label, parsed


def _ref(c: Column | str) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("parse_answer takes column names")
