"""Codes, labels and lookups of the match side as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contact tags.
NON_ACCIDENT_TAGS = ("left beat", "left defend", "right beat", "right defend")
LEFT_TAGS, RIGHT_TAGS = ("left beat", "left defend"), ("right beat", "right defend")
# Weapon names.
WEAPONS = {1: ("foil", "floret", "花剑"), 2: ("epee", "épée", "重剑"), 3: ("sabre", "saber", "佩剑")}
# Which side of the box is which fencer.
SIDE_MAP = {"A": "left", "B": "right"}
# Sentences by reason.
SIDE_WORDS = {"left": "左方", "right": "右方"}
SIDE_REASONS = {
    "single_light": "{side}得分。单灯有效。",
    "opponent_pause": "{side}得分。对方停顿，{side}保有进攻权。",
    "opponent_retreat": "{side}得分。对方后退，{side}保有进攻权。",
    "opponent_late_lunge": "{side}得分。对方进攻过晚，失去优先权。",
    "opponent_arm_reset": "{side}得分。对方手臂动作中断，失去优先权。",
    "blade_favored": "{side}得分。剑身动作取得优先权。",
    "blade_override": "{side}得分。剑身动作改变了优先权。",
    "blade_unavailable_fallback": "{side}得分。剑身分析不可用，按优先权时间线判定。",
    "arm_first": "{side}得分。双方同时进攻，{side}先伸臂。",
    "lunge_first": "{side}得分。双方同时进攻，{side}先完成进攻动作。",
    "attack_first": "{side}得分。双方同时进攻，{side}启动更早。",
    "slow_start": "{side}得分。对方启动较慢。",
    "faster_attack": "{side}得分。{side}进攻更快。",
    "system_tiebreak_right": "右方得分。双方优先权事件同时结束，系统判右方。",
    "analysis_reason_unknown": "{side}得分。系统根据视觉分析判定优先权。",
}
NEUTRAL_REASONS = {
    "no_touch": "无有效触灯。",
    "epee_double_touch": "重剑双灯，双方得分。",
    "unclear_double_touch": "双方触灯，无法判定优先权。",
    "analysis_unavailable": "双方触灯，视觉分析不可用，按双灯处理。",
    "analysis_no_winner": "双方触灯，视觉分析未能给出有效胜方。",
}
# Phrases in a decision text and the reason they stand for,
# before and after the event rules.
TEXT_REASONS_FIRST = {
    "blade contact analysis unavailable": "blade_unavailable_fallback",
    "non-accident blade contact overrode": "blade_override",
    "non-accident blade contact favored": "blade_favored",
}
EVENT_REASONS = {
    "pause": "opponent_pause",
    "retreat": "opponent_retreat",
    "harmful_lunge": "opponent_late_lunge",
    "harmful_arm_extension": "opponent_arm_reset",
}
TEXT_REASONS_LAST = {
    "near-hit arm extension": "arm_first",
    "beneficial lunge": "lunge_first",
    "weighted signal start is earlier": "attack_first",
    "slow-start penalty": "slow_start",
    "faster": "faster_attack",
}


def lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])


def norm_tag(tag: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(tag, "_", " ")), r"\s+", " "))


def is_accident(tag: Column) -> Column:
    t = norm_tag(tag)
    return F.when(t == "accident", 1).when(t.isin(*NON_ACCIDENT_TAGS), 0)


def benefit(tag: Column) -> Column:
    t = norm_tag(tag)
    return F.when(t.isin(*LEFT_TAGS), "left").when(t.isin(*RIGHT_TAGS), "right").when(t == "accident", "accident")


def weapon_code(value: Column) -> Column:
    name = F.lower(F.trim(value))
    named = F.lit(None)
    for code, names in WEAPONS.items():
        named = F.when(name.isin(*names), code).otherwise(named)
    return F.coalesce(F.trim(value).try_cast("int"), named)


def light_result(a: Column, b: Column) -> Column:
    """Only A 8, only B 9, both 10, none 0."""
    return F.when(a & ~b, 8).when(b & ~a, 9).when(a & b, 10).otherwise(0)


def side_of_fight(fight: Column, side_map: dict[str, str] = SIDE_MAP) -> Column:
    return F.when(fight == 8, F.lit(side_map.get("A"))).when(fight == 9, F.lit(side_map.get("B")))


def winner_ab(winner: Column, side_map: dict[str, str] = SIDE_MAP) -> Column:
    """A or B from a, b, left or right in any case."""
    w = F.lower(winner)
    out = F.when(w.isin("a", "b"), F.upper(w))
    for ab, visual in side_map.items():
        out = out.when(w == visual, ab)
    return out


def code_of_ab(ab: Column) -> Column:
    return F.when(ab == "A", 8).when(ab == "B", 9).otherwise(0)


def visual_side(winner: Column, side_map: dict[str, str] = SIDE_MAP) -> Column:
    w = F.trim(winner)
    low = F.lower(w)
    return F.coalesce(lookup(side_map)[w], F.when(low.isin("left", "right"), low))


def final_result(a: Column, b: Column, weapon: Column, analysis_ab: Column) -> dict[str, Column]:
    """Winner, result code and source from the final lights and the analyser."""
    epee = F.coalesce(weapon == 2, F.lit(False))
    source = (
        F.when(~a & ~b, "final_lights_no_touch")
        .when(a != b, "final_lights_single_touch")
        .when(epee, "final_lights_double_touch_epee")
        .when(analysis_ab.isin("A", "B"), "local_streaming_analyzer")
        .otherwise("final_lights_double_touch")
    )
    analysed = a & b & ~epee & F.coalesce(analysis_ab.isin("A", "B"), F.lit(False))
    winner = F.when(a & ~b, "A").when(b & ~a, "B").when(analysed, analysis_ab).otherwise("tie")
    code = F.when(~a & ~b, 0).when(winner == "tie", 10).otherwise(code_of_ab(winner))
    return {"winner": winner, "result_code": code, "decision_source": source}


def reason_code(source, reason, has_result, latest_tied, event_side, event_type, visual, has_error) -> Column:
    text = F.lower(F.coalesce(reason, F.lit("")))
    first = F.lit(None).cast("string")
    for phrase, code in reversed(TEXT_REASONS_FIRST.items()):
        first = F.when(text.contains(phrase), code).otherwise(first)
    event = F.when(
        (event_side != visual) & (event_side != ""), lookup(EVENT_REASONS)[F.lower(event_type)]
    )
    last = F.lit("analysis_reason_unknown")
    for phrase, code in reversed(TEXT_REASONS_LAST.items()):
        last = F.when(text.contains(phrase), code).otherwise(last)
    analysed = F.when(
        has_result & visual.isNotNull(),
        F.coalesce(first, F.when(latest_tied, "system_tiebreak_right"), event, last),
    ).otherwise("analysis_no_winner")
    unclear = F.when(has_error, "analysis_unavailable").when(has_result, "analysis_no_winner").otherwise(
        "unclear_double_touch"
    )
    return (
        F.when(source == "final_lights_no_touch", "no_touch")
        .when(source == "final_lights_single_touch", "single_light")
        .when(source == "final_lights_double_touch_epee", "epee_double_touch")
        .when(source == "final_lights_double_touch", unclear)
        .when(source == "local_streaming_analyzer", analysed)
        .when(visual.isNotNull(), "analysis_reason_unknown")
        .otherwise("analysis_unavailable")
    )


def spoken_reason(code: Column, visual: Column) -> Column:
    sided = F.when(
        visual.isin("left", "right"), F.replace(lookup(SIDE_REASONS)[code], F.lit("{side}"), lookup(SIDE_WORDS)[visual])
    )
    return F.coalesce(sided, lookup(NEUTRAL_REASONS)[code], F.lit(""))


def audio_key(code: Column, visual: Column) -> Column:
    sided = visual.isin("left", "right") & lookup(SIDE_REASONS)[code].isNotNull()
    return F.when(sided, F.concat(F.lit("reason_"), code, F.lit("_"), visual)).otherwise(
        F.concat(F.lit("reason_"), code)
    )


def winner_label(side: Column) -> Column:
    return (
        F.when(side == "right", "Right Fencer (Green Lamp)").when(side == "left", "Left Fencer (Red Lamp)").otherwise(side)
    )


def single_hit_message(side: Column) -> Column:
    return (
        F.when(side == "right", "Only one light. Right fencer wins.")
        .when(side == "left", "Only one light. Left fencer wins.")
        .otherwise("Only one light recorded.")
    )


def normalise_winner(value: Column) -> Column:
    w = F.lower(F.trim(value))
    return F.when(w.isin("left", "right"), w)


def lone_hit(right_hit: Column, left_hit: Column) -> Column:
    """The side of a single light, NULL for none or both."""
    return F.when(right_hit & ~left_hit, "right").when(left_hit & ~right_hit, "left")


def scale_frames(frames: Column, fps: Column, minimum: int = 0, base: float = 15.0, least: float = 0.1) -> Column:
    """Frame threshold at ``fps`` from its value at the base rate, rounded half to even."""
    safe = safe_fps(fps, base, least)
    scaled = F.bround(frames * safe / base).cast("long")
    return F.when(frames <= 0, 0).otherwise(F.greatest(F.lit(minimum), scaled))


def safe_fps(fps: Column, base: float = 15.0, least: float = 0.1) -> Column:
    return F.when(fps >= least, fps).otherwise(F.lit(base))


def scale_per_frame(value: Column, fps: Column, base: float = 15.0, least: float = 0.1) -> Column:
    return value * (F.lit(base) / safe_fps(fps, base, least))
