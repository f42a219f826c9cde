"""DuckDB text of the adapter tables, and small SQL text helpers for oracles."""

from __future__ import annotations

from quarte.functions.geometry import ANGLES, JOINTS, RATIOS, TORSO


def _coord(k: int, axis: int) -> str:
    left, right = 2 * k + 1 + axis, 2 * k + 31 + axis
    raw = f"(CASE WHEN side = 'left' THEN e[{left}] ELSE e[{right}] END)::DOUBLE"
    return f"CASE WHEN (vec_id * 17 + {k}) % 11 = 0 THEN NULL ELSE round({raw} * 2 + 1.5, 6) END AS {'xy'[axis]}{k}"


_T = "format('{:7.3f}s | ', t)"
COORDS = [f"{a}{k}" for k in JOINTS for a in "xy"]

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "posef": (
        (),
        "SELECT phrase_id, (row_number() OVER (PARTITION BY phrase_id ORDER BY vec_id) - 1)::INT AS frame, "
        "vec_id, embedding AS e FROM (SELECT *, (vec_id // 500) * 10 + label AS phrase_id FROM embeddings)",
    ),
    "poses": (
        ("posef",),
        "SELECT phrase_id, side, frame, "
        + ", ".join(_coord(k, a) for k in JOINTS for a in (0, 1))
        + " FROM posef, (VALUES ('left'), ('right')) s(side)",
    ),
    "joints": (
        ("poses",),
        " UNION ALL ".join(f"SELECT phrase_id, side, frame, {k} AS kp, x{k} AS x, y{k} AS y FROM poses" for k in JOINTS),
    ),
    "pixels": (
        ("poses",),
        "SELECT phrase_id, side, frame, " + ", ".join(f"{c} * 400.0::DOUBLE AS {c}" for c in COORDS) + " FROM poses",
    ),
    "detections": (
        ("pixels",),
        "SELECT phrase_id, (frame // 3)::INT AS frame, (frame % 3)::INT AS det_idx, "
        + ", ".join(f"coalesce({c}, 0.0::DOUBLE) AS {c}" for c in COORDS)
        + " FROM pixels WHERE side = 'left'",
    ),
    "info": (
        (),
        "SELECT p AS phrase_id, n, (n * 4 // 5 - p % 3)::INT AS left_hit, (n * 4 // 5 - p % 4)::INT AS right_hit, "
        "n * 3 // 10 AS contact_1, CASE WHEN p % 4 <> 3 THEN n * 4 // 5 - 6 - p % 3 END::INT AS contact_2, "
        "CASE WHEN p % 5 = 0 THEN n * 4 // 5 - 7 END AS lockout "
        "FROM (SELECT (vec_id // 500) * 10 + label AS p, count(*)::INT AS n FROM embeddings GROUP BY ALL)",
    ),
    "hits": (
        ("info",),
        "SELECT phrase_id, 'left' AS side, left_hit AS hit_frame FROM info UNION ALL "
        "SELECT phrase_id, 'right', right_hit FROM info",
    ),
    "contacts": (
        ("info",),
        "SELECT *, frame / 30.0::DOUBLE AS time_s FROM (SELECT phrase_id, 1 AS line_no, contact_1 AS frame FROM info UNION ALL "
        "SELECT phrase_id, 2, contact_2 FROM info WHERE contact_2 IS NOT NULL)",
    ),
    "signals": (
        (),
        "SELECT user_id * 1000 + dayofyear(ts) AS match_id, user_id, event_id AS idx, (epoch_us(ts) // 1000) AS signal_ts, "
        "CASE event_type WHEN 'click' THEN 3 WHEN 'purchase' THEN 8 WHEN 'signup' THEN 9 WHEN 'error' THEN 5 END::BIGINT AS fight, "
        "CASE WHEN event_type = 'view' THEN 'light' ELSE 'hit' END AS source, value, props FROM events",
    ),
    "frames": (
        (),
        "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame, "
        "(epoch_us(ts) // 1000) AS ts FROM events WHERE event_type = 'view'",
    ),
    "plog": (
        (),
        "SELECT phrase_id, line_no, ms, t, CASE "
        "WHEN i % 13 = 0 THEN 'Tracking indices -> fencer 1: ' || (i % 4) || ', fencer 2: ' || (i % 3) "
        f"WHEN k = 'click' THEN {_T} || 'Off-Target: Blade-to-blade contact.' || "
        "CASE i % 4 WHEN 0 THEN ' [left beat]' WHEN 1 THEN ' [Right_Defend]' WHEN 2 THEN ' [accident]' ELSE '' END "
        f"WHEN k = 'purchase' AND i % 7 = 0 THEN {_T} || 'HIT: Simultaneous valid hits!' "
        f"WHEN k = 'purchase' THEN {_T} || 'HIT: Left scores on Right!' "
        f"WHEN k = 'signup' AND i % 11 = 0 THEN {_T} || 'Phrase recording ended' "
        f"WHEN k = 'signup' THEN {_T} || 'HIT: Right scores on Left!' "
        f"WHEN k = 'error' THEN {_T} || 'Lockout period started (0.200s window)' "
        "WHEN i % 5 = 0 THEN 'Scores -> Fencer 1: HIT, Fencer 2: HIT' "
        "WHEN i % 5 = 1 THEN 'Scores -> Fencer 1: HIT, Fencer 2: MISS' "
        "WHEN i % 5 = 2 THEN 'Confirmed result winner: Right Fencer (Green Lamp)' "
        "WHEN i % 5 = 3 THEN 'Manual selection winner: Left' "
        f"ELSE {_T} || 'Phrase recording started' END AS line "
        "FROM (SELECT user_id AS phrase_id, event_id AS i, event_type AS k, "
        "(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS line_no, epoch_us(ts) // 1000 AS ms, "
        "((epoch_us(ts) // 1000) - min((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id)) / 1000.0::DOUBLE AS t FROM events)",
    ),
    "series": (
        (),
        "SELECT l_suppkey AS series_id, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1)::INT AS frame, "
        "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity / 50.0::DOUBLE END AS x, l_discount * 10 AS y FROM lineitem",
    ),
    "predictions": (
        (),
        "SELECT doc_id AS item_id, toxic::BIGINT AS predicted, quality::BIGINT AS label, "
        "CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM labels",
    ),
    "runs": (
        (),
        "SELECT l_returnflag || l_linestatus AS model, l_orderkey AS phrase, l_quantity AS frames, "
        "l_extendedprice / 1000.0::DOUBLE AS seconds, l_linenumber::BIGINT AS n FROM lineitem",
    ),
    "artifacts": (
        (),
        "SELECT doc_id // 4 AS phrase_id, 'p' || (doc_id // 4) || CASE doc_id % 4 WHEN 0 THEN '.avi' "
        "WHEN 1 THEN '_corrected.mp4' WHEN 2 THEN '_overlay.mp4' ELSE '.json' END AS name, n_chars AS length "
        "FROM documents WHERE doc_id % 7 <> 0",
    ),
}


def sql(body: str, *views: str, **more: str) -> str:
    """``body`` with the named views (and what they need) in front. Further
    CTEs come as keyword arguments, in order."""
    needed: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in needed:
            needed.append(name)

    for name in views:
        add(name)
    kept = ("poses", "joints")  # read many times over
    parts = [f"{n} AS {'MATERIALIZED ' * (n in kept)}({VIEWS[n][1]})" for n in needed]
    parts += [f"{n} AS ({text})" for n, text in more.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def rnd(e: str, digits: int = 4) -> str:
    return f"round(({e})::DOUBLE, {digits}) + 0.0::DOUBLE"


def ok(k: int, p: str = "") -> str:
    return f"coalesce({p}x{k} > 0 AND {p}y{k} > 0, false)"


def dist(a: int, b: int, p: str = "", q: str | None = None) -> str:
    q = p if q is None else q
    return (
        f"sqrt(({p}x{a} - {q}x{b}) * ({p}x{a} - {q}x{b}) + ({p}y{a} - {q}y{b}) * ({p}y{a} - {q}y{b}))"
    )


def seg(a: int, b: int, p: str = "") -> str:
    return f"CASE WHEN {ok(a, p)} AND {ok(b, p)} AND {dist(a, b, p)} > 1e-9 THEN {dist(a, b, p)} END"


def angle(a: int, b: int, c: int, p: str = "") -> str:
    """Angle at b in radians, NULL when a limb has no length."""
    dot = f"(({p}x{a} - {p}x{b}) * ({p}x{c} - {p}x{b}) + ({p}y{a} - {p}y{b}) * ({p}y{c} - {p}y{b}))"
    norm = f"nullif({dist(a, b, p)} * {dist(c, b, p)}, 0)"
    cos = f"({dot} / {norm})"
    # greatest and least skip NULL, the product keeps it.
    return f"acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {cos})) + 0 * {cos})"


def joint_angle(a: int, b: int, c: int, p: str = "") -> str:
    return f"CASE WHEN {ok(a, p)} AND {ok(b, p)} AND {ok(c, p)} THEN {angle(a, b, c, p)} END"


def descriptor(p: str = "") -> str:
    """Columns a0..a9 and r0..r9."""
    angles = [f"{joint_angle(*j, p=p)} AS {p.replace('.', '_')}a{i}" for i, j in enumerate(ANGLES.values())]
    ratios = [
        f"({seg(a, b, p)}) / ({seg(c, d, p)}) AS {p.replace('.', '_')}r{i}"
        for i, (a, b, c, d) in enumerate(RATIOS.values())
    ]
    return ", ".join(angles + ratios)


def descriptor_gap(p: str, q: str) -> str:
    """Mean gap over shared features of two descriptor column sets."""
    gaps = [
        f"least(abs({p}a{i} - {q}a{i}), 2 * pi() - abs({p}a{i} - {q}a{i})) / pi()" for i in range(10)
    ] + [f"abs(ln({p}r{i} / {q}r{i}))" for i in range(10)]
    # least() skips NULL, so guard each angle gap.
    gaps = [
        f"CASE WHEN {p}{'ar'[i // 10]}{i % 10} IS NOT NULL AND {q}{'ar'[i // 10]}{i % 10} IS NOT NULL THEN {g} END"
        for i, g in enumerate(gaps)
    ]
    listed = f"list_filter([{', '.join(gaps)}], lambda v: v IS NOT NULL)"
    return f"CASE WHEN len({listed}) >= 6 THEN list_sum({listed}) / len({listed}) END"


def joint_list(axis: str, p: str = "", joints=JOINTS, need: str = "valid") -> str:
    """List of present values of one axis."""
    cond = {"valid": lambda k: ok(k, p), "both": lambda k: f"({p}x{k} IS NOT NULL AND {p}y{k} IS NOT NULL)",
            "axis": lambda k: f"{p}{axis}{k} IS NOT NULL"}[need]
    items = ", ".join(f"CASE WHEN {cond(k)} THEN {p}{axis}{k} END" for k in joints)
    return f"list_filter([{items}], lambda v: v IS NOT NULL)"


def mean(lst: str) -> str:
    return f"(list_sum({lst}) / nullif(len({lst}), 0))"


def torso(axis: str, p: str = "", need: str = "both") -> str:
    return mean(joint_list(axis, p, TORSO, need))


def kp_gap(p: str, q: str, joints=JOINTS) -> str:
    items = ", ".join(f"CASE WHEN {ok(k, p)} AND {ok(k, q)} THEN {dist(k, k, p, q)} END" for k in joints)
    return mean(f"list_filter([{items}], lambda v: v IS NOT NULL)")


def box(p: str = "", out: str = "") -> str:
    """Columns <out>bx1, by1, bx2, by2 of the truncated box."""
    xs, ys = joint_list("x", p), joint_list("y", p)
    return ", ".join(
        f"CASE WHEN len({xs}) >= 2 THEN trunc(list_{f}({v}))::BIGINT END AS {out}b{n}"
        for n, f, v in (("x1", "min", xs), ("y1", "min", ys), ("x2", "max", xs), ("y2", "max", ys))
    )


def iou(a: str, b: str) -> str:
    """IoU of boxes with prefixes a and b (columns bx1..by2)."""
    w = f"greatest(0.0::DOUBLE, least({a}bx2, {b}bx2) - greatest({a}bx1, {b}bx1))"
    h = f"greatest(0.0::DOUBLE, least({a}by2, {b}by2) - greatest({a}by1, {b}by1))"
    area = lambda p: f"({p}bx2 - {p}bx1) * ({p}by2 - {p}by1)"
    union = f"({area(a)} + {area(b)} - {w} * {h})"
    return (
        f"CASE WHEN {a}bx1 IS NULL OR {b}bx1 IS NULL OR {union} <= 0 THEN 0.0::DOUBLE ELSE {w} * {h} / {union} END"
    )
