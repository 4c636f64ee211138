"""Scalar business rules as Catalyst column expressions (no Python UDFs).

Every function returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen wherever it is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's outputs (bands, labels, texts).
# ---------------------------------------------------------------------------
RISK_BANDS = [(0.8, "CRITICAL"), (0.5, "HIGH"), (0.3, "MEDIUM")]  # else LOW
RISK_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
LEVEL_COLOURS = {"CRITICAL": "danger", "HIGH": "warning", "MEDIUM": "warning", "LOW": "info"}
HEALTH_BANDS = [
    (85, "EXCELLENT", "success"),
    (70, "GOOD", "info"),
    (50, "FAIR", "warning"),
    (30, "POOR", "warning"),
]  # else CRITICAL / danger
ACTIONS = {
    "CRITICAL": "IMMEDIATE maintenance required. Stop machine if necessary.",
    "HIGH": "Schedule maintenance within 24-48 hours.",
    "MEDIUM": "Monitor closely. Schedule maintenance within 1 week.",
    "LOW": "Continue normal monitoring.",
}
DEFAULT_ACTION = "Monitor machine"
PARTS_TIERS = [
    (0.7, ["Main Bearing Assembly", "Cooling Fan", "Oil Filter"]),
    (0.5, ["Drive Belt", "Seals", "Lubricant"]),
    (0.3, ["Air Filter", "Inspection Kit"]),
]
DEFAULT_PARTS = ["General Inspection Kit"]
# urgency: (name, days until maintenance, priority, hours, maintenance type)
URGENCY = {
    "IMMEDIATE": (0, 1, 4, "Emergency Repair"),
    "URGENT": (2, 2, 3, "Urgent Servicing"),
    "SOON": (7, 3, 2, "Preventive Maintenance"),
    "ROUTINE": (14, 4, 1, "Routine Inspection"),
}
# gauge ranges: sensor -> (low, span)
GAUGES = {
    "air_temp": (295.0, 10.0),
    "process_temp": (305.0, 10.0),
    "rotational_speed": (0.0, 3000.0),
    "torque": (0.0, 80.0),
    "tool_wear": (0.0, 250.0),
}
MACHINE_TYPES = {0: "Industrial Robot Arm", 1: "CNC Machine", 2: "Hydraulic Press"}
SENSORS = ["air_temp", "process_temp", "rotational_speed", "torque", "tool_wear"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_band(p) -> Column:
    """CRITICAL / HIGH / MEDIUM / LOW from a failure probability."""
    p = _c(p)
    expr = F.when(p >= F.lit(RISK_BANDS[0][0]), RISK_BANDS[0][1])
    for lo, name in RISK_BANDS[1:]:
        expr = expr.when(p >= F.lit(lo), name)
    return expr.otherwise("LOW")


def level_colour(level) -> Column:
    """display colour of a risk level."""
    level = _c(level)
    expr = None
    for name, colour in LEVEL_COLOURS.items():
        expr = F.when(level == name, colour) if expr is None else expr.when(level == name, colour)
    return expr.otherwise("info")


def health_status(score) -> Column:
    """F2: status band of a 0-100 health score."""
    score = _c(score)
    expr = F.when(score >= HEALTH_BANDS[0][0], HEALTH_BANDS[0][1])
    for lo, name, _ in HEALTH_BANDS[1:]:
        expr = expr.when(score >= lo, name)
    return expr.otherwise("CRITICAL")


def health_colour(score) -> Column:
    score = _c(score)
    expr = F.when(score >= HEALTH_BANDS[0][0], HEALTH_BANDS[0][2])
    for lo, _, colour in HEALTH_BANDS[1:]:
        expr = expr.when(score >= lo, colour)
    return expr.otherwise("danger")


def action_for_level(level) -> Column:
    """recommended action text, default for unknown levels."""
    pairs = []
    for k, v in ACTIONS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[_c(level)], F.lit(DEFAULT_ACTION))


def parts_list(max_risk) -> Column:
    """array of parts; tiers accumulate, empty -> general kit."""
    r = _c(max_risk)
    tiers = [F.when(r >= F.lit(lo), F.array(*[F.lit(p) for p in parts])).otherwise(F.array().cast("array<string>"))
             for lo, parts in PARTS_TIERS]
    joined = F.concat(*tiers)
    return F.when(F.size(joined) > 0, joined).otherwise(F.array(*[F.lit(p) for p in DEFAULT_PARTS]))


def urgency(max_risk, avg_risk) -> Column:
    """A3 urgency class from max and mean probability."""
    mx, av = _c(max_risk), _c(avg_risk)
    return (F.when(mx >= 0.8, "IMMEDIATE").when(mx >= 0.6, "URGENT")
            .when(av >= 0.4, "SOON").otherwise("ROUTINE"))


def urgency_attr(urg, index: int) -> Column:
    """Look up one attribute of the urgency table (0 days, 1 priority, 2 hours, 3 type)."""
    pairs = []
    for k, v in URGENCY.items():
        pairs += [F.lit(k), F.lit(v[index])]
    return F.create_map(*pairs)[_c(urg)]


def ensemble_agreement(votes: Sequence) -> Column:
    """share of votes equal to the first-listed model's vote, rounded to 2."""
    if not votes:
        return F.lit(None).cast("double")
    cols = [_c(v) for v in votes]
    same = sum((F.when(v == cols[0], 1).otherwise(0) for v in cols[1:]), F.lit(1))
    return F.round(same / F.lit(float(len(cols))), 2)


def agreement_label(a) -> Column:
    """F8: Strong above .8, Good above .6, else Weak."""
    a = _c(a)
    return F.when(a > 0.8, "Strong").when(a > 0.6, "Good").otherwise("Weak")


def sensor_gauge(value, sensor: str) -> Column:
    """percent of a display range, capped at 100."""
    lo, span = GAUGES[sensor]
    return F.least((_c(value) - F.lit(lo)) / F.lit(span) * F.lit(100.0), F.lit(100.0))


def fleet_location(index) -> Column:
    """'Floor f, Section s' from a 1-based machine index."""
    i = _c(index).cast("long")
    return F.format_string("Floor %d, Section %d", F.floor((i - 1) / 10) + 1, F.pmod(i - 1, F.lit(10)) + 1)


def fleet_type(index) -> Column:
    i = F.pmod(_c(index).cast("long"), F.lit(3))
    return F.when(i == 0, MACHINE_TYPES[0]).when(i == 1, MACHINE_TYPES[1]).otherwise(MACHINE_TYPES[2])


def anomaly_status(pct) -> Column:
    """A18 row status: Critical above 5 %, Warning above 2 %, else Normal."""
    pct = _c(pct)
    return F.when(pct > 5, "Critical").when(pct > 2, "Warning").otherwise("Normal")


def round_half_up(x, digits: int) -> Column:
    """floor(x·10^d + 0.5) / 10^d.

    Spark's ``round`` rounds the shortest decimal text of a double half-up
    (0.01045 -> 0.0105) while Python and DuckDB round the exact binary value
    (-> 0.0104).  This form is evaluated the same way in IEEE arithmetic by
    every engine and matches Python on such values.
    """
    scale = float(10 ** digits)
    return F.floor(_c(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
