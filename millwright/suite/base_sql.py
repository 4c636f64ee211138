"""DuckDB text of the fixture views (FIXTURES.md part B), shared by every oracle query."""

from __future__ import annotations

from ..plans.scoring import CHOSEN_MODEL, ENSEMBLE_ORDER, LINEAR_MODELS, linear_logit_sql

SENSORS = """SELECT event_id, user_id AS machine_id, ts,
       295.0e0 + CAST(json_extract_string(props,'$.k') AS INT)/10.0e0 AS air_temp,
       305.0e0 + ((event_id*7+user_id)%100)/10.0e0 AS process_temp,
       1200.0e0 + (event_id*31+user_id*17)%1600 AS rotational_speed,
       LEAST(value, 80.0e0) AS torque,
       CAST(event_id%250 AS DOUBLE) AS tool_wear,
       CASE user_id%3 WHEN 0 THEN 'L' WHEN 1 THEN 'M' ELSE 'H' END AS type,
       CASE WHEN event_type='error' AND value>50 AND event_id%250>=125 THEN 1 ELSE 0 END AS machine_failure
FROM events"""

FLAGS = """SELECT *,
       CASE WHEN machine_failure=1 AND event_id%5=0 THEN 1 ELSE 0 END AS TWF,
       CASE WHEN machine_failure=1 AND event_id%5=1 THEN 1 ELSE 0 END AS HDF,
       CASE WHEN machine_failure=1 AND event_id%5=2 THEN 1 ELSE 0 END AS PWF,
       CASE WHEN machine_failure=1 AND event_id%5=3 THEN 1 ELSE 0 END AS OSF,
       CASE WHEN machine_failure=1 AND event_id%5=4 THEN 1 ELSE 0 END AS RNF
FROM sensors"""


def _band(p: str) -> str:
    return (f"CASE WHEN {p} >= 0.8e0 THEN 'CRITICAL' WHEN {p} >= 0.5e0 THEN 'HIGH' "
            f"WHEN {p} >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END")


def _predictions() -> str:
    chosen = linear_logit_sql(LINEAR_MODELS[CHOSEN_MODEL])
    votes = ",\n       ".join(
        f"CASE WHEN {linear_logit_sql(LINEAR_MODELS[m])} >= 0 THEN 1 ELSE 0 END AS vote_{m}" for m in ENSEMBLE_ORDER)
    first = f"vote_{ENSEMBLE_ORDER[0]}"
    same = " + ".join(["1"] + [f"CASE WHEN vote_{m} = {first} THEN 1 ELSE 0 END" for m in ENSEMBLE_ORDER[1:]])
    return f"""SELECT *, {_band('failure_probability')} AS risk_level,
       ROUND(({same}) / {float(len(ENSEMBLE_ORDER))}e0, 2) AS ensemble_agreement,
       '{CHOSEN_MODEL}' AS model_name
FROM (SELECT *, CASE WHEN {chosen} >= 0 THEN 1 ELSE 0 END AS prediction,
             ROUND(1.0e0/(1.0e0+EXP(-({chosen}))), 6) AS failure_probability,
             ROUND(1.0e0 - ROUND(1.0e0/(1.0e0+EXP(-({chosen}))), 6), 6) AS normal_probability,
       {votes}
      FROM sensors) scored"""


PREDICTIONS = _predictions()

MACHINE_FAILURES = """SELECT event_id AS id, ts AS "timestamp", machine_id, prediction, failure_probability,
       normal_probability, risk_level, air_temp, process_temp, rotational_speed, torque, tool_wear,
       model_name, ensemble_agreement, 0 AS resolved, CAST(NULL AS TIMESTAMP) AS resolved_timestamp,
       CAST(NULL AS VARCHAR) AS resolved_by, CAST(NULL AS VARCHAR) AS notes
FROM predictions"""

RESOLUTIONS = """SELECT machine_id, max(ts) AS resolved_timestamp, 'team' AS resolved_by,
       'resolved in fixture' AS notes
FROM sensors WHERE machine_id % 3 = 0 GROUP BY machine_id"""

REGISTRY = """SELECT machine_id, min(ts) AS created_timestamp, max(ts) AS last_seen, 'OPERATIONAL' AS status,
       printf('Floor %d, Section %d', CAST(floor((machine_id-1)/10) AS BIGINT) + 1, ((machine_id-1)%10 + 10)%10 + 1) AS location,
       CASE machine_id % 3 WHEN 0 THEN 'Industrial Robot Arm' WHEN 1 THEN 'CNC Machine'
            ELSE 'Hydraulic Press' END AS type
FROM sensors GROUP BY machine_id"""

VIEWS = {
    "sensors": SENSORS,
    "flagged": FLAGS,
    "predictions": PREDICTIONS,
    "machine_failures": MACHINE_FAILURES,
    "resolutions": RESOLUTIONS,
    "registry": REGISTRY,
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies included, in order)."""
    deps = {"flagged": ["sensors"], "predictions": ["sensors"], "machine_failures": ["sensors", "predictions"],
            "resolutions": ["sensors"], "registry": ["sensors"]}
    wanted: list[str] = []
    for n in names:
        for d in deps.get(n, []) + [n]:
            if d not in wanted:
                wanted.append(d)
    order = [v for v in VIEWS if v in wanted]
    ctes = ",\n".join(f"{v} AS (\n{VIEWS[v]}\n)" for v in order)
    body = body.strip()
    return f"WITH {ctes}\n{body}"
