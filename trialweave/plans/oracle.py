"""Common table expressions of the check queries, in plain SQL for another engine.

Each is written from the definition of the operator, not from the way the library
computes it: one window over the whole log for the gaps, one aggregate per session metric.
"""

from __future__ import annotations

K = "GameTitle, Participant, Condition"

PARTS = {
    "log": ((), """
SELECT CASE WHEN day(ts) <= 15 THEN 'Kiwi' ELSE 'HandStrength' END AS GameTitle, user_id AS Participant,
  CASE ((day(ts) - 1) % 15) // 4 WHEN 0 THEN '50A' WHEN 1 THEN '50B' WHEN 2 THEN '100A' ELSE '100B' END AS Condition,
  ts AS Timestamp, event_id,
  CASE event_type WHEN 'purchase' THEN 'GameRunning' WHEN 'view' THEN 'InputWindowChange'
    WHEN 'error' THEN 'InputWindowChange' WHEN 'click' THEN 'MotorImagery' WHEN 'signup' THEN 'GameDecision' END AS Event,
  CASE event_type WHEN 'view' THEN 'Open' WHEN 'error' THEN 'Closed' END AS InputWindow,
  CASE WHEN event_type IN ('view', 'error') THEN TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) END AS InputWindowOrder,
  CASE WHEN event_type = 'signup' THEN CASE WHEN value < 20 THEN 'RejInput' WHEN value < 60 THEN 'AccInput'
    ELSE 'FabInput' END END AS TrialResult,
  concat('mode', user_id % 3) AS BCIProcessingMode
FROM events"""),
    "gaps": (("log",), """
SELECT *, coalesce((epoch_us(Timestamp) - epoch_us(lag(Timestamp) OVER (ORDER BY Timestamp, event_id))) / 1e6, 0.0)
  AS time_delta FROM log"""),
    "numbered": (("gaps",), f"""
SELECT *, CASE
    WHEN Event = 'InputWindowChange' AND InputWindow = 'Closed' THEN
      count(CASE WHEN Event = 'InputWindowChange' AND InputWindow = 'Closed' THEN 1 END) OVER
        (PARTITION BY {K} ORDER BY Timestamp, event_id ROWS UNBOUNDED PRECEDING)
    WHEN Event IN ('GameRunning', 'GameStopped') OR (Event = 'InputWindowChange' AND InputWindow = 'Open') THEN -1 ELSE 0 END
  AS InputWindowClosedID FROM gaps"""),
    "marked": (("numbered",), f"""
SELECT *, max(InputWindowClosedID) OVER (PARTITION BY {K}) AS last_id FROM numbered"""),
    "labelled": (("marked",), f"""
SELECT * EXCLUDE (InputWindowOrder, last_id),
  last_value(NULLIF(InputWindowClosedID, 0) IGNORE NULLS) OVER w AS InputWindowClosedFill,
  last_value(CASE WHEN InputWindow = 'Closed' THEN -1.0 WHEN InputWindow IS NULL THEN NULL
    ELSE InputWindowOrder END IGNORE NULLS) OVER w AS InputWindowOrderFilled,
  last_value(CASE WHEN Event = 'GameRunning' THEN 'PreGame' WHEN InputWindow = 'Open' THEN 'OpenPeriod'
    WHEN InputWindow = 'Closed' AND InputWindowClosedID = last_id THEN 'PostGame'
    WHEN InputWindow = 'Closed' THEN 'RestPeriod' END IGNORE NULLS) OVER w AS Period
FROM marked WINDOW w AS (PARTITION BY {K} ORDER BY Timestamp, event_id ROWS UNBOUNDED PRECEDING)"""),
    "m_trial": (("labelled",), f"""
SELECT {K}, count(*) FILTER (TrialResult = 'RejInput') AS rejInput, count(*) FILTER (TrialResult = 'AccInput') AS accInput,
  count(*) FILTER (TrialResult = 'FabInput') AS fabInput, count(*) FILTER (TrialResult IN ('AccInput', 'FabInput')) AS posTrial,
  count(*) FILTER (TrialResult = 'RejInput') AS negTrial,
  count(*) FILTER (coalesce(TrialResult NOT IN ('RejInput', 'AccInput', 'FabInput'), true)) AS otherInput,
  count(*) FILTER (TrialResult IN ('RejInput', 'AccInput', 'FabInput')) AS totalTrials, min(BCIProcessingMode) AS BCIProcessingMode
FROM labelled WHERE Event = 'GameDecision' GROUP BY {K}"""),
    "m_total": (("labelled",), f"""
SELECT {K}, sum(time_delta) AS time_total, count(*) FILTER (Event = 'MotorImagery') AS mi_recog
FROM labelled WHERE Period IN ('RestPeriod', 'OpenPeriod') GROUP BY {K}"""),
    "m_window": (("labelled",), f"""
SELECT {K}, count(*) FILTER (hits > 0) AS mi_recog_trial, count(*) FILTER (hits > 0) AS mi_recog_window, sum(t) AS time_window
FROM (SELECT {K}, InputWindowOrderFilled AS o, count(*) FILTER (Event = 'MotorImagery') AS hits, sum(time_delta) AS t
  FROM labelled WHERE Period = 'OpenPeriod' GROUP BY ALL) WHERE o > -1 GROUP BY {K}"""),
    "m_rest": (("labelled",), f"""
SELECT {K}, count(*) FILTER (Event = 'MotorImagery') AS mi_recog_rest, sum(time_delta) AS time_rest
FROM labelled WHERE Period = 'RestPeriod' AND InputWindowClosedFill > -1
  AND InputWindowClosedFill < (SELECT max(InputWindowClosedFill) FROM labelled) GROUP BY {K}"""),
    "metrics": (("m_trial", "m_total", "m_window", "m_rest"), f"""
SELECT *, time_total / 60 AS time_total_min, time_window / 60 AS time_window_min, time_rest / 60 AS time_rest_min
FROM m_trial LEFT JOIN m_total USING ({K}) LEFT JOIN m_window USING ({K}) LEFT JOIN m_rest USING ({K})"""),
    "rated": ((), """
SELECT GameTitle, Participant, Condition, CAST(1 + (place + Participant) % 4 AS INTEGER) AS "Order",
  CASE WHEN Condition = '50A' THEN CASE WHEN Participant % 2 = 0 THEN 'KiwiHand' ELSE 'HandKiwi' END END AS GameOrderNoted,
  least(1.0::DOUBLE, cents / (n * 10000.0::DOUBLE)) AS PercNormalized, errors / n::DOUBLE AS FrustNormalized,
  CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS Gender,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'BCIExperience' WHEN 'MACHINERY' THEN 'MIExperience, some BCIExperience'
    WHEN 'FURNITURE' THEN 'MIExperience' END AS Comment,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Yellow' WHEN 'MACHINERY' THEN 'Blue' WHEN 'FURNITURE' THEN 'Grey'
    WHEN 'HOUSEHOLD' THEN 'Red' ELSE 'Green' END AS Color,
  CASE c_nationkey % 3 WHEN 0 THEN 'Kiwi' WHEN 1 THEN 'HandStrength' END AS Preference
FROM (SELECT *, CASE Condition WHEN '50A' THEN 0 WHEN '50B' THEN 1 WHEN '100A' THEN 2 ELSE 3 END AS place
  FROM (SELECT CASE WHEN day(ts) <= 15 THEN 'Kiwi' ELSE 'HandStrength' END AS GameTitle, user_id AS Participant,
    CASE ((day(ts) - 1) % 15) // 4 WHEN 0 THEN '50A' WHEN 1 THEN '50B' WHEN 2 THEN '100A' ELSE '100B' END AS Condition,
    sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors
    FROM events GROUP BY 1, 2, 3))
JOIN customer ON c_custkey = Participant"""),
    "ordered_ratings": (("rated",), """
SELECT *, "Order" + CASE WHEN GameTitle = 'Kiwi' AND GameOrder = 'HandKiwi' THEN 4
    WHEN GameTitle = 'HandStrength' AND GameOrder = 'KiwiHand' THEN 4 WHEN GameOrder IS NULL THEN NULL ELSE 0 END AS OrderAll
FROM (SELECT * EXCLUDE (GameOrderNoted), max(GameOrderNoted) OVER (PARTITION BY Participant) AS GameOrder FROM rated)"""),
    "ratings": (("ordered_ratings",), """
SELECT *, PercNormalized - coalesce(lag(PercNormalized) OVER w, 0) AS PercNormalized_prev_diff,
  PercNormalized - first_value(PercNormalized) OVER w AS PercNormalized_first_diff,
  PercNormalized - min(PercNormalized) OVER (PARTITION BY GameTitle, Participant) AS PercNormalized_rel
FROM ordered_ratings
WINDOW w AS (PARTITION BY GameTitle, Participant ORDER BY OrderAll NULLS LAST, Condition)"""),
    "st": (("metrics", "ratings"), f"""
SELECT m.*, OrderAll AS ConditionOrder, PercNormalized, PercNormalized_first_diff, PercNormalized_prev_diff,
  PercNormalized_rel, FrustNormalized, GameOrder, Gender AS gender, Comment AS comment, Color AS color,
  Preference AS gamePreference,
  mi_recog_trial / NULLIF(totalTrials, 0) AS rate_trial, posTrial / NULLIF(totalTrials, 0) AS rate_feedback,
  fabInput / NULLIF(totalTrials, 0) AS rate_fabInput, mi_recog_window / NULLIF(mi_recog_rest, 0) AS rest_window_mi_ratio,
  mi_recog_rest / NULLIF(time_rest_min, 0) AS fp_rate_minute, mi_recog_window / NULLIF(time_window_min, 0) AS mi_window_frequency,
  mi_recog_window - mi_recog_rest / NULLIF(time_rest, 0) AS excess_rate,
  coalesce(contains(Comment, 'BCIExperience'), false) AS bci_experience,
  coalesce(contains(Comment, 'MIExperience'), false) AS mi_experience
FROM metrics m LEFT JOIN ratings r USING ({K})"""),
    "cohorts": (("st",), """
SELECT *, CASE WHEN mi_recog > totalTrials * 2 THEN 'FPGroup' WHEN mi_recog IS NULL THEN NULL
    WHEN mi_recog_window < totalTrials * 0.5 THEN 'LowGroup' WHEN mi_recog_window IS NULL THEN NULL ELSE 'ExactGroup' END AS mi_group,
  CASE WHEN f_known < n THEN NULL WHEN f_mean > 0.8 THEN 'HIGH' WHEN f_mean < 0.4 THEN 'LOW' ELSE 'MID' END AS group_feedback,
  CASE WHEN f_known < n THEN NULL WHEN f_range > 0.5 THEN 'HIGH' WHEN f_range <= 0.25 THEN 'LOW' ELSE 'MID' END AS group_feedback_range,
  CASE WHEN t_known < n THEN NULL WHEN t_min > 0.75 THEN 'HIGH' WHEN t_min < 0.4 THEN 'LOW' ELSE 'MID' END AS group_trial
FROM (SELECT *, count(*) OVER w AS n, count(rate_feedback) OVER w AS f_known, avg(rate_feedback) OVER w AS f_mean,
    max(rate_feedback) OVER w - min(rate_feedback) OVER w AS f_range, count(rate_trial) OVER w AS t_known,
    min(rate_trial) OVER w AS t_min FROM st WINDOW w AS (PARTITION BY GameTitle, Participant))"""),
    "players": (("st",), """
SELECT Participant, GameTitle, min(gender) AS gender, CASE WHEN count(rate_trial) = count(*) THEN avg(rate_trial) END AS mean_rate,
  CASE WHEN count(rate_trial) = count(*) THEN min(rate_trial) END AS min_rate,
  CASE WHEN count(rate_trial) = count(*) THEN max(rate_trial) END AS max_rate,
  CASE WHEN count(rate_feedback) = count(*) THEN avg(rate_feedback) END AS mean_feedback,
  min(mi_experience) AS mi_experience, CASE WHEN count(time_total) = count(*) THEN avg(time_total) END AS time_total,
  CASE WHEN count(mi_recog) = count(*) THEN sum(mi_recog)::BIGINT END AS mi_recog_total,
  CASE WHEN count(mi_recog_rest) = count(*) THEN sum(mi_recog_rest)::BIGINT END AS mi_recog_rest,
  CASE WHEN count(mi_recog_window) = count(*) THEN sum(mi_recog_window)::BIGINT END AS mi_recog_window,
  CASE WHEN count(fp_rate_minute) = count(*) THEN avg(fp_rate_minute) END AS fp_rate_minute
FROM st GROUP BY 1, 2"""),
}


STOPS = """
SELECT * REPLACE (CASE WHEN Event = 'MotorImagery' AND event_id % 11 = 0 THEN 'GameStopped' ELSE Event END AS Event,
  CASE WHEN Participant % 13 = 0 AND Condition = '50A' THEN '50A_WRONG' ELSE Condition END AS Condition) FROM plain_log"""
GATED = f"""
SELECT * EXCLUDE (runs) FROM (SELECT *, count(CASE WHEN Event = 'GameRunning' THEN 1 END) OVER
  (PARTITION BY {K} ORDER BY Timestamp, event_id ROWS UNBOUNDED PRECEDING) AS runs FROM ungated) WHERE runs = 1"""


def with_gate(*names: str, kept: bool = False) -> str:
    """The parts over the log with stops and discarded labels, reduced to the first game run of each session.

    ``kept``: the session table has no discarded conditions.
    """
    plain = {"plain_log": PARTS["log"], "log": (("plain_log",), STOPS),
             "ungated": (("log",), PARTS["gaps"][1]), "gaps": (("ungated",), GATED)}
    if kept:
        plain |= {"all_st": PARTS["st"], "st": (("all_st",), "SELECT * FROM all_st WHERE coalesce(Condition NOT IN ('50A_WRONG', '50A-2'), true)")}
    return with_parts(*names, parts=PARTS | plain)


def with_parts(*names: str, parts: dict = PARTS) -> str:
    """``WITH`` clause of the named parts and all they build on."""
    chosen: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in chosen:
            needs, body = parts[name]
            for n in needs:
                add(n)
            chosen[name] = body

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in chosen.items()) + "\n"


def rnd(expr: str, alias: str | None = None, digits: int | None = None) -> str:
    """Rounded output column; the added zero turns a negative zero into zero.

    Without ``digits`` the number of the registered query is filled in later.
    """
    return f"round({expr}, {'@D' if digits is None else digits}) + 0.0 AS {alias or expr}"


def t_tail_sql(t: str, df: str) -> str:
    """Two-sided tail of the t distribution by its finite series, one for even and one for odd degrees of freedom."""
    a = f"atan(abs({t}) / sqrt({df}))"
    even = (f"list_sum(list_transform(generate_series(0, CAST({df} AS BIGINT) // 2 - 1), lambda j: "
            f"exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * power(cos({a}), 2 * j)))")
    odd = (f"coalesce(list_sum(list_transform(generate_series(0, (CAST({df} AS BIGINT) - 3) // 2), lambda j: "
           f"sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * power(cos({a}), 2 * j + 1))), 0)")
    return (f"CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN 1 - sin({a}) * {even} "
            f"ELSE 1 - 2 / pi() * ({a} + sin({a}) * {odd}) END")


def chi3_tail_sql(x: str) -> str:
    """Upper tail of the chi-square distribution with three degrees of freedom, by Simpson's rule on its root."""
    value = f"power(sqrt({x}) * k / 2000, 2) * exp(-power(sqrt({x}) * k / 2000, 2) / 2)"
    share = "CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return (f"1 - sqrt(2 / pi()) * sqrt({x}) / 6000 * "
            f"list_sum(list_transform(generate_series(0, 2000), lambda k: {share} * {value}))")


def chi1_tail_sql(x: str) -> str:
    """Upper tail of the chi-square distribution with one degree of freedom: the normal density by Simpson's rule."""
    value = f"exp(-power(sqrt({x}) * k / 2000, 2) / 2)"
    share = "CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return (f"1 - sqrt(2 / pi()) * sqrt({x}) / 6000 * "
            f"list_sum(list_transform(generate_series(0, 2000), lambda k: {share} * {value}))")


def mixed_fit_sql(name: str, source: str, predictors: int, rounds: int = 8) -> str:
    """CTEs ending in ``<name>_fit``: the maximum-likelihood fit of a random-intercept model by nested grids of theta.

    ``source`` gives the group ``g``, the predictors ``v1, v2, ..`` and last the response. The columns are not centred; each grid
    spans the neighbours of the best theta of the one before.
    """
    m = predictors + 2
    y = m - 1
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    v = ["1.0", *[f"v{i}" for i in range(1, m)]]
    total = [f"sum({v[i]} * {v[j]}) AS m{i}{j}" for i, j in pairs]

    def s(i: int, j: int) -> str:
        return f"s{min(i, j)}{max(i, j)}"

    def minor(rows: list[int], cols: list[int]) -> str:
        if not rows:
            return "1.0"
        terms = [f"{'-' if k % 2 else '+'} {s(rows[0], c)} * ({minor(rows[1:], cols[:k] + cols[k + 1:])})" for k, c in enumerate(cols)]
        return " ".join(terms)

    own = list(range(y))
    det = f"({minor(own, own)})"
    # Cramer's rule: column i of the cross products gives way to that of the response
    betas = [f"({minor(own, own[:i] + [y] + own[i + 1:])}) / {det} AS beta{i}" for i in own]
    inverse = [f"({minor(own[:i] + own[i + 1:], own[:i] + own[i + 1:])}) / {det} AS inverse{i}" for i in own]
    rss = f"s{y}{y} - " + " - ".join(f"beta{i} * {s(i, y)}" for i in own)
    parts = [
        f"{name}_z AS ({source})",
        f"{name}_m AS (SELECT count(*) AS rows, count(DISTINCT g) AS groups, {', '.join(total)} FROM {name}_z)",
        f"{name}_g AS (SELECT g, count(*) AS n, {', '.join(f'sum({c}) AS q{i}' for i, c in enumerate(v))} FROM {name}_z GROUP BY g)",
        f"{name}_n AS (SELECT n, count(*) AS c, {', '.join(f'sum(q{i} * q{j}) AS b{i}{j}' for i, j in pairs)} FROM {name}_g GROUP BY n)",
        f"{name}_t0 AS (SELECT 0.0::DOUBLE AS theta UNION ALL SELECT power(10, -3 + k / 10.0) FROM generate_series(0, 60) AS grid(k))",
    ]
    for r in range(rounds + 1):
        weighted = ", ".join(f"any_value(m{i}{j}) - sum(theta * theta / (1 + n * theta * theta) * b{i}{j}) AS s{i}{j}" for i, j in pairs)
        parts += [
            f"{name}_s{r} AS (SELECT theta, any_value(rows) AS rows, any_value(groups) AS groups, any_value(m00) AS m00, "
            f"{', '.join(f'any_value(m{i}{j}) AS f{i}{j}' for i, j in pairs)}, sum(c * ln(1 + n * theta * theta)) AS logdet, {weighted} "
            f"FROM {name}_t{r}, {name}_n, {name}_m GROUP BY theta)",
            f"{name}_b{r} AS (SELECT *, {', '.join(betas + inverse)} FROM {name}_s{r})",
            f"{name}_d{r} AS (SELECT *, logdet + rows * (1 + ln(2 * pi() * rss / rows)) AS deviance, lag(theta) OVER (ORDER BY theta) AS lo, "
            f"lead(theta) OVER (ORDER BY theta) AS hi FROM (SELECT *, {rss} AS rss FROM {name}_b{r}))",
            f"{name}_best{r} AS (SELECT * FROM {name}_d{r} ORDER BY deviance, theta LIMIT 1)",
        ]
        if r < rounds:
            parts.append(f"{name}_t{r + 1} AS (SELECT DISTINCT coalesce(lo, theta) + (coalesce(hi, theta) - coalesce(lo, theta)) * k / 20 AS theta "
                         f"FROM {name}_best{r}, generate_series(0, 20) AS grid(k))")
    mean = " + ".join(f"beta{i} * f0{i}" for i in own)
    square = " + ".join(f"beta{i} * beta{j} * f{min(i, j)}{max(i, j)}" for i in own for j in own)
    parts.append(f"{name}_fit AS (SELECT *, ({square} - power({mean}, 2) / rows) / (rows - 1) AS fixed FROM {name}_best{rounds})")
    return ",\n".join(parts)
