"""The same queries as SQL text for DuckDB, written from the definitions, not from the Spark plans.

Running totals, maxima per interval and self-joins are spelled out here, where
the Spark side uses conditional sums, so the two check each other.
"""

from tipoff.functions import network
from tipoff.queries import (
    DAYS, EMBEDDING_WIDTH, FORM_THRESHOLD, HELD_WEIGHTS, INTERVALS, LINE_COLUMNS, OPTION, Q_DECAY, Q_RATE, Q_STEPS,
    RATE, SCENARIOS, SEED, WEIGHT_DIGITS,
)
from tipoff.schema import FEATURE_TABLE, FEATURES, PAYOFF_COLUMNS, STATE

G = "HomeTeam, AwayTeam, DateKey"
GP = f"{G}, Player"
LAST = "{'t': TimeElapsed, 'n': PlaySeq}"  # the order of plays


def cuts_of(n):
    return [2880 / n * (i + 1) for i in range(n - 1)] + [None]


def r(expression, digits=6):
    return f"round({expression}, {digits}) + 0.0"


def significant(expression, digits):
    """Rounded to so many significant digits; 0 stays 0."""
    place = f"CAST({digits - 1} - floor(log10(abs({expression}))) AS INTEGER)"
    return f"CASE WHEN {expression} = 0 THEN 0.0 ELSE round({expression} * pow(10::DOUBLE, {place})) / pow(10::DOUBLE, {place}) END"


def ewm(value, partition, order, current=True):
    """Span 5: weights grow by 3/2 per row; a null has none."""
    end = "CURRENT ROW" if current else "1 PRECEDING"
    frame = f"(PARTITION BY {partition} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"
    rank = "_rn"
    return f"sum({value} * pow(1.5::DOUBLE, {rank})) OVER {frame} / sum(CASE WHEN {value} IS NOT NULL THEN pow(1.5::DOUBLE, {rank}) END) OVER {frame}"


def up_to(cut, value, asof=False):
    """The largest value up to a cut, or the last one by clock and play number."""
    pick = f"arg_max({value}, {LAST})" if asof else f"max({value})"
    return pick if cut is None else f"{pick} FILTER (TimeElapsed <= {cut})"


# Dates of the log written in four ways, and those that nothing reads.
LOST = "(CAST(h AS INTEGER) + dayofyear(dt)) % 17 = 0"
MIXED = f"""CASE WHEN {LOST} THEN 'day ' || dayofyear(dt) ELSE CASE dayofyear(dt) % 4 WHEN 0 THEN strftime(dt, '%Y-%m-%d')
    WHEN 1 THEN strftime(dt, '%-d %b %Y') WHEN 2 THEN day(dt) || '.' || month(dt) || '.' || year(dt)
    ELSE day(dt) || '/' || month(dt) || '/' || year(dt) END END"""


def chain(corrected=False, n=INTERVALS, statistic="Points", asof=False, mixed=False):
    """Named steps from events to features, each building on the ones before it."""
    cuts = cuts_of(n)
    team_home = "CASE WHEN Home = 1 THEN {h} ELSE {a} END"
    other_home = "CASE WHEN Home = 0 THEN {h} ELSE {a} END" if corrected else team_home
    snapshot = []
    for i, cut in enumerate(cuts):
        snapshot.append(f"coalesce({up_to(cut, 'CumulativePlayerPoints', asof)}, 0) AS p{i + 1}")
    game = ", ".join(f"coalesce({up_to(c, 'CumulativeTotalPoints', asof)}, 0) AS g{i + 1}" for i, c in enumerate(cuts))
    team = ", ".join(
        f"coalesce({up_to(c, 'CumulativeTeamPoints', asof)}, 0) AS t{i + 1}, "
        f"coalesce({up_to(c, 'CumulativeOpponentPoints', asof)}, 0) AS o{i + 1}"
        for i, c in enumerate(cuts)
    )
    opponent = "g{i} - t{i}" if corrected or asof else "o{i}"
    totals_home = "max(CumulativeTeamPoints) FILTER (Home = {f})" if corrected else "max(CumulativeTeamPoints)"
    allowed_home = (
        "max(CumulativeTotalPoints) - coalesce(max(CumulativeTeamPoints) FILTER (Home = {f}), 0)"
        if corrected else "max(CumulativeOpponentPoints)"
    )
    # With separate sides, a side without attempts has scored and seen nothing.
    h_scored, a_scored = (f"coalesce({totals_home.format(f=f)}, 0)" for f in (1, 0))
    h_allowed, a_allowed = (allowed_home.format(f=f) for f in (1, 0))
    if asof:
        last = lambda column, side="": f"coalesce(arg_max({column}, {LAST}){side}, 0)"
        h_scored, a_scored = (last("CumulativeTeamPoints", f" FILTER (Home = {f})") for f in (1, 0))
        h_allowed, a_allowed = (f"{last('CumulativeTotalPoints')} - {own}" for own in (h_scored, a_scored))
    current = not corrected
    number_order = '"Date", ' + G if corrected else G
    minutes = [48 - 48 / n * i for i in range(n)] + [0]
    stacked = " UNION ALL ".join(
        f"SELECT * EXCLUDE ({', '.join(f'{c}{j}' for c in 'pgto' for j in range(1, n + 1))}), {i} AS Interval, "
        + (f"p{i} AS cp, t{i} AS ct, {opponent.format(i=i)} AS co" if i else "0 AS cp, 0 AS ct, 0 AS co")
        + f", {minutes[i]}::DOUBLE AS minutes FROM player_games"
        for i in range(n + 1)
    )
    return {
        "ev": """SELECT event_id, user_id, event_type, value AS Value,
            date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS d,
            hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s,
            CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, user_id % 10 AS tm FROM events""",
        "slotted": """SELECT *, DATE '2024-01-01' + CAST(d + d // 3 + 2 * (d // 5) + d // 15 AS INTEGER) AS dt,
            CAST(k - 50 AS INTEGER) AS Swing, CASE WHEN tm < 5 THEN tm ELSE (tm - 5 - d % 5 + 5) % 5 END AS slot FROM ev""",
        "paired": """SELECT *, CASE WHEN d % 2 = 0 THEN slot ELSE 5 + (slot + d) % 5 END AS h,
            CASE WHEN d % 2 = 0 THEN 5 + (slot + d) % 5 ELSE slot END AS a
            FROM slotted""",
        "log": """SELECT event_id AS PlaySeq, 'T' || h AS HomeTeam, 'T' || a AS AwayTeam,
            DATE_TEXT AS DateKey, dt,
            CAST(CASE WHEN s < 82800 THEN s // 20700 + 1 ELSE 5 END AS INTEGER) AS Quarter,
            CAST(CASE WHEN s < 82800 THEN 720 - ((s % 20700) * 720) // 20700
                 ELSE 300 - (s - 82800) // 12 END AS INTEGER) AS SecLeft,
            CASE WHEN tm = h THEN event_type END AS HomePlay,
            CASE WHEN d >= 27 THEN 'playoff' ELSE 'regular' END AS GameType,
            CASE WHEN event_type NOT IN ('view', 'error')
                 THEN CASE WHEN k % 2 = 0 THEN 'make' ELSE 'miss' END END AS ShotOutcome,
            CASE WHEN event_type = 'view'
                 THEN CASE WHEN k % 4 <> 0 THEN 'make' ELSE 'miss' END END AS FreeThrowOutcome,
            CASE WHEN event_type NOT IN ('view', 'error') THEN CAST(user_id AS VARCHAR) END AS Shooter,
            CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) END AS FreeThrowShooter,
            CASE WHEN k % 5 = 0 THEN '3-pt' WHEN k % 5 <> 1 THEN '2-pt' END AS ShotType,
            CAST(CASE WHEN d < 15 THEN 2017 ELSE 2018 END AS INTEGER) AS Season, Value, Swing FROM paired WHERE KEPT""".replace("KEPT", f"NOT {LOST}" if mixed else "true")
        .replace("DATE_TEXT", MIXED if mixed else "day(dt) || '/' || month(dt) || '/' || year(dt)"),
        "plays": f"""SELECT *, dt AS "Date",
            CASE WHEN Quarter <= 4 THEN 720 * Quarter - SecLeft
                 ELSE {2880 if corrected else 2160} + 300 * (Quarter - 4) - SecLeft END AS TimeElapsed,
            CASE WHEN HomePlay IS NULL THEN 0 ELSE 1 END AS Home,
            CASE WHEN HomePlay IS NULL THEN AwayTeam ELSE HomeTeam END AS Team FROM log""",
        "scored": """SELECT *, coalesce(FreeThrowShooter, Shooter) AS Player,
            CASE WHEN FreeThrowOutcome IS NOT NULL THEN 1
                 WHEN ShotType IS NULL OR ShotType LIKE '3%' THEN 3 ELSE 2 END AS PotentialPoints,
            CASE WHEN FreeThrowOutcome = 'make' THEN 1
                 WHEN ShotOutcome = 'make' THEN CASE WHEN ShotType IS NULL OR ShotType LIKE '3%' THEN 3 ELSE 2 END
                 ELSE 0 END AS Points
            FROM plays WHERE FreeThrowOutcome IS NOT NULL OR ShotOutcome IS NOT NULL""",
        "running": "SELECT *, CumulativeTotalPoints - CumulativeTeamPoints AS CumulativeOpponentPoints FROM (SELECT *, "
        + ", ".join(
            f"sum({statistic}) OVER (PARTITION BY {G}{extra} ORDER BY TimeElapsed, PlaySeq "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS Cumulative{level}Points"
            for level, extra in (("Player", ", Player"), ("Total", ""), ("Team", ", Team"))
        )
        + " FROM scored WHERE GameType = 'regular')",
        "by_player": f"""SELECT {GP}, min(Season) AS Season, min("Date") AS "Date",
            arg_min(Home, PlaySeq) AS Home, {', '.join(snapshot)} FROM running GROUP BY {GP}""",
        "by_game": f"SELECT {G}, {game} FROM running GROUP BY {G}",
        "by_team": f"SELECT {G}, Home, {team} FROM running GROUP BY {G}, Home",
        "ids": f"SELECT {G}, row_number() OVER (ORDER BY {G}) - 1 AS GameId FROM (SELECT DISTINCT {G} FROM plays)",
        "rest": f"""SELECT {G}, Team, least(greatest(coalesce("Date" -
            lag("Date") OVER (PARTITION BY Team ORDER BY "Date", {G}), 0), 0), 4) AS TeamRest
            FROM (SELECT DISTINCT {G}, "Date", Team FROM plays)""",
        "finals": f"""SELECT {G}, min("Date") AS "Date", {h_scored} AS HScored, {a_scored} AS AScored,
            {h_allowed} AS HAllowed, {a_allowed} AS AAllowed FROM running GROUP BY {G}""",
        "home_form": f"""SELECT {G}, {ewm('HScored', 'HomeTeam', '_rn', current)} AS scored_form,
            {ewm('HAllowed', 'HomeTeam', '_rn', current)} AS allowed_form
            FROM (SELECT *, row_number() OVER (PARTITION BY HomeTeam ORDER BY "Date", {G}) AS _rn FROM finals)""",
        "away_form": f"""SELECT {G}, {ewm('AScored', 'AwayTeam', '_rn', current)} AS scored_form,
            {ewm('AAllowed', 'AwayTeam', '_rn', current)} AS allowed_form
            FROM (SELECT *, row_number() OVER (PARTITION BY AwayTeam ORDER BY "Date", {G}) AS _rn FROM finals)""",
        "player_form": f"""SELECT *, {ewm(f'p{n}', 'Player', '_rn', current)} AS RollingAvgPlayerPoints,
            row_number() OVER (PARTITION BY Player ORDER BY {number_order}) - 1 AS PlayerGameNumber
            FROM (SELECT *, row_number() OVER (PARTITION BY Player ORDER BY "Date", {G}) AS _rn FROM by_player)""",
        "player_games": f"""SELECT pf.* EXCLUDE (_rn), g.* EXCLUDE ({G}), t.* EXCLUDE ({G}, Home), i.GameId,
            {team_home.format(h='pf.HomeTeam', a='pf.AwayTeam').replace('Home = 1', 'pf.Home = 1')} AS Team,
            {other_home.format(h='pf.HomeTeam', a='pf.AwayTeam').replace('Home =', 'pf.Home =')} AS Opponent,
            CASE WHEN pf.Home = 1 THEN hf.scored_form ELSE af.scored_form END AS RollingAverageTeamPoints,
            CASE WHEN pf.Home = 0 THEN hf.allowed_form ELSE af.allowed_form END
                AS RollingAverageOpposingTeamAllowedPoints
            FROM player_form pf JOIN by_game g USING ({G}) JOIN by_team t USING ({G}, Home)
            JOIN ids i USING ({G}) JOIN home_form hf USING ({G}) JOIN away_form af USING ({G})""",
        "stacked": stacked,
        "featured": f"""SELECT s.*, co.TeamRest AS OpponentTeamRest, own.TeamRest AS TeamRest
            FROM stacked s JOIN rest own ON {_same('s', 'own')} AND own.Team = s.Team
            LEFT JOIN rest co ON {_same('s', 'co')} AND co.Team = s.Opponent""",
        "features": """SELECT CAST(Interval AS INTEGER) AS Interval, CAST(cp AS DOUBLE) AS CumulativePlayerPointsInterval,
            Player, CAST(GameId AS BIGINT) AS GameId, "Date", Team, Opponent, CAST(Home AS INTEGER) AS Home,
            CAST(TeamRest AS DOUBLE) AS TeamRest, CAST(OpponentTeamRest AS DOUBLE) AS OpponentTeamRest,
            CAST(ct AS DOUBLE) AS CumulativeTeamPointsInterval, CAST(co AS DOUBLE) AS CumulativeOpponentPointsInterval,
            CAST(ct - co AS DOUBLE) AS ScoreMarginInterval,
            CAST(abs(ct - co) * minutes AS DOUBLE) AS ScoreMarginxTimeRemainingInterval,
            CAST(abs(ct - co) * minutes * minutes AS DOUBLE) AS ScoreMarginxTimeRemaining2Interval,
            RollingAvgPlayerPoints, RollingAverageOpposingTeamAllowedPoints, RollingAverageTeamPoints
            FROM featured WHERE PlayerGameNumber >= 10 AND Season = 2018""",
        "training": f"SELECT * FROM features WHERE RollingAvgPlayerPoints > {FORM_THRESHOLD}",
        "valued": f"""SELECT *, greatest(CumulativePlayerPointsInterval
            - RollingAvgPlayerPoints * Interval / {float(INTERVALS)}, 0.0) AS Payoff,
            Interval < {INTERVALS} AS Alive FROM training""",
        "stats": " UNION ALL ".join(
            f"SELECT '{c}' AS feature, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS deviation" if c in PAYOFF_COLUMNS
            else f"SELECT '{c}', avg({c}::DOUBLE), stddev_pop({c}::DOUBLE) FROM training"
            for c in STATE
        ),
    }


def _same(a, b):
    return " AND ".join(f"{a}.{c} = {b}.{c}" for c in G.split(", "))


def steps(last, body, **options):
    """``body`` behind the named steps it needs, up to ``last``."""
    parts = []
    for name, sql in chain(**options).items():
        parts.append(f"{name} AS ({sql})")
        if name == last:
            break
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


def feature_columns(source="features", statistic="Points"):
    doubles = {f.name for f in FEATURE_TABLE if f.dataType.typeName() == "double"}
    columns = [f"{r(c)} AS {c.replace('Points', statistic)}" if c in doubles else f'"{c}"' for c in FEATURES]
    return f"SELECT {', '.join(columns)} FROM {source}"


def initial_theta():
    values = network.initial_parameters(len(STATE), SEED)
    return "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in values) + "]"


def theta_spans():
    """(first weight, first bias, inputs) of every layer in the flat parameter list."""
    at, spans = 0, []
    for rows, columns in network.layer_shapes(len(STATE)):
        spans.append((at, at + rows * columns, columns))
        at += rows * columns + rows
    return spans


def layer(level, x):
    """All pre-activations of a hidden layer as a list."""
    first, bias, columns = theta_spans()[level]
    row = f"theta[{first} + (i - 1) * {columns} + 1 : {first} + i * {columns}]"
    return f"list_transform(range(1, {network.HIDDEN + 1}), lambda i: list_dot_product({row}, {x}) + theta[{bias} + i])"


def softplus(z):
    return f"list_transform({z}, lambda v: ln(1 + exp(v)))"


def output(x):
    first, bias, _ = theta_spans()[2]
    return f"list_dot_product(theta[{first + 1}:{bias}], {x}) + theta[{bias + 1}]"


def network_steps(source, keys, theta):
    """Steps ``q0`` to ``q2`` hold the layers; ``valued_states`` the value per key."""
    return (
        f"q0 AS (SELECT {keys}, {theta} AS theta, {scaled_list()} AS x FROM {source}), "
        f"q1 AS (SELECT {keys}, theta, {softplus(layer(0, 'x'))} AS x FROM q0), "
        f"q2 AS (SELECT {keys}, theta, {softplus(layer(1, 'x'))} AS x FROM q1), "
        f"valued_states AS (SELECT {keys}, {output('x')} AS res FROM q2) "
    )


def scaled_list():
    scaled = []
    for c in STATE:
        pick = f"(SELECT {{}} FROM stats WHERE feature = '{c}')"
        scaled.append(f"({c}::DOUBLE - {pick.format('mean')}) / {pick.format('deviation')}")
    return "[" + ", ".join(scaled) + "]"


def histogram_sql(source, column, bins=100):
    return f""", lim AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}),
        w AS (SELECT lo, (hi - lo) / {bins} AS width FROM lim),
        c AS (SELECT least(CAST(floor(({column} - lo) / width) AS INTEGER), {bins - 1}) AS bin, count(*) AS n
              FROM {source}, w GROUP BY 1)
        SELECT CAST(b.bin AS INTEGER) AS bin, {r('lo + b.bin * width')} AS left_edge,
            CAST(coalesce(n, 0) AS BIGINT) AS rows
        FROM (SELECT unnest(range({bins})) AS bin) b CROSS JOIN w LEFT JOIN c USING (bin)"""


def policy_steps(iterations=100, eps=0.001):
    """Steps ``moves`` (state, next state, payoff) and ``policy`` (weights w of the last iteration).

    Every iteration sums the system over all moves, then eliminates column by column.
    """
    k = len(STATE)
    state = "[" + ", ".join(f"{c}::DOUBLE" for c in STATE) + "]"
    zeros = "[" + ", ".join(["0.0::DOUBLE"] * k) + "]"
    hold = "Alive AND list_dot_product(psi, w) > Payoff"
    cell = f"""CASE WHEN j <= {k} THEN phi[i] * (phi[j] - CASE WHEN {hold} THEN psi[j] ELSE 0 END)
        ELSE CASE WHEN {hold} THEN 0 ELSE phi[i] * Payoff END END"""
    system = f"""SELECT n, i, list(v ORDER BY j) AS line FROM (
        SELECT n, i, j, sum({cell}) + CASE WHEN i = j THEN {eps} ELSE 0 END AS v
        FROM policy_path CROSS JOIN moves
        CROSS JOIN (SELECT unnest(range(1, {k + 1})) AS i) CROSS JOIN (SELECT unnest(range(1, {k + 2})) AS j)
        WHERE n < {iterations} GROUP BY n, i, j) GROUP BY n, i"""
    solved = f"SELECT n, list(line ORDER BY i) AS m FROM ({system}) GROUP BY n"
    for p in range(1, k + 1):
        solved = f"""SELECT n, list_transform(m, lambda line, place: CASE WHEN place = {p}
            THEN list_transform(line, lambda x: x / m[{p}][{p}])
            ELSE list_transform(line, lambda x, c: x - line[{p}] / m[{p}][{p}] * m[{p}][c]) END) AS m FROM ({solved})"""
    return (
        f"moves AS (SELECT *, coalesce(lead(phi) OVER (PARTITION BY Player, GameId ORDER BY Interval), {zeros}) AS psi "
        f"FROM (SELECT *, {state} AS phi FROM valued)), "
        f"policy_path(n, w) AS (SELECT 0, {zeros} UNION ALL "
        f"SELECT n + 1, list_transform(m, lambda line: line[{k + 1}]) FROM ({solved})), "
        f"policy AS (SELECT w FROM policy_path WHERE n = {iterations}) "
    )


def training_steps():
    """Steps ``q_moves`` and ``q_path`` (n, theta, loss at theta n - 1): full-table gradient steps.

    ``theta`` lists weights then bias, layer by layer; each row's gradient is one such list.
    """
    k, h = len(STATE), network.HIDDEN
    zeros = "[" + ", ".join(["0.0::DOUBLE"] * k) + "]"

    def outer(back, seen):
        return f"flatten(list_transform({back}, lambda b: list_transform({seen}, lambda v: b * v)))"

    second, third = theta_spans()[1][0], theta_spans()[2][0]
    column = f"theta[{second} + (i - 1) * {h} + j]"
    back2 = f"list_transform(range(1, {h + 1}), lambda i: delta * theta[{third} + i] / (1 + exp(-z2[i])))"
    back1 = (
        f"list_transform(range(1, {h + 1}), lambda j: list_sum(list_transform(range(1, {h + 1}), "
        f"lambda i: back2[i] * {column})) / (1 + exp(-z1[j])))"
    )
    gradient = (
        f"list_concat(list_concat({outer('back1', 'phi')}, back1), "
        f"list_concat(list_concat({outer('back2', 'h1')}, back2), "
        f"list_concat(list_transform(h2, lambda v: delta * v), [delta])))"
    )
    chained = f"SELECT n, theta, phi, psi, Payoff, Alive FROM q_path CROSS JOIN q_moves WHERE n < {Q_STEPS}"
    for name, value in (
        ("z1", layer(0, "phi")), ("h1", softplus("z1")), ("z2", layer(1, "h1")), ("h2", softplus("z2")),
        ("n1", softplus(layer(0, "psi"))), ("n2", softplus(layer(1, "n1"))),
        ("delta", f"CASE WHEN Alive THEN greatest(Payoff, {output('n2')}) ELSE Payoff END - ({output('h2')})"),
        ("back2", back2), ("back1", back1), ("gradient", gradient),
    ):
        chained = f"SELECT *, {value} AS {name} FROM ({chained})"
    return (
        f"q_moves AS (SELECT *, coalesce(lead(phi) OVER (PARTITION BY Player, GameId ORDER BY Interval), {zeros}) AS psi "
        f"FROM (SELECT Player, GameId, Interval, Payoff, Alive, {scaled_list()} AS phi FROM valued)), "
        f"q_path(n, theta, loss) AS (SELECT 0, {initial_theta()}, 0.0::DOUBLE UNION ALL "
        f"SELECT s.n + 1, list(p.theta[place] + {q_rate('s.n')} * g / moves ORDER BY place), any_value(l) FROM "
        f"(SELECT n, place, sum(g) AS g, count(*) AS moves, avg(delta * delta) AS l FROM (SELECT n, delta, "
        f"unnest(range(1, {network.parameter_count(k) + 1})) AS place, unnest(gradient) AS g FROM ({chained})) GROUP BY n, place) s "
        f"JOIN q_path p ON p.n = s.n GROUP BY s.n) "
    )


def q_rate(n):
    return f"greatest({Q_RATE} * pow({Q_DECAY}::DOUBLE, {n}), 0.00001)"


def basis_sql(t, s):
    m = f"({s} / {OPTION['strike']}::DOUBLE)"
    share = f"({t} / {OPTION['expiry']}::DOUBLE)"
    return [
        "1.0::DOUBLE", f"exp(-{m} / 2)", f"exp(-{m} / 2) * (1 - {m})", f"cos({share} * pi() / 2)",
        f"CASE WHEN {t} = {OPTION['expiry']} THEN 0.0 ELSE ln({OPTION['expiry']}::DOUBLE - {t}) END",
        f"{share} * {share}",
    ]


def oracle_queries():
    n = INTERVALS
    bigint = lambda *names: ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in names)
    rest_body = """SELECT PlaySeq, {label}, CAST(own.TeamRest AS INTEGER) AS TeamRest,
        CAST(co.TeamRest AS INTEGER) AS OpponentTeamRest FROM plays p
        JOIN rest own ON {own} AND own.Team = p.Team LEFT JOIN rest co ON {other} AND co.Team = {opponent}"""
    other_team = "CASE WHEN p.Home = 1 THEN p.AwayTeam ELSE p.HomeTeam END"
    levels = (("Player", "p"), ("Total", "g"), ("Team", "t"), ("Opponent", "o"))
    snapshot_join = f"FROM by_player pl JOIN by_game g USING ({G}) JOIN by_team t USING ({G}, Home)"
    side_form = f"""SELECT {G}, CAST(side AS INTEGER) AS Home,
        {r('CASE WHEN side = 1 THEN hf.scored_form ELSE af.scored_form END')} AS RollingAverageTeamPoints,
        {r('CASE WHEN side = 0 THEN hf.allowed_form ELSE af.allowed_form END')}
            AS RollingAverageOpposingTeamAllowedPoints
        FROM home_form hf JOIN away_form af USING ({G}) CROSS JOIN (SELECT unnest([0, 1]) AS side)"""
    scenario_rows = ", ".join("(" + ", ".join([f"'{s[0]}'", *[f"{v}::DOUBLE" for v in s[1:]]]) + ")" for s in SCENARIOS)
    features_up = "Player, GameId, Interval"
    gram_terms = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, sum({STATE[i]}::DOUBLE * {STATE[j]}::DOUBLE){' + 0.001' if i == j else ''} AS value FROM valued"
        for i in range(len(STATE)) for j in range(len(STATE))
    ) + " UNION ALL " + " UNION ALL ".join(
        f"SELECT {i}, {len(STATE)}, sum({c}::DOUBLE * Payoff) FROM valued" for i, c in enumerate(STATE)
    )
    day_number = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))"
    t_now = "((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400.0::DOUBLE)"
    t_next = f"((step + 1) / {DAYS}::DOUBLE)"
    put_terms = " + ".join(f"({b})" for b in basis_sql(t_next, "next_price"))
    stop = f"greatest({OPTION['strike']}::DOUBLE - next_price, 0.0)"
    gamma = f"exp(-{RATE}::DOUBLE * {OPTION['expiry']}::DOUBLE / {DAYS})"
    width = EMBEDDING_WIDTH
    return {
        "load_plays": steps("log", """SELECT PlaySeq, HomeTeam, AwayTeam, DateKey AS "Date", Quarter, SecLeft,
            HomePlay, GameType, ShotOutcome, FreeThrowOutcome, Shooter, FreeThrowShooter, ShotType, Season FROM log"""),
        "csv_log_load": steps("log", """SELECT HomeTeam, AwayTeam, DateKey AS "Date", Quarter, SecLeft, HomePlay,
            GameType, ShotOutcome, FreeThrowOutcome, Shooter, FreeThrowShooter, ShotType, Season FROM log"""),
        "csv_log_checked": steps("log", """SELECT HomeTeam, AwayTeam, DateKey AS "Date", Quarter, SecLeft, HomePlay,
            GameType, ShotOutcome, FreeThrowOutcome, Shooter, FreeThrowShooter, ShotType FROM log
            WHERE PlaySeq % 13 <> 0 AND PlaySeq % 29 <> 0"""),
        "csv_log_rejected": steps("log", """SELECT HomeTeam, AwayTeam, DateKey AS "Date", Shooter, FreeThrowShooter,
            "column", content FROM log, (VALUES ('Quarter', 'Q?', 13), ('SecLeft', '4:5x', 29)) spoilt("column", content, n)
            WHERE PlaySeq % n = 0"""),
        "csv_log_counts": steps("log", """SELECT 'Quarter' AS "column", count(*) AS filled,
            count(*) FILTER (PlaySeq % 13 = 0) AS unreadable FROM log
            UNION ALL SELECT 'SecLeft', count(*), count(*) FILTER (PlaySeq % 29 = 0) FROM log
            UNION ALL SELECT 'line', count(*), 0 FROM log"""),
        "union_tagged_seasons": steps("log", """SELECT PlaySeq, HomeTeam,
            CASE WHEN Season = 2018 THEN ShotType END AS ShotType, Season FROM log"""),
        "game_clock": steps("plays", """SELECT PlaySeq, Quarter, SecLeft, CAST(TimeElapsed AS INTEGER) AS TimeElapsed,
            CAST(CASE WHEN Quarter < 4 THEN (4 - Quarter) * 720 ELSE 0 END + SecLeft AS INTEGER) AS TimeRemaining,
            CAST(CASE WHEN Quarter > 4 THEN TimeElapsed + 720 ELSE TimeElapsed END AS INTEGER) AS ElapsedAfterRegulation
            FROM plays"""),
        "date_parse": steps("log", 'SELECT PlaySeq, DateKey, dt AS "Date" FROM log'),
        "play_attribution": steps("plays", """SELECT PlaySeq, CAST(Home AS INTEGER) AS Home, Team, Team AS Opponent,
            CASE WHEN Home = 1 THEN AwayTeam ELSE HomeTeam END AS TrueOpponent FROM plays"""),
        "regular_only": steps("log", "SELECT PlaySeq, GameType, Season FROM log WHERE GameType = 'regular'"),
        "scoring_events": steps("scored", """SELECT PlaySeq, Player, CAST(PotentialPoints AS INTEGER) AS PotentialPoints,
            CAST(Points AS INTEGER) AS Points FROM scored"""),
        "running_points": steps("running", "SELECT PlaySeq, " + bigint(
            *[f"Cumulative{level}Points" for level, _ in levels]) + " FROM running"),
        "game_ordinal": steps("ids", f"SELECT {G}, CAST(GameId AS BIGINT) AS GameId FROM ids"),
        "order_day_ordinal": """SELECT o_custkey, DayText,
            CAST(row_number() OVER (ORDER BY o_custkey, DayText) - 1 AS BIGINT) AS DayId
            FROM (SELECT DISTINCT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS DayText FROM orders)""",
        "rest_days": steps("rest", f"SELECT {G}, Team, CAST(TeamRest AS INTEGER) AS TeamRest FROM rest"),
        "rest_days_joined": steps("rest", rest_body.format(
            label="p.Team", own=_same("p", "own"), other=_same("p", "co"), opponent="p.Team")),
        "rest_days_true_opponent": steps("rest", rest_body.format(
            label=f"{other_team} AS Opponent", own=_same("p", "own"), other=_same("p", "co"), opponent=other_team)),
        "rest_days_orders": """SELECT o_custkey, OrderDay, CAST(least(coalesce(OrderDay -
            lag(OrderDay) OVER (PARTITION BY o_custkey ORDER BY OrderDay), 0), 4) AS INTEGER) AS DaysRest
            FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS OrderDay FROM orders)""",
        "first_non_null": """SELECT l_orderkey,
            arg_min(l_partkey, l_linenumber * 10000000000 + l_partkey) FILTER (l_returnflag <> 'N') AS Part,
            CAST(arg_min(l_linenumber, l_linenumber * 10000000000 + l_partkey) FILTER (l_linestatus <> 'O') AS BIGINT) AS Line
            FROM lineitem GROUP BY l_orderkey""",
        "player_game_totals": steps("by_player", f"""SELECT Player, {G}, "Date",
            CAST(p{n} AS BIGINT) AS CumulativePlayerPoints FROM by_player"""),
        "player_form": steps("player_form", f"""SELECT Player, {G}, {r('RollingAvgPlayerPoints')}
            AS RollingAvgPlayerPoints FROM player_form"""),
        "player_form_before_game": steps("player_form", f"""SELECT Player, {G}, {r('RollingAvgPlayerPoints')}
            AS RollingAvgPlayerPoints, CAST(PlayerGameNumber AS BIGINT) AS PlayerGameNumber FROM player_form""",
            corrected=True),
        "player_game_number": steps("player_form", f"""SELECT Player, {G},
            CAST(PlayerGameNumber AS BIGINT) AS PlayerGameNumber FROM player_form"""),
        "ewm_events_daily": f"""WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS "Day", sum(value) AS DayValue
            FROM events GROUP BY ALL),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "Day") AS _rn FROM daily)
            SELECT user_id, "Day", {r('DayValue')} AS DayValue,
            round({ewm('DayValue', 'user_id', '_rn')}, 6) + 0.0 AS Form FROM ranked""",
        "ewm_events_missing": f"""WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS "Day",
            sum(value) FILTER (event_type = 'purchase') AS Spent FROM events GROUP BY ALL),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "Day") AS _rn FROM daily)
            SELECT user_id, "Day", {r('Spent')} AS Spent,
            round({ewm('Spent', 'user_id', '_rn')}, 6) + 0.0 AS Form FROM ranked""",
        "team_game_totals": steps("finals", f"""SELECT {G}, CAST(HScored AS BIGINT) AS GameTeamPoints,
            CAST(HAllowed AS BIGINT) AS GameOpponentPoints FROM finals"""),
        "team_form": steps("away_form", side_form),
        # Own totals with opponents as of the side's last attempt, before the game.
        "team_form_own_before_game": steps("running", f""", finals AS (SELECT {G}, min("Date") AS "Date",
            coalesce(max(CumulativeTeamPoints) FILTER (Home = 1), 0) AS HScored,
            coalesce(max(CumulativeTeamPoints) FILTER (Home = 0), 0) AS AScored,
            coalesce(max(CumulativeOpponentPoints) FILTER (Home = 1), 0) AS HAllowed,
            coalesce(max(CumulativeOpponentPoints) FILTER (Home = 0), 0) AS AAllowed FROM running GROUP BY {G}),
            home_form AS ({chain(corrected=True)['home_form']}), away_form AS ({chain(corrected=True)['away_form']})
            {side_form}"""),
        "interval_snapshots": steps("by_team", f"SELECT Player, {G}, " + ", ".join(
            f"CAST({c}{i} AS BIGINT) AS Cumulative{level}Points_{i}" for level, c in levels for i in range(1, n + 1)
        ) + f" {snapshot_join}"),
        "interval_snapshots_at_cut": steps("by_team", f"SELECT Player, {G}, " + ", ".join(
            f"CAST(g{i} - t{i} AS BIGINT) AS CumulativeOpponentPoints_{i}" for i in range(1, n + 1)
        ) + f" {snapshot_join}"),
        **{
            name: steps("by_team", f"SELECT Player, {G}, " + ", ".join(
                f"CAST({c}{i} AS BIGINT) AS Cumulative{level}Points_{i}" for level, c in levels for i in range(1, m + 1)
            ) + f" {snapshot_join}", n=m)
            for name, m in (("interval_snapshots_two", 2), ("interval_snapshots_twelve", 12))
        },
        "interval_snapshots_value": steps("by_team", f"SELECT Player, {G}, " + ", ".join(
            f"{r(f'{c}{i}::DOUBLE')} AS Cumulative{level}Value_{i}" for level, c in levels for i in range(1, n + 1)
        ) + f" {snapshot_join}", statistic="Value"),
        "interval_snapshots_swing": steps("by_team", f"SELECT Player, {G}, " + ", ".join(
            f"CAST({c}{i} AS BIGINT) AS Cumulative{level}Swing_{i}" for level, c in levels for i in range(1, n + 1)
        ) + f" {snapshot_join}", statistic="Swing"),
        "interval_snapshots_swing_at_cut": steps("by_team", f"SELECT Player, {G}, " + ", ".join(
            f"CAST({'g{0} - t{0}'.format(i) if c == 'o' else f'{c}{i}'} AS BIGINT) AS Cumulative{level}Swing_{i}"
            for level, c in levels for i in range(1, n + 1)
        ) + f" {snapshot_join}", statistic="Swing", asof=True),
        "stack_intervals": steps("stacked", f"""SELECT Player, {G}, CAST(Interval AS INTEGER) AS Interval,
            CAST(cp AS DOUBLE) AS CumulativePlayerPointsInterval, CAST(ct AS DOUBLE) AS CumulativeTeamPointsInterval,
            CAST(co AS DOUBLE) AS CumulativeOpponentPointsInterval FROM stacked"""),
        "interval_features": steps("stacked", f"""SELECT Player, {G}, CAST(Interval AS INTEGER) AS Interval,
            CAST(ct - co AS DOUBLE) AS ScoreMarginInterval,
            CAST(abs(ct - co) * minutes AS DOUBLE) AS ScoreMarginxTimeRemainingInterval,
            CAST(abs(ct - co) * minutes * minutes AS DOUBLE) AS ScoreMarginxTimeRemaining2Interval FROM stacked"""),
        "player_game_rows": steps("player_games", f"""SELECT Player, CAST(GameId AS BIGINT) AS GameId, Season,
            CAST(Home AS INTEGER) AS Home, p.Team, p.Opponent, CAST(own.TeamRest AS INTEGER) AS TeamRest,
            CAST(co.TeamRest AS INTEGER) AS OpponentTeamRest FROM player_games p
            JOIN rest own ON {_same('p', 'own')} AND own.Team = p.Team
            JOIN rest co ON {_same('p', 'co')} AND co.Team = p.Opponent"""),
        "eligible_games": steps("player_games", """SELECT Player, CAST(GameId AS BIGINT) AS GameId,
            CAST(PlayerGameNumber AS BIGINT) AS PlayerGameNumber FROM player_games
            WHERE PlayerGameNumber >= 10 AND Season = 2018"""),
        "feature_build": steps("features", feature_columns()),
        "feature_build_corrected": steps("features", feature_columns(), corrected=True),
        "feature_build_swing": steps("features", feature_columns(statistic="Swing"), statistic="Swing"),
        "feature_build_swing_at_cut": steps("features", feature_columns(statistic="Swing"), statistic="Swing", asof=True),
        "feature_build_mixed_dates": steps("features", feature_columns(), mixed=True),
        "date_quarantine": steps("paired", f"""SELECT 'T' || h AS HomeTeam, 'T' || a AS AwayTeam, {MIXED} AS DateKey, count(*) AS Plays
            FROM paired WHERE {LOST} GROUP BY ALL"""),
        "date_coverage": steps("paired", f""", told AS (SELECT dt, CASE WHEN {LOST} THEN 0 ELSE 1 + dayofyear(dt) % 4 END AS style,
            day(dt) AS d, month(dt) AS m FROM paired),
            cells AS (SELECT unnest([
              {{'format': 'M/d/yyyy', 'position': 0, 'r': style = 4 AND d <= 12, 'o': false, 'a': style = 4 AND d <= 12 AND d <> m}},
              {{'format': 'd/M/yyyy', 'position': 1, 'r': style = 4, 'o': style = 4 AND d > 12, 'a': style = 4 AND d <= 12 AND d <> m}},
              {{'format': 'yyyy-MM-dd', 'position': 2, 'r': style = 1, 'o': style = 1, 'a': false}},
              {{'format': 'd MMM yyyy', 'position': 3, 'r': style = 2, 'o': style = 2, 'a': false}},
              {{'format': 'd.M.yyyy', 'position': 4, 'r': style = 3, 'o': style = 3, 'a': false}},
              {{'format': NULL, 'position': 5, 'r': style = 0, 'o': style = 0, 'a': false}}], recursive := true) FROM told)
            SELECT "format", CAST(position AS INTEGER) AS position, count(*) FILTER (r) AS readable, count(*) FILTER (o) AS only,
            count(*) FILTER (a) AS ambiguous FROM cells GROUP BY ALL"""),
        "feature_roundtrip": steps("features", feature_columns()),
        "training_rows": steps("training", feature_columns("training")),
        "player_game_lookup": steps("features", f"""{feature_columns()}
            WINDOW best AS (ORDER BY CumulativePlayerPointsInterval DESC, Interval DESC, Player, GameId)
            QUALIFY Player = first_value(Player) OVER best AND GameId = first_value(GameId) OVER best"""),
        "sorted_sink": steps("features", """SELECT Player, GameId, Interval,
            row_number() OVER (ORDER BY Player, GameId, Interval) - 1 AS position FROM features"""),
        "stopping_payoff": steps("valued", f"SELECT {features_up}, {r('Payoff')} AS Payoff, Alive FROM valued"),
        "expected_path": steps("training", f"""SELECT {features_up},
            {r(f'RollingAvgPlayerPoints * Interval / {float(n)}')} AS ExpectedPoints,
            {r(f'CumulativePlayerPointsInterval - RollingAvgPlayerPoints * Interval / {float(n)}')} AS PathPayoff
            FROM training"""),
        **{name: steps("training", f"SELECT {features_up}, " + ", ".join(
            r(f"coalesce(lead({c}) OVER (PARTITION BY Player, GameId ORDER BY Interval), 0)::DOUBLE") + f" AS Next{c}"
            for c in STATE) + " FROM training") for name in ("bellman_pairs", "bellman_pairs_by_window")},
        "feature_stats": steps("stats", f"SELECT feature, {r('mean')} AS mean, {r('deviation')} AS deviation FROM stats"),
        "standardized_features": steps("stats", "SELECT Player, GameId, " + ", ".join(
            r(f"({c}::DOUBLE - (SELECT mean FROM stats WHERE feature = '{c}')) / "
              f"(SELECT deviation FROM stats WHERE feature = '{c}')") + f" AS {c}" for c in STATE) + " FROM training"),
        "lineitem_stats": " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {r(f'avg({c})')} AS mean, {r(f'stddev_pop({c})')} AS deviation FROM lineitem"
            for c in LINE_COLUMNS),
        "lineitem_histogram": "WITH prices AS (SELECT CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem)"
        + histogram_sql("prices", "price"),
        "bellman_gram": steps("valued", f"""SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
            {r('value', 1)} AS value FROM ({gram_terms})"""),
        "bellman_gram_held": steps("valued", ", " + policy_steps().split("policy_path(n, w)")[0].rstrip(", ") + f""",
            held AS (SELECT *, Alive AND list_dot_product(psi, {[float(w) for w in HELD_WEIGHTS]}::DOUBLE[]) > Payoff AS hold FROM moves)
            SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, {r(f"""sum(CASE WHEN j <= {len(STATE)}
                THEN phi[i] * (phi[j] - CASE WHEN hold THEN psi[j] ELSE 0 END)
                ELSE CASE WHEN hold THEN 0 ELSE phi[i] * Payoff END END) + CASE WHEN i = j THEN 0.001 ELSE 0 END""", 1)} AS value
            FROM held CROSS JOIN (SELECT unnest(range(1, {len(STATE) + 1})) AS i)
            CROSS JOIN (SELECT unnest(range(1, {len(STATE) + 2})) AS j) GROUP BY i, j"""),
        "embedding_gram": f"""SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
            {r('sum(embedding[i + 1]::DOUBLE * embedding[j + 1]::DOUBLE)', 5)} AS value FROM embeddings
            CROSS JOIN (SELECT unnest(range({width})) AS i) CROSS JOIN (SELECT unnest(range({width})) AS j) GROUP BY i, j""",
        "lspi_weights": steps("valued", ", " + policy_steps() + f"""
            SELECT CAST(position AS INTEGER) AS position, {STATE}[position + 1] AS feature,
            {significant('w[position + 1]', WEIGHT_DIGITS)} AS weight FROM policy CROSS JOIN (SELECT unnest(range({len(STATE)})) AS position)"""),
        **{name: steps("valued", ", " + policy_steps() + "SELECT " + ", ".join(
            f"{r(c)} AS {c}" if c not in ("Interval", "Home") else c for c in STATE)
            + f""", Player, {r('list_dot_product(phi, w)')} AS res, Opponent AS Opposition, "Date", GameId AS Game
            FROM moves CROSS JOIN policy""") for name in ("lspi_scored", "lspi_output_roundtrip")},
        "exercise_policy": steps("valued", ", " + policy_steps() + f"""
            SELECT {features_up}, {r('Payoff')} AS Payoff, {r('list_dot_product(psi, w)')} AS Continuation,
            CASE WHEN Alive AND list_dot_product(psi, w) > Payoff THEN 'hold' ELSE 'exercise' END AS Decision
            FROM moves CROSS JOIN policy"""),
        "network_score": steps("stats", ", " + network_steps("training", features_up, initial_theta())
            + f"SELECT {features_up}, {r('res')} AS res FROM valued_states"),
        "network_output_roundtrip": steps("stats", ", " + network_steps(
            "training", ", ".join([*STATE, "Player"]), initial_theta()) + "SELECT " + ", ".join(
            f"{r(c)} AS {c}" if c not in ("Interval", "Home") else c for c in STATE)
            + f", Player, {r('res')} AS res FROM valued_states"),
        "score_histogram": steps("stats", ", " + network_steps("training", features_up, initial_theta()).rstrip()
            + histogram_sql("valued_states", "res")),
        "scenario_price": steps("stats", f", scenarios(Scenario, {', '.join(STATE)}) AS (VALUES {scenario_rows}), "
            + network_steps("scenarios", "Scenario, Interval", initial_theta())
            + f"SELECT Scenario, Interval, {r('res')} AS price FROM valued_states"),
        "fitted_q_loss": steps("stats", ", " + training_steps() + f"""SELECT CAST(n - 1 AS INTEGER) AS step,
            {r('loss')} AS loss, {r(q_rate('n - 1'))} AS rate FROM q_path WHERE n > 0"""),
        "scenario_price_trained": steps("stats", ", " + training_steps()
            + f", scenarios(Scenario, {', '.join(STATE)}) AS (VALUES {scenario_rows}), "
            + network_steps("scenarios", "Scenario, Interval", f"(SELECT theta FROM q_path WHERE n = {Q_STEPS})")
            + f"SELECT Scenario, Interval, {r('res')} AS price FROM valued_states"),
        "option_basis": "SELECT event_id, " + ", ".join(
            f"{r(b)} AS basis_{i}" for i, b in enumerate(basis_sql(t_now, "value"))) + " FROM events",
        "put_target": f"""WITH daily AS (SELECT user_id, {day_number} AS step, sum(value) AS price FROM events GROUP BY ALL),
            path AS (SELECT *, lead(price) OVER (PARTITION BY user_id ORDER BY step) AS next_price FROM daily)
            SELECT user_id, CAST(step AS INTEGER) AS step, round({gamma} * CASE WHEN step < {DAYS - 1}
            THEN greatest({stop}, {put_terms}) ELSE {stop} END, 6) + 0.0 AS target
            FROM path WHERE next_price IS NOT NULL""",
    }
