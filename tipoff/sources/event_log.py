"""A play log derived from an ``events`` table (event_id, ts, user_id, event_type, value, props).

Users play for ten teams; each day five pairings take place. Every event is a
play. Days of events become dates of games by uneven steps, the same for all
teams, so that rests of 1, 2, 3 and more days occur. Integer rules only, so any
engine derives the same log.
"""

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the derived log.
FIRST_DAY = "2024-01-01"
OVERTIME_FROM = 82_800  # second of the day; before it four equal periods
DAY_PERIOD = 20_700
DATE_FORMAT = "d/M/yyyy"  # day first and unpadded, so its text order is not date order
PLAYOFFS_FROM = 27
SECOND_SEASON_FROM = 15
SEASONS = (2017, 2018)


def game_day(d: Column) -> Column:
    """Days from the first date to that of day ``d``: steps of 1, 2, 3 and 5 days."""
    whole = lambda n: F.floor(d / n)
    return (d + whole(3) + 2 * whole(5) + whole(15)).cast("int")


def plays_from_events(events: DataFrame, **statistics: Column) -> DataFrame:
    """The raw log columns plus Season and PlaySeq, one row per event. Narrow.

    ``statistics`` adds columns made from the events' own.
    """
    ts = F.col("ts")
    base = events.select(
        F.col("event_id").alias("PlaySeq"),
        F.col("user_id").alias("_user"),
        F.col("event_type").alias("_type"),
        F.datediff(ts.cast("date"), F.lit(FIRST_DAY).cast("date")).alias("_d"),
        (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).alias("_s"),
        F.regexp_extract("props", r'"k":\s*(\d+)', 1).try_cast("int").alias("_k"),
        *[value.alias(name) for name, value in statistics.items()],
    )
    d, s, k = F.col("_d"), F.col("_s"), F.col("_k")
    team = F.col("_user") % 10
    slot = F.when(team < 5, team).otherwise((team - 5 - d % 5 + 5) % 5)
    base = base.withColumns({
        "_team": team, "_slot": slot, "_date": F.date_add(F.lit(FIRST_DAY).cast("date"), game_day(d)),
    })
    rival = 5 + (F.col("_slot") + d) % 5
    slot_home = d % 2 == 0
    name = lambda c: F.concat(F.lit("T"), F.coalesce(c, F.lit(0)).cast("string"))
    day = F.col("_date")
    date_text = F.concat_ws("/", F.dayofmonth(day), F.month(day), F.year(day))
    base = base.withColumns({
        "_home": F.when(slot_home, F.col("_slot")).otherwise(rival),
        "_away": F.when(slot_home, rival).otherwise(F.col("_slot")),
    })
    regulation = s < OVERTIME_FROM
    user = F.col("_user").cast("string")
    free_throw, no_attempt = F.col("_type") == "view", F.col("_type") == "error"
    free_throw_outcome = F.when(free_throw, F.when(k % 4 != 0, "make").otherwise("miss"))
    shot_outcome = F.when(~free_throw & ~no_attempt, F.when(k % 2 == 0, "make").otherwise("miss"))
    whole = lambda x, y: F.floor(x / y)
    return base.select(
        name(F.col("_home")).alias("HomeTeam"),
        name(F.col("_away")).alias("AwayTeam"),
        date_text.alias("Date"),
        F.when(regulation, whole(s, DAY_PERIOD) + 1).otherwise(5).cast("int").alias("Quarter"),
        F.when(regulation, 720 - whole((s % DAY_PERIOD) * 720, DAY_PERIOD))
        .otherwise(300 - whole(s - OVERTIME_FROM, 12)).cast("int").alias("SecLeft"),
        F.when(F.col("_team") == F.col("_home"), F.col("_type")).alias("HomePlay"),
        F.when(d >= PLAYOFFS_FROM, "playoff").otherwise("regular").alias("GameType"),
        shot_outcome.alias("ShotOutcome"),
        free_throw_outcome.alias("FreeThrowOutcome"),
        F.when(shot_outcome.isNotNull(), user).alias("Shooter"),
        F.when(free_throw_outcome.isNotNull(), user).alias("FreeThrowShooter"),
        F.when(k % 5 == 0, "3-pt").when(k % 5 != 1, "2-pt").alias("ShotType"),
        F.when(d < SECOND_SEASON_FROM, SEASONS[0]).otherwise(SEASONS[1]).alias("Season"),
        "PlaySeq",
        *statistics,
    )
