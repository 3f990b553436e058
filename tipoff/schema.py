"""Fixed schemas and column contracts."""

from pyspark.sql import types as T

# The columns a raw play log must carry.
PLAY_LOG = T.StructType([
    T.StructField("HomeTeam", T.StringType()),
    T.StructField("AwayTeam", T.StringType()),
    T.StructField("Date", T.StringType()),
    T.StructField("Quarter", T.IntegerType()),
    T.StructField("SecLeft", T.IntegerType()),
    T.StructField("HomePlay", T.StringType()),
    T.StructField("GameType", T.StringType()),
    T.StructField("ShotOutcome", T.StringType()),
    T.StructField("FreeThrowOutcome", T.StringType()),
    T.StructField("Shooter", T.StringType()),
    T.StructField("FreeThrowShooter", T.StringType()),
    T.StructField("ShotType", T.StringType()),
])

# A game is one pairing on one date; the date is kept as the log's own text.
GAME = ["HomeTeam", "AwayTeam", "DateKey"]

# Processed feature table, in output order.
FEATURE_TABLE = T.StructType([
    T.StructField("Interval", T.IntegerType()),
    T.StructField("CumulativePlayerPointsInterval", T.DoubleType()),
    T.StructField("Player", T.StringType()),
    T.StructField("GameId", T.LongType()),
    T.StructField("Date", T.DateType()),
    T.StructField("Team", T.StringType()),
    T.StructField("Opponent", T.StringType()),
    T.StructField("Home", T.IntegerType()),
    T.StructField("TeamRest", T.DoubleType()),
    T.StructField("OpponentTeamRest", T.DoubleType()),
    T.StructField("CumulativeTeamPointsInterval", T.DoubleType()),
    T.StructField("CumulativeOpponentPointsInterval", T.DoubleType()),
    T.StructField("ScoreMarginInterval", T.DoubleType()),
    T.StructField("ScoreMarginxTimeRemainingInterval", T.DoubleType()),
    T.StructField("ScoreMarginxTimeRemaining2Interval", T.DoubleType()),
    T.StructField("RollingAvgPlayerPoints", T.DoubleType()),
    T.StructField("RollingAverageOpposingTeamAllowedPoints", T.DoubleType()),
    T.StructField("RollingAverageTeamPoints", T.DoubleType()),
])
FEATURES = FEATURE_TABLE.fieldNames()

# The 13 state features; the order is part of the contract.
STATE = [
    "Interval",
    "CumulativePlayerPointsInterval",
    "Home",
    "TeamRest",
    "OpponentTeamRest",
    "CumulativeTeamPointsInterval",
    "CumulativeOpponentPointsInterval",
    "ScoreMarginInterval",
    "ScoreMarginxTimeRemainingInterval",
    "ScoreMarginxTimeRemaining2Interval",
    "RollingAvgPlayerPoints",
    "RollingAverageOpposingTeamAllowedPoints",
    "RollingAverageTeamPoints",
]

# The three state columns the payoff reads; they are never standardised.
PAYOFF_COLUMNS = ["Interval", "CumulativePlayerPointsInterval", "RollingAvgPlayerPoints"]
