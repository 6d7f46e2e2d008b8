"""Schemas, column lists and constants of the roster domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}


def ddl(text: str) -> T.StructType:
    """`name type, ...` without a session."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (part.split() for part in text.split(","))])


# Positions in serving order, salary cap, roster size and base counts, dropped grades, score weights, slates by priority.
POSITIONS = ("QB", "RB", "WR", "TE", "DST")
CAP, PLAYERS = 50_000, 9
LIMITS = {"QB": 1, "RB": 2, "WR": 3, "TE": 1, "DST": 1}
STRICT_GRADES, LOOSE_GRADES = ("F", "D-", "D", "D+"), ("F", "D-")
VARIANTS = ((1.0, 0.0), (0.9, 0.1), (0.8, 0.2))
SLATES = ("Thu-Mon", "Fri-Mon", "Sat-Mon", "Sat-Sun")

# File layouts.
SALARY = ddl("player string, position string, team string, opponent string, salary int")
POOL = ddl("year int, week int, player string, position string, team string, opponent string, grade string, rank int, avg_fpts double, proj_fpts double, salary int")
RANKINGS = ddl("player string, position string, year int, week int, rank int, min_rank int, max_rank int, avg_rank double, std_rank double, grade string, proj_fpts double")
PAGES = ddl("position string, year int, week int, html string")
POOL_COLUMNS = POOL.names

# Columns of the statistics pages by position, in page order.
STATS = {
    "QB": "player cmp att cmp_perc pass_yds pass_yds/att pass_tds ints sacks rush rush_yds rush_tds fl games fpts avg_fpts rost".split(),
    "RB": "player rush rush_yds rush_yds/rush lng 20+ rush_tds rec tgt rec_yds rec_yds/rec rec_tds fl games fpts avg_fpts rost".split(),
    "WR": "player rec tgt rec_yds rec_yds/rec lng 20+ rec_tds rush rush_yds rush_tds fl games fpts avg_fpts rost".split(),
    "DST": "player sack int fr ff dst_td safety spc_td games fpts avg_fpts rost".split(),
}
STATS["TE"] = STATS["WR"]
PROJECTIONS = {
    "QB": "player proj_att proj_cmp proj_pass_yds proj_pass_tds proj_ints proj_rush proj_rush_yds proj_rush_tds proj_fl proj_fpts".split(),
    "RB": "player proj_rush proj_rush_yds proj_rush_tds proj_rec proj_rec_yds proj_rec_tds proj_fl proj_fpts".split(),
    "WR": "player proj_rec proj_rec_yds proj_rec_tds proj_rush proj_rush_yds proj_rush_tds proj_fl proj_fpts".split(),
    "TE": "player proj_rec proj_rec_yds proj_rec_tds proj_fl proj_fpts".split(),
    "DST": "player proj_sack proj_int proj_fr proj_ff proj_dst_td proj_safety proj_pass_att proj_yds_allowed proj_fpts".split(),
}
ADVANCED = {
    "QB": "player games cmp att cmp_perc pass_yds pass_yds/att pass_air_yds pass_air_yds/att pass_10_plus pass_20_plus pass_30_plus pass_40_plus pass_50_plus pkt_time sacks knockdowns hurries blitz poor_pass drops rz_att rtg".split(),
    "RB": "player games rush rush_yds rush_yds/rush rush_yds_bcon rush_yds_bcon/rush rush_yds_acon rush_yds_acon/rush brkn_tkl tkl_loss tkl_loss_yds lng_td rush_10_plus rush_20_plus rush_30_plus rush_40_plus rush_50_plus rush_lng rec tgt rz_tgt rec_yds_acon".split(),
    "WR": "player games rec rec_yds rec_yds/rec rec_yds_bc rec_yds_bc/rec rec_air_yds rec_air_yds/rec rec_yds_ac rec_yds_ac/rec rec_yds_acon rec_yds_acon/rec brkn_tkl tgt tgt_perc catchable drops rz_tgt rec_10_plus rec_20_plus rec_30_plus rec_40_plus rec_50_plus rec_lng".split(),
}
ADVANCED["TE"] = ADVANCED["WR"]
SNAPS = "player team games snaps snaps/game snap_perc snap_rush_perc snap_tgt_perc touch_perc util_perc fpts fpts/100_snaps".split()
RED_ZONE = {
    "QB": "player cmp att cmp_perc pass_yds pass_yds/att pass_tds ints sacks rush rush_yds rush_tds rush_perc fl games fpts fpts/game rost".split(),
    "RB": "player rush rush_yds rush_yds/rush rush_tds rush_perc rec tgt rec_perc rec_yds rec_yds/rec rec_tds tgt_perc fl games fpts fpts/game rost".split(),
    "WR": "player rec tgt rec_perc rec_yds rec_yds/rec rec_tds tgt_perc rush rush_yds rush_tds rush_perc fl games fpts fpts/game rost".split(),
}
RED_ZONE["TE"] = RED_ZONE["WR"]

# The nicknames of the 32 teams.
TEAMS = (
    "Cardinals Falcons Ravens Bills Panthers Bears Bengals Browns Cowboys Broncos Lions Packers Texans Colts Jaguars Chiefs "
    "Raiders Chargers Rams Dolphins Vikings Patriots Saints Giants Jets Eagles Steelers 49ers Seahawks Buccaneers Titans Commanders"
).split()


def leader_columns(weeks: int) -> list[str]:
    """Columns of the leaders page: 18 weeks, or 17 in older seasons."""
    return ["player", "position", "team", *(f"week_{w}" for w in range(1, weeks + 1)), "avg_fpts", "ttl_fpts"]


def position_order(position: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, POSITIONS)), position)
