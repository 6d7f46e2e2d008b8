"""Name, number and cell cleanup as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the cleanup deletes from a player's name, in this order.
NAME_DELETES = ("II", " I", "Jr.", "Sr.", ".", "'")
SPACES = r"\s+"


def delete(text: Column, part: str) -> Column:
    return F.replace(text, F.lit(part), F.lit(""))


def player_name(name: Column, compat: bool = True) -> Column:
    """Ordered literal deletes, then trim. Their side effects (' I' inside a name: 'Bucky Irving' -> 'Buckyrving') are kept;
    with compat=False only whole suffix words go."""
    if not compat:
        return F.trim(F.regexp_replace(F.translate(name, ".'", ""), r"\s+(II|III|IV|V|Jr|Sr)\s*$", ""))
    for part in NAME_DELETES:
        name = delete(name, part)
    return F.trim(name)


def last_token(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), SPACES), -1)


def clean_player(name: Column, position: Column, compat: bool = True) -> Column:
    return F.when(position == "DST", last_token(name)).otherwise(player_name(name, compat))


def before_paren(text: Column, strip: bool = True) -> Column:
    head = F.substring_index(text, "(", 1)
    return F.trim(head) if strip else head


def without_last_token(text: Column) -> Column:
    tokens = F.split(F.trim(text), SPACES)
    return F.array_join(F.slice(tokens, F.lit(1), F.size(tokens) - 1), " ")



def percent(text: Column, empty_is_zero: bool = False) -> Column:
    bare = F.btrim(F.trim(text), F.lit("%"))
    value = bare.try_cast("double")
    return F.when(bare == "", F.lit(0.0)).otherwise(value) if empty_is_zero else value


def money(text: Column) -> Column:
    return F.trim(delete(delete(text, "$"), ",")).try_cast("int")


def opponent(text: Column) -> Column:
    return delete(text, "@")


def points_cell(text: Column) -> Column:
    """Weekly points: null, BYE and - count as 0."""
    bare = F.trim(text)
    return F.when(bare.isNull() | bare.isin("", "BYE", "-"), F.lit(0.0)).otherwise(bare.try_cast("double"))


def round1(x: Column) -> Column:
    """Half to even at one decimal, as arrays are rounded: rint(10 x) / 10."""
    return F.rint(x * 10) / 10


def per_game(x: Column, games: Column) -> Column:
    """Average of a total; no games give null."""
    return round1(F.try_divide(x.cast("double"), games.cast("double")))


def blend(proj: Column, avg: Column, weights: tuple[Column, Column] | tuple[float, float]) -> Column:
    w1, w2 = (x if isinstance(x, Column) else F.lit(float(x)) for x in weights)
    return round1(proj * w1 + avg * w2)


def matches_name(name: Column, pattern: Column | str) -> Column:
    """Case-insensitive regular expression, anywhere in the name."""
    return F.rlike(name, F.concat(F.lit("(?i)"), F.lit(pattern) if isinstance(pattern, str) else pattern))


def page_path(position: Column) -> Column:
    """File name of a position's page: PPR pages but for QB and DST."""
    return F.concat(F.when(~F.upper(position).isin("QB", "DST"), "ppr-").otherwise(""), F.lower(position), F.lit(".php"))


def not_in(column: Column, values: list[str] | tuple[str, ...]) -> Column:
    """Keeps nulls; an empty list keeps all."""
    return F.coalesce(~column.isin(list(values)), F.lit(True)) if values else F.lit(True)


def week_of_file(path: Column) -> Column:
    return F.regexp_extract(path, r"_w(\d+)\.", 1).try_cast("int")


def year_of_file(path: Column) -> Column:
    return F.regexp_extract(path, r"_(\d{4})_w\d+\.", 1).try_cast("int")


def display_position(text: Column) -> Column:
    return F.initcap(text)


def fixed2(x: Column) -> Column:
    """Two decimals, as totals are shown."""
    return F.format_string("%.2f", x.cast("double"))
