"""Scalar column functions. Missing values are NULL throughout; nothing here returns NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from touchline.params import DEFAULT
from touchline.sources.leagues import UEFA_QUALIFYING


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once. What a lambda takes from outside is worked out at each of its steps."""
    return F.element_at(F.transform(F.array(value), body), 1)


def season_start(day) -> Column:
    """The year in which the season of a day began; seasons begin in July."""
    return F.year(col(day)) - F.when(F.month(col(day)) < 7, 1).otherwise(0)


def season_code(start) -> Column:
    """2014 gives '1415'."""
    return F.format_string("%02d%02d", F.pmod(col(start), F.lit(100)), F.pmod(col(start) + 1, F.lit(100)))


def result(home_goals, away_goals) -> Column:
    h, a = col(home_goals), col(away_goals)
    return F.when(h > a, "H").when(h < a, "A").when(h == a, "D")


def class_index(res) -> Column:
    """H, D, A as 0, 1, 2."""
    return F.when(col(res) == "H", 0).when(col(res) == "D", 1).when(col(res) == "A", 2)


def first_valid_odds(triples: dict[str, tuple]) -> Column:
    """The first triple, in the given order, of which all three values are above 1: struct home, draw, away, type."""
    found = [
        F.when(reduce(lambda a, b: a & b, [F.coalesce(col(x) > 1, F.lit(False)) for x in t]), F.struct(*[col(x).cast("double").alias(n) for x, n in zip(t, ("home", "draw", "away"))], F.lit(name).alias("type")))
        for name, t in triples.items()
    ]
    return F.coalesce(*found)


def mixed_date(text) -> Column:
    """Day-first dates with four or two digits of the year; anything else is NULL."""
    return F.coalesce(F.try_to_date(F.trim(col(text)), "dd/MM/yyyy"), F.try_to_date(F.trim(col(text)), "dd/MM/yy"))


def number(text) -> Column:
    return col(text).try_cast("double")


def round_class(competition, competition_round, season, day) -> Column:
    """Struct is_knockout, neutral of a cup round: qualifying competitions and group rounds are (0, 0); finals, and the single-leg rounds of August 2020, are neutral."""
    low = F.lower(F.trim(F.coalesce(col(competition_round), F.lit(""))))
    league = F.coalesce(col(competition).isin(*UEFA_QUALIFYING), F.lit(False)) | low.startswith("group")
    bubble = (col(season) == 2019) & (col(day) >= F.lit("2020-08-01").cast("date")) & ~low.contains("leg")
    neutral = F.when((low == "final") | bubble, 1).otherwise(0)
    return F.struct(F.when(league, 0).otherwise(1).alias("is_knockout"), F.when(league, 0).otherwise(neutral).alias("neutral"))


def goal_multiplier(difference) -> Column:
    d = F.abs(col(difference))
    return F.when(d <= 1, 1.0).when(d == 2, 1.5).otherwise((d + 11) / 8.0)


def market_probabilities(home, draw, away) -> Column:
    """Margin-free probabilities of three odds, or NULL unless all are above 1 and finite."""
    odds = [col(x) for x in (home, draw, away)]
    valid = reduce(lambda a, b: a & b, [(x > 1) & (x < float("inf")) for x in odds])
    inverse = [F.when(valid, 1.0 / x) for x in odds]
    total = inverse[0] + inverse[1] + inverse[2]
    return F.when(valid, F.struct(*[(i / total).alias(n) for i, n in zip(inverse, ("home", "draw", "away"))]))


def market_expected_score(home, draw, away) -> Column:
    p = market_probabilities(home, draw, away)
    return p["home"] + p["draw"] * 0.5


def expected_score(difference) -> Column:
    """Logistic expectation of a rating difference."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -col(difference) / 400.0))


def month_start(day) -> Column:
    return F.trunc(col(day), "MM").cast("date")


def log10_or_null(x) -> Column:
    return F.when(col(x) > 0, F.log10(col(x)))


def age_years(day, birth) -> Column:
    return F.datediff(col(day), col(birth)) / 365.25


def capped(x, most) -> Column:
    """The smaller of both, NULL where x is (``least`` alone would skip the NULL)."""
    return F.when(col(x).isNotNull(), F.least(col(x), F.lit(most)))


def guarded_ratio(num, den) -> Column:
    return F.when(col(den) > 0, col(num) / col(den))


def time_weight(day, reference, half_life_years: float | None) -> Column:
    """Half the weight for every half-life of age; 1 without a half-life."""
    if half_life_years is None:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.datediff(col(reference), col(day)) / 365.25 / half_life_years)


def not_in(x, values) -> Column:
    """True for NULL, unlike SQL's NOT IN."""
    return ~F.coalesce(col(x).isin(*values), F.lit(False))


def is_uefa(knockout, home_country, away_country) -> Column:
    """A knockout match is international; otherwise where countries differ or are unknown."""
    h, a = col(home_country), col(away_country)
    return F.when(col(knockout) == 1, True).otherwise(h.isNull() | a.isNull() | (h != a))


def compatible(model_country, country) -> Column:
    """An unknown model country fits every country."""
    return col(model_country).isNull() | (col(model_country) == col(country))


def lookup(x, table: dict) -> Column:
    """A literal dictionary; NULL for what is not in it."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), col(x))


def override(feature: str, values: dict[str, float], forbidden: frozenset = frozenset({"elo_diff", "mkt_elo_diff", "is_knockout", "is_uefa"})) -> Column:
    """A feature, or the caller's value for it; four features may not be set."""
    wrong = sorted(forbidden & values.keys())
    if wrong:
        raise ValueError(f"may not be set: {', '.join(wrong)}")
    return F.lit(float(values[feature])) if feature in values else F.col(feature)


# -- probabilities as three columns ------------------------------------------


def temperature(probabilities: list, t: float, floor: float = DEFAULT.probability_floor) -> list[Column]:
    """Softmax of the logs divided by a temperature, that is powers normalised."""
    raised = [F.exp(F.log(F.least(F.lit(1.0), F.greatest(col(p), F.lit(floor)))) / t) for p in probabilities]
    total = reduce(lambda a, b: a + b, raised)
    return [r / total for r in raised]


def combine(components: dict[str, list], weights: dict[str, float], t: float) -> list[Column]:
    """Weighted mean of the components' probabilities, normalised, then the temperature."""
    mixed = [reduce(lambda a, b: a + b, [col(p[k]) * weights[name] for name, p in components.items()]) for k in range(3)]
    total = reduce(lambda a, b: a + b, mixed)
    return temperature([m / total for m in mixed], t)


def argmax(probabilities: list) -> Column:
    """Index of the first greatest of the columns."""
    ps = F.array(*[col(p) for p in probabilities])
    return F.array_position(ps, F.array_max(ps)).cast("int") - 1
