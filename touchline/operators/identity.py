"""Team identity across two match sources: co-occurrence, aliases, tiered names, conflicts, resolution.

Team dimensions are small next to matches (one row for each club and name), but
every step is a join or a window, so none of them is collected. Names meet only
the clubs they share a piece of spelling with; the pieces are chosen so that no
pair that a tier accepts is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from touchline.functions.names import CUTOFF, normalise, prefix_match, similarity, similarity_from, substring_match
from touchline.functions.scalar import compatible
from touchline.session import checkpointed

#: Tiers in the order in which they are tried.
TIERS = ("normalized", "prefix", "substring", "fuzzy")


def cooccurrence(left: DataFrame, right: DataFrame, least: int = 3, dominance: int = 3, parts: int | None = None) -> DataFrame:
    """``country, name, club_id, n``: names and clubs whose matches share country, day and score often, and far oftener than any other club's.

    ``left``: country, d, home_goals, away_goals, home_team, away_team. ``right``: the same with home_id, away_id.
    A name and a club meet as often as the product of their matches of one country, day, score and side, so both are
    counted there before they meet. Pairs are summed where they arise, which suits few names. Many names have hardly a
    pair twice: with ``parts`` a name is dealt into so many partitions with the clubs it meets, and its pairs are made there.
    """
    keys = ["country", "d", "home_goals", "away_goals", "side"]

    def counted(matches: DataFrame, what: str, of: str) -> DataFrame:
        sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_{of}").alias(what)) for s in ("home", "away")])
        return matches.select(*keys[:-1], F.inline(sides)).groupBy(*keys, what).agg(F.count(F.lit(1)).alias(f"{what}_n"))

    names, clubs = counted(left, "name", "team"), counted(right, "club_id", "id")
    if parts is None:
        pairs = names.join(clubs, keys)
    else:
        met = clubs.groupBy(*keys).agg(F.collect_list(F.struct("club_id", "club_id_n")).alias("met"))
        pairs = names.join(met, keys).select("country", "name", "name_n", "met").repartition(parts, "country", "name").select("country", "name", "name_n", F.inline_outer("met"))
    counts = pairs.groupBy("country", "name", "club_id").agg(F.sum(F.col("name_n") * F.col("club_id_n")).alias("n"))
    w = Window.partitionBy("country", "name").orderBy(F.desc("n"), "club_id")
    ranked = counts.withColumn("rank", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("n").over(w), F.lit(0)))
    return ranked.where((F.col("rank") == 1) & (F.col("n") >= least) & (F.col("n") >= dominance * F.col("second"))).select("country", "name", "club_id", "n")


def latest_names(sightings: DataFrame, clubs: DataFrame | None = None) -> DataFrame:
    """``club_id, name``: the club table's name, else the last one seen by day."""
    seen = sightings.where("club_id is not null").groupBy("club_id").agg(F.max_by("name", F.struct("d", "name")).alias("seen"))
    if clubs is None:
        return seen.withColumnRenamed("seen", "name")
    known = clubs.select("club_id", F.col("name").alias("known"))
    return seen.join(known, "club_id", "full").select("club_id", F.coalesce("known", "seen").alias("name"))


def club_countries(clubs: DataFrame, domestic: DataFrame) -> DataFrame:
    """``club_id, country``: the club table's country, else that of the club's first domestic match (club_id, country, d)."""
    first = domestic.where("club_id is not null").groupBy("club_id").agg(F.min_by("country", F.struct("d", "country")).alias("played"))
    known = clubs.select("club_id", F.col("country").alias("known"))
    return known.join(first, "club_id", "full").select("club_id", F.coalesce("known", "played").alias("country"))


def alias_keys(names: DataFrame, aliases: DataFrame, display: DataFrame) -> DataFrame:
    """``country, name, key`` for names that an alias row sets. ``aliases``: alias, target, country, row (later rows win).

    A target is a key (``tm:..``, ``fd:..``) or a display name that one club has.
    """
    unique = display.groupBy(F.lower("display").alias("low")).agg(F.min("key").alias("found"), F.count_distinct("key").alias("n")).where("n = 1")
    is_key = F.col("target").startswith("tm:") | F.col("target").startswith("fd:")
    targeted = aliases.join(unique, F.lower("target") == F.col("low"), "left").withColumn("key", F.when(is_key, F.col("target")).otherwise(F.col("found"))).where("key is not null")
    # the last row of each alias and country is all that can win
    targeted = targeted.groupBy("alias", "country").agg(F.max_by("key", "row").alias("key"), F.max("row").alias("row"))
    hit = names.alias("n").join(targeted.alias("a"), (F.col("n.name") == F.col("a.alias")) & (F.col("a.country").isNull() | (F.col("a.country") == F.col("n.country"))))
    return hit.groupBy("n.country", "n.name").agg(F.max_by("a.key", "a.row").alias("key"))


def _grams(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substr(text, k, F.lit(n)))


def _pieces(norm: Column, longer: bool) -> Column:
    """Pieces of a normal form by which both sides of a pair meet; ``longer`` is where the other's beginning may be inside.

    Equal forms share ``=``, forms of which one begins the other share three
    letters, forms of which one (of five letters at least) is inside the other
    share the inner one's first five. Forms that are similar (0.88) differ in so few letters that the
    longest stretch they share has three, or two where both are short.
    """
    tagged = lambda tag, xs: F.transform(xs, lambda x: F.concat(F.lit(tag), x))
    none = F.array().cast("array<string>")
    n = F.length(norm)
    inside = F.when(n >= 5, tagged("i" if longer else "h", _grams(norm, 5))).otherwise(none)
    head = F.when(n >= 5, F.array(F.concat(F.lit("h" if longer else "i"), F.substring(norm, 1, 5)))).otherwise(none)
    begin = F.when(n >= 3, F.array(F.concat(F.lit("b"), F.substring(norm, 1, 3)))).otherwise(none)
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("="), norm)), begin, inside, head))


def _close_pieces(norm: Column) -> Column:
    none = F.array().cast("array<string>")
    three = F.when(F.length(norm) >= 3, _grams(norm, 3)).otherwise(none)
    two = F.when(F.length(norm).between(2, 5), _grams(norm, 2)).otherwise(none)
    return F.array_distinct(F.concat(F.array(norm), three, two))


def _clubs(names: DataFrame, pool: DataFrame, reference_countries: tuple | None, taken: DataFrame | None = None) -> DataFrame:
    """``key, pool_norm, country``: clubs of a country, or of an unknown one where names of that country may use them.

    Clubs in ``taken`` (country, key) are no candidates there.
    """
    unknown = "?"
    may = F.lit(True) if reference_countries is None else ~F.col("country").isin(*reference_countries)
    countries = names.select("country").distinct().withColumn("_c", F.explode(F.when(may, F.array("country", F.lit(unknown))).otherwise(F.array("country"))))
    clubs = pool.select("key", normalise("display").alias("pool_norm"), F.coalesce("country", F.lit(unknown)).alias("_c")).where("pool_norm <> ''").join(countries, "_c").drop("_c")
    return clubs if taken is None else clubs.join(taken.select("country", "key").distinct(), ["country", "key"], "left_anti")


def _candidates(names: DataFrame, clubs: DataFrame, close: bool = False) -> DataFrame:
    """Names and the forms of clubs they share a piece with, with the least (``key``) and the greatest (``most``) key of each form.

    The two keys differ where several clubs answer, which is all that the tiers ask; so pairs grow with the different forms alone.
    """
    forms = clubs.groupBy("country", "pool_norm").agg(F.min("key").alias("key"), F.max("key").alias("most"))
    keyed = names.select("country", "name", normalise("name").alias("norm")).where("norm <> ''")
    mine, theirs = (_close_pieces(F.col("norm")), _close_pieces(F.col("pool_norm"))) if close else (_pieces(F.col("norm"), True), _pieces(F.col("pool_norm"), False))
    return keyed.withColumn("_p", F.explode(mine)).join(forms.withColumn("_p", F.explode(theirs)), ["country", "_p"]).select("country", "name", "norm", "pool_norm", "key", "most").distinct()


def _pairs(names: DataFrame, pool: DataFrame, reference_countries: tuple | None, taken: DataFrame | None = None, close: bool = False) -> DataFrame:
    """The candidates with every club of their form."""
    clubs = _clubs(names, pool, reference_countries, taken)
    return _candidates(names, clubs, close).drop("key", "most").join(clubs, ["country", "pool_norm"])


def tiered_match(names: DataFrame, pool: DataFrame, reference_countries: tuple | None = None, fuzzy: bool = True, taken: DataFrame | None = None) -> DataFrame:
    """``country, name, key, method`` for each name: the first tier with a hit decides, if it has exactly one.

    ``pool``: key, display, country. Tiers: equal, prefix, substring and, where
    all of them are empty, similarity (of the best two normal forms, one may pass).
    ``taken``: country, key of clubs that are no candidates in that country.
    """
    clubs = _clubs(names, pool, reference_countries, taken)
    pairs = _candidates(names, clubs)
    tests = {"normalized": F.col("norm") == F.col("pool_norm"), "prefix": prefix_match(F.col("norm"), F.col("pool_norm")), "substring": substring_match(F.col("norm"), F.col("pool_norm"))}
    tier = F.array_min(F.array(*[F.when(t, k) for k, t in enumerate(tests.values())]))
    # each test counts on its own: a prefix hit may also be among the substring hits of a later tier
    counts = pairs.groupBy("country", "name").agg(
        F.min(tier).alias("tier"),
        *[F.min(F.when(t, F.col("key"))).alias(f"key{k}") for k, t in enumerate(tests.values())],
        *[F.max(F.when(t, F.col("most"))).alias(f"other{k}") for k, t in enumerate(tests.values())],
    )
    at = lambda what: F.array(*[F.col(f"{what}{k}") for k in range(3)])
    label = F.get(F.array(*[F.lit(x) for x in TIERS[:3]]), F.col("tier"))
    one = F.get(at("key"), F.col("tier")) == F.get(at("other"), F.col("tier"))
    decided = counts.where("tier is not null").select(
        "country", "name", F.when(one, F.get(at("key"), F.col("tier"))).alias("key"), F.when(one, label).otherwise(F.concat(F.lit("ambiguous_"), label)).alias("method")
    )
    if fuzzy:
        still_open = names.select("country", "name").join(counts.where("tier is not null").select("country", "name"), ["country", "name"], "left_anti")
        decided = decided.unionByName(fuzzy_match(_candidates(still_open, clubs, close=True)))
    return names.select("country", "name").join(decided, ["country", "name"], "left").select("country", "name", "key", F.coalesce("method", F.lit("unresolved")).alias("method"))


def fuzzy_match(pairs: DataFrame) -> DataFrame:
    """Names of which exactly one normal form is close, and that one is of one club."""
    # lengths alone rule most pairs out, before any Python runs; the same division as the ratio's
    a, b = F.length("pool_norm"), F.length("norm")
    long_enough = F.lit(2.0) * F.least(a, b) / (a + b) >= CUTOFF
    close = pairs.where(long_enough).withColumn("ratio", similarity_from(CUTOFF)("pool_norm", "norm")).where(F.col("ratio") >= CUTOFF)
    found = close.groupBy("country", "name").agg(F.count_distinct("pool_norm").alias("forms"), F.max("most").alias("other"), F.min("key").alias("key"))
    return found.where("forms = 1 and key = other").select("country", "name", "key", F.lit("fuzzy").alias("method"))


def settle_conflicts(matched: DataFrame) -> DataFrame:
    """Of different names of a country on one club only the best (tier, name) keeps it; equal normal forms share it.

    The others get a key of their own. ``country, name, key, method``.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("method"))
    norm = normalise("name")
    w = Window.partitionBy("country", "key").orderBy(rank, "name")
    own = F.concat(F.lit("fd:"), "country", F.lit(":"), norm)
    hit = matched.where("key is not null").withColumn("best", F.first(norm).over(w)).withColumn("n", F.row_number().over(w))
    kept = (F.col("n") == 1) | (F.col("best") == norm)
    won = hit.select("country", "name", F.when(kept, F.col("key")).otherwise(own).alias("key"), F.when(kept, F.concat(F.lit("name_"), "method")).otherwise("conflict_lost").alias("method"))
    lost = matched.where("key is null").select("country", "name", own.alias("key"), "method")
    return won.unionByName(lost)


def team_keys(names: DataFrame, co: DataFrame, aliases: DataFrame, pool: DataFrame, reference_countries: tuple) -> DataFrame:
    """``country, name, key, method`` of every name: alias, else co-occurrence, else a tiered match among the clubs that no name of the country has taken by either."""
    found = co.select("country", "name", F.concat(F.lit("tm:"), F.col("club_id").cast("string")).alias("key"), F.lit("cooccurrence").alias("method"))
    aliased = alias_keys(names, aliases, pool).withColumn("method", F.lit("alias"))
    aliased = checkpointed(aliased)
    # both are read several times by what follows
    first = checkpointed(aliased.unionByName(found.join(aliased, ["country", "name"], "left_anti")))
    rest = checkpointed(names.select("country", "name").join(first, ["country", "name"], "left_anti"))
    return first.unionByName(settle_conflicts(tiered_match(rest, pool, reference_countries, taken=first)))


def known_names(keys: DataFrame, sightings: DataFrame, clubs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``key, names``: every name that stands for a key, sorted.

    ``keys``: country, name, key as ``team_keys`` gives them. ``sightings``: club_id, name. ``clubs``: key, display.
    ``aliases``: alias, target; a target that is a display name counts if one club has it.
    """
    every = keys.select("key", "name").unionByName(sightings.where("club_id is not null").select(F.concat(F.lit("tm:"), F.col("club_id").cast("string")).alias("key"), "name")).unionByName(clubs.select("key", F.col("display").alias("name")))
    if aliases is not None:
        unique = clubs.groupBy(F.lower("display").alias("low")).agg(F.min("key").alias("found"), F.count_distinct("key").alias("n")).where("n = 1")
        is_key = F.col("target").startswith("tm:") | F.col("target").startswith("fd:")
        told = aliases.join(unique, F.lower("target") == F.col("low"), "left").select(F.when(is_key, F.col("target")).otherwise(F.col("found")).alias("key"), F.col("alias").alias("name"))
        every = every.unionByName(told)
    return every.where("key is not null and name is not null").groupBy("key").agg(F.sort_array(F.collect_set("name")).alias("names"))


def filled(keys: DataFrame, clubs: DataFrame) -> DataFrame:
    """``key, display, country`` of every key: the club's, else the least name that has the key, and that name's country."""
    own = keys.groupBy("key").agg(F.min(F.struct("name", "country")).alias("first"))
    known = clubs.groupBy("key").agg(F.min("display").alias("shown"), F.min("country").alias("of"))
    return own.join(known, "key", "full").select("key", F.coalesce("shown", F.col("first.name")).alias("display"), F.coalesce("of", F.col("first.country")).alias("country"))


def resolve(queries: DataFrame, aliases: DataFrame, display: DataFrame, suggest: int = 5) -> DataFrame:
    """``query, key, method, suggestions``: a key, an exact name, a normal form, a tiered match, else the most similar names.

    ``queries``: query. ``aliases``: key, alias. ``display``: key, display.
    """
    asked = queries.select(F.trim("query").alias("query")).distinct().withColumn("low", F.lower("query")).withColumn("norm", normalise("query"))
    by_key = asked.join(display, asked["query"] == display["key"]).select("query", "key", F.lit("key").alias("method"), F.lit(0).alias("step"), F.lit(1).alias("n"))
    names = aliases.select("key", F.lower(F.trim("alias")).alias("low"), normalise("alias").alias("norm"))
    steps = [by_key]
    for step, (column, method) in enumerate((("low", "exact"), ("norm", "normalized")), 1):
        # whether one key answers or several is all that is asked, so a spelling goes on with its least and greatest key
        spelled = names.groupBy(column).agg(F.min("key").alias("key"), F.max("key").alias("most"))
        hits = asked.join(spelled, column).groupBy("query").agg(F.min("key").alias("key"), F.max("most").alias("most"))
        steps.append(hits.select("query", "key", F.lit(method).alias("method"), F.lit(step).alias("step"), F.when(F.col("key") == F.col("most"), 1).otherwise(2).alias("n")))
    matched = tiered_match(asked.select(F.lit("*").alias("country"), F.col("query").alias("name")), display.withColumn("country", F.lit("*")))
    steps.append(matched.where("key is not null").select(F.col("name").alias("query"), "key", "method", F.lit(3).alias("step"), F.lit(1).alias("n")))
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    best = every.groupBy("query").agg(F.min_by(F.struct("key", "method", "n"), "step").alias("hit"))
    out = asked.select("query").join(best, "query", "left")
    out = out.select("query", F.when(F.col("hit.n") == 1, F.col("hit.key")).alias("key"), F.when(F.col("hit.n") == 1, F.col("hit.method")).when(F.col("hit.n") > 1, "ambiguous").otherwise("unresolved").alias("method"))
    # read several times by what follows
    out = checkpointed(out)
    lost = out.where("key is null").select("query")
    if not lost.limit(1).count():
        return out.withColumn("suggestions", F.lit(None).cast("array<string>"))
    return out.join(suggestions(lost, display, suggest), "query", "left")


def suggestions(missing: DataFrame, display: DataFrame, most: int = 5) -> DataFrame:
    """``query, suggestions``: the most similar names, as 'display (key)'; those that share two letters in a row go first.

    With a ``country`` in ``missing`` and ``display``, names of that country or of none. A query that has fewer than
    ``most`` such names gets the rest from names that share a letter, then from the first ones by spelling.
    """
    by = [c for c in ("country",) if c in missing.columns]
    asked = missing.select("query", *by).distinct()
    shown = display.select("key", "display", *[F.col(c).alias("_of") for c in by]).distinct()
    # names of one spelling are equally similar and then go by key: no more than the first ``most`` keys can be told
    same = Window.partitionBy("display", *[F.col("_of") for _ in by]).orderBy("key")
    shown = checkpointed(shown.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= most).drop("_n"))

    def met(ask: DataFrame, n: int) -> DataFrame:
        pieces = lambda c: F.explode(F.array_distinct(_grams(F.concat(F.lit(" "), F.lower(c)), n))).alias("_p")
        left, right = ask.select("*", pieces(F.col("query"))), shown.select("*", pieces(F.col("display")))
        found = left.where("_p <> ' '").join(right, "_p").drop("_p")
        return (found.where(compatible("_of", "country")) if by else found).select("query", *by, "key", "display").distinct()

    close = checkpointed(met(asked, 2))
    enough = close.groupBy("query", *by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most)
    short = asked.join(enough.select("query", *by), ["query", *by], "left_anti")
    first = Window.partitionBy(*[F.col("_of") for _ in by]).orderBy("display", "key") if by else None
    some = shown.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n") if by else shown.orderBy("display", "key").limit(most)
    any_name = short.join(some, compatible("_of", "country")) if by else short.join(some)
    far = met(short, 1).unionByName(any_name.select("query", *by, "key", "display")).distinct().join(close, ["query", *by, "key", "display"], "left_anti")
    scored = close.withColumn("group", F.lit(0)).unionByName(far.withColumn("group", F.lit(1))).withColumn("ratio", similarity(F.lower("query"), F.lower("display")))
    w = Window.partitionBy("query", *by).orderBy("group", F.desc("ratio"), "display", "key")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return top.groupBy("query", *by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat("display", F.lit(" ("), "key", F.lit(")")).alias("text")))), lambda x: x.text).alias("suggestions"))


def country_mapping(wanted: DataFrame, aliases: DataFrame, clubs: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """``competition, name, country, key, method, suggestions`` of the teams of a competition; a match of another country is never taken.

    ``wanted``: competition, name, country. ``aliases``: key, alias. ``clubs``: key, display, country (unknown fits all).
    ``manual``: competition, name, key and, where there, method; such rows go first. Else the name is resolved among
    all clubs, then by its form among the clubs of the country or of none.
    """
    of = clubs.select("key", F.col("country").alias("_of"))
    found = resolve(wanted.select(F.col("name").alias("query")), aliases, clubs.select("key", "display")).select(F.col("query").alias("_q"), "key", F.concat(F.lit("auto_"), "method").alias("method")).where("key is not null").join(of, "key", "left")
    asked = wanted.select("competition", "name", "country").distinct().withColumn("_q", F.trim("name"))
    whole = asked.join(found, "_q").where(compatible("_of", "country")).select("competition", "name", "country", "key", "method")
    rest = asked.join(whole, ["competition", "name", "country"], "left_anti")
    near = tiered_match(rest.select("country", "name").distinct(), clubs.where(F.col("key").startswith("tm:")))
    near = near.where("key is not null").select("country", "name", "key", F.concat(F.lit("auto_country_"), "method").alias("method"))
    auto = whole.unionByName(rest.select("competition", "name", "country").join(near, ["country", "name"]).select("competition", "name", "country", "key", "method"))
    if manual is not None:
        method = F.coalesce("method", F.lit("manual")) if "method" in manual.columns else F.lit("manual")
        told = manual.where("key is not null").select("competition", "name", "key", method.alias("method"))
        own = asked.select("competition", "name", "country").join(told, ["competition", "name"]).select("competition", "name", "country", "key", "method")
        auto = own.unionByName(auto.join(told.select("competition", "name"), ["competition", "name"], "left_anti"))
    out = asked.select("competition", "name", "country").join(auto, ["competition", "name", "country"], "left")
    hints = suggestions(out.where("key is null").select(F.col("name").alias("query"), "country"), clubs.where(F.col("key").startswith("tm:")))
    hints = hints.withColumnRenamed("query", "name")
    told = out.select("competition", "name", "country", "key", F.coalesce("method", F.lit("unresolved")).alias("method"))
    return told.join(hints, ["name", "country"], "left").select("competition", "name", "country", "key", "method", "suggestions")


def checked_mapping(mapping: DataFrame, clubs: DataFrame) -> DataFrame:
    """The mapping, if every key is a club's and serves one name of a competition; else an error that lists what is wrong."""
    strange = mapping.where("key is not null").join(clubs.select("key"), "key", "left_anti").select("competition", "name", "key").limit(20).collect()
    if strange:
        raise ValueError("no such key: " + ", ".join(f"{r['competition']}: {r['name']} -> {r['key']}" for r in strange))
    twice = repeated(mapping).limit(20).collect()
    if twice:
        raise ValueError("one club for several names: " + ", ".join(f"{r['competition']}: {r['key']} ({r['n']})" for r in twice))
    return mapping


def apply_manual(names: DataFrame, manual: DataFrame, automatic: DataFrame) -> DataFrame:
    """``competition, name, key, method``: a manual row goes first. A key that serves two names of a competition is an error (see ``repeated``)."""
    m = manual.select("competition", "name", F.col("key").alias("manual"))
    a = automatic.select("competition", "name", F.col("key").alias("auto"), "method")
    out = names.join(m, ["competition", "name"], "left").join(a, ["competition", "name"], "left")
    return out.select("competition", "name", F.coalesce("manual", "auto").alias("key"), F.when(F.col("manual").isNotNull(), "manual").otherwise(F.col("method")).alias("method"))


def repeated(mapping: DataFrame) -> DataFrame:
    return mapping.where("key is not null").groupBy("competition", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
