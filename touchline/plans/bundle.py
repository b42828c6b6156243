"""Fitted models as one bundle on disk, and the predictor that answers for single fixtures and whole frames."""

from __future__ import annotations

import json
import platform
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.functions import scalar
from touchline.operators import identity, metrics, models
from touchline.operators.checks import SchemaMismatch, UnknownTeam, frame_contract
from touchline.params import DEFAULT, FEATURES, Params, contract, contract_hash
from touchline.plans import export
from touchline.plans.store import Store


def versions() -> dict[str, str]:
    """Versions of what a fitted model depends on."""
    import numpy
    import pandas
    import pyarrow
    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "pandas": pandas.__version__, "numpy": numpy.__version__}


@dataclass
class Bundle:
    """Components by name, what combines them, and the contract they were fitted under."""

    components: dict[str, models.Fitted]
    ensemble: dict
    rating: dict
    columns: list[str]
    about: dict = field(default_factory=dict)
    params: Params = DEFAULT

    def contract(self) -> dict:
        return contract(self.columns, self.rating, self.ensemble, self.params)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        for name, c in self.components.items():
            c.save(f"{path}/{name}")
        manifest = {"contract": self.contract(), "hash": contract_hash(self.contract()), "components": list(self.components), "versions": versions(), **self.about}
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True, default=str),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    def predict(self, features: DataFrame) -> DataFrame:
        """Final probabilities of a frame of features; rows without a rating difference get NULLs."""
        frame_contract(features.select(*self.columns), self.columns)
        return export.predict(features, self.components, self.params, self.ensemble["weights"], self.ensemble["temperature"])


def load(spark: SparkSession, path: str, params: Params = DEFAULT) -> Bundle:
    """A saved bundle, if it keeps the contract of this code; what differs without breaking it is in ``about["warnings"]``."""
    m = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    kept = m["contract"]
    if contract_hash(kept) != m["hash"]:
        raise SchemaMismatch("the manifest does not fit its hash")
    if kept["classes"] != list(params.class_labels):
        raise SchemaMismatch(f"order of classes: {kept['classes']}")
    now = json.loads(json.dumps(contract(kept["columns"], kept["rating"], kept["ensemble"], params)))
    changed = [k for k in now if now[k] != kept[k]]
    if changed:
        raise SchemaMismatch(f"changed since the fit: {', '.join(changed)}")
    components = {n: models.load_component(spark, f"{path}/{n}") for n in m["components"]}
    strange = [n for n, c in components.items() if c.columns != kept["columns"]]
    if strange:
        raise SchemaMismatch(f"other columns than the manifest's: {', '.join(strange)}")
    warnings = [f"{k}: fitted with {v}, here {versions().get(k)}" for k, v in m["versions"].items() if versions().get(k) != v]
    about = {k: v for k, v in m.items() if k not in ("contract", "components")} | {"warnings": warnings}
    return Bundle(components, kept["ensemble"], kept["rating"], kept["columns"], about, params)


def fit(rows: DataFrame, components: dict[str, object], test_from: date, ensemble: dict, rating: dict, refit_all: bool = False, params: Params = DEFAULT) -> tuple[Bundle, DataFrame]:
    """Fits on what lies before ``test_from`` and measures on the rest: the bundle, and metrics of each component and the ensemble by subset.

    With ``refit_all`` the bundle is then fitted again on all rows; the metrics are those of the first fit.
    ``rows``: features, d, target, home_goals, away_goals; with ``competition``, main international games are a subset of
    their own. ``components``: name to what has ``fit``.
    """
    columns = next(iter(components.values())).columns
    before, after = rows.where(F.col("d") < F.lit(test_from)), rows.where(F.col("d") >= F.lit(test_from))

    def fitted(frame: DataFrame, reference: date) -> Bundle:
        last = frame.agg(F.max("d").alias("d")).first()["d"]
        about = {"trained_at": datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"), "data_end": str(last), "test_from": str(test_from), "refit_all": refit_all}
        return Bundle({n: c.fit(frame, reference) for n, c in components.items()}, ensemble, rating, columns, about, params)

    first = fitted(before, test_from)
    share = before.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in share)
    naive = {r["target"]: r["n"] / total for r in share}
    scored = after
    for c in first.components.values():
        scored = c(scored)
    mixed = scalar.combine({n: [f"{n}_{k}" for k in range(3)] for n in components}, ensemble["weights"], ensemble["temperature"])
    named = {**{n: [F.col(f"{n}_{k}") for k in range(3)] for n in components}, "ensemble": mixed, "class_frequencies": [F.lit(float(naive.get(k, 0.0))) for k in range(3)]}
    told = [c for c in ("target", "is_uefa", "is_knockout", "competition") if c in rows.columns]
    long = scored.select(*told, F.inline(F.array(*[F.struct(F.lit(n).alias("model"), *[p.alias(f"p{k}") for k, p in enumerate(ps)]) for n, ps in named.items()])))
    masks = {"all": F.lit(True), "domestic": F.col("is_uefa") == 0, "uefa": F.col("is_uefa") == 1, "knockout": F.col("is_knockout") == 1}
    if "competition" in rows.columns:
        masks["uefa_main"] = F.col("competition").isin(*params.uefa_main)
    measured = metrics.subsets(long, masks).groupBy("model", "subset").agg(*metrics.evaluation("target", ["p0", "p1", "p2"]))
    if refit_all:
        last = rows.agg(F.max("d").alias("d")).first()["d"]
        return fitted(rows, last + timedelta(days=1)), measured
    return first, measured


@dataclass
class Predictor:
    """A bundle, the store that its features come from, and the teams: ``aliases`` (key, alias), ``clubs`` (key, display, country)."""

    bundle: Bundle
    store: Store
    aliases: DataFrame
    clubs: DataFrame

    def __post_init__(self) -> None:
        if {k: float(v) for k, v in self.store.rating.items()} != {k: float(v) for k, v in self.bundle.rating.items()}:
            raise SchemaMismatch(f"the store's ratings have other parameters: {self.store.rating}, the model's {self.bundle.rating}")

    def resolve_teams(self, names: list[str]) -> list[str]:
        """Keys of names; one that no team, or more than one, answers to is an error with candidates."""
        spark = self.clubs.sparkSession
        asked = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "query string")
        found = {r["query"]: r for r in identity.resolve(asked, self.aliases, self.clubs.select("key", "display")).collect()}
        lost = [f"{n}: {found[n.strip()]['method']}, candidates {found[n.strip()]['suggestions'] or []}" for n in names if found[n.strip()]["key"] is None]
        if lost:
            raise UnknownTeam("; ".join(lost))
        return [found[n.strip()]["key"] for n in names]

    def features_for(self, home: str, away: str, day: date, neutral: bool = False, is_knockout: bool = False, is_uefa: bool | None = None, overrides: dict[str, float] | None = None) -> DataFrame:
        """The one row of features of a fixture. ``overrides`` sets features of the model by hand; what follows from them is worked out anew."""
        spark = self.clubs.sparkSession
        keys = self.resolve_teams([home, away])
        row = spark.createDataFrame([(0, day, *keys, float(neutral), float(is_knockout))], "match_id long, d date, home_key string, away_key string, neutral double, is_knockout double")
        for side in ("home", "away"):
            of = self.clubs.select(F.col("key").alias(f"{side}_key"), F.col("display").alias(f"{side}_club"), F.col("country").alias(f"_{side}_of"))
            row = row.join(of, f"{side}_key", "left")
        told = scalar.is_uefa("is_knockout", "_home_of", "_away_of") if is_uefa is None else F.lit(is_uefa)
        row = row.withColumn("is_uefa", told.cast("double")).drop("_home_of", "_away_of")
        features = self.store.compute(row)
        return override_all(features, overrides or {}, self.bundle.columns)

    def predict(self, home: str, away: str, day: date, **more) -> dict[str, float]:
        """Probabilities of one fixture; without a rating there is no prediction, but an error."""
        got = self.bundle.predict(self.features_for(home, away, day, **more)).first()
        if got["elo_missing"]:
            old = [got[f"{s}_club"] for s in ("home", "away") if got[f"{s}_elo"] is None]
            raise ValueError(f"no rating on {day}: {', '.join(map(str, old))}")
        return {label: got[label] for label in self.bundle.params.class_labels}

    def predict_many(self, fixtures: DataFrame) -> DataFrame:
        """Final probabilities, expected goals and ``elo_missing`` of fixtures by key."""
        return self.bundle.predict(self.store.compute(fixtures))


def override_all(features: DataFrame, values: dict[str, float], columns: list[str] = FEATURES) -> DataFrame:
    """Features with a caller's values; a difference of line-up values follows its parts unless it is set itself."""
    strange = sorted(set(values) - set(columns))
    if strange:
        raise SchemaMismatch(f"no features of the model: {', '.join(strange)}")
    out = features.withColumns({f: scalar.override(f, values) for f in values})
    if "xi_value_diff" not in values and {"home_xi_value", "away_xi_value"} & values.keys():
        out = out.withColumn("xi_value_diff", F.col("home_xi_value") - F.col("away_xi_value"))
    return out
