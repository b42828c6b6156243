"""All constants of the feature definitions, in one frozen record with a manifest hash."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from datetime import date


@dataclass(frozen=True)
class Params:
    """Fixed values of the feature definitions."""

    # rating engine
    elo_base: float = 1500.0
    elo_home_advantage: float = 55.0
    elo_stale_days: int = 400
    elo_provisional_matches: int = 10
    elo_provisional_mult: float = 2.0
    elo_newcomer_percentile: float = 25.0
    elo_newcomer_pool: int = 6
    elo_burn_in_passes: int = 3
    elo_burn_in_end: date = date(2014, 7, 1)
    k_grid: tuple = (5.0, 7.5, 10.0, 15.0, 20.0)
    uefa_mult_grid: tuple = (1.0, 2.0, 3.0, 4.0, 6.0)
    market_k_grid: tuple = (5.0, 10.0, 15.0, 20.0, 30.0)
    market_weight_grid: tuple = (0.5, 0.75, 1.0)
    # form
    form_window: int = 5
    form_min: int = 3
    gap_days: int = 200
    goals_window: int = 10
    goals_min: int = 5
    shots_window: int = 10
    shots_min: int = 5
    # squads and players
    squad_window_days: int = 180
    squad_top: int = 16
    squad_min: int = 11
    valuation_max_age: int = 540
    player_matches: int = 5
    xi_size: int = 11
    bench_size: int = 7
    xi_min_valued: int = 8
    bench_min_valued: int = 3
    player_gap_days: int = 200
    index_window_days: int = 365
    production_days: int = 365
    production_min_minutes: int = 900
    uefa_experience_days: int = 1095
    continuity_minutes: int = 45
    rest_cap: int = 30
    reference_countries: tuple = ("ENG", "ESP", "GER", "ITA", "FRA", "NED", "POR", "BEL", "TUR", "GRE", "SCO", "RUS", "UKR", "DEN")
    uefa_main: tuple = ("CL", "EL", "UCOL")
    # ensemble
    class_labels: tuple = ("home_win", "draw", "away_win")
    weights: dict = field(default_factory=lambda: {"classifier": 0.45, "logistic": 0.25, "poisson": 0.30})
    rho: float = -0.030443580996439037
    temperature: float = 0.9192906859117506
    max_goals: int = 10
    probability_floor: float = 1e-6
    # selection and gates
    cv_folds: int = 4
    selection_min_improvement: float = 3e-4
    retrain_age_days: int = 28
    retrain_gap_worse: float = 0.02
    retrain_min_matches: int = 300
    gate_slack: float = 0.01
    gate_baseline_margin: float = 0.03
    stale_data_days: int = 45
    lock_hours: float = 6.0
    seed: int = 42


DEFAULT = Params()

PLAYER_METRICS = ("xi_value", "xi_star", "bench_value", "att_value", "mid_value", "def_value", "gk_value", "xi_ga90", "xi_age", "xi_uefa_apps", "xi_last_match_share")


def _pair(*names: str) -> list[str]:
    return [f"{side}_{n}" for n in names for side in ("home", "away")]


#: All features in their fixed order, which is that of a model's input.
FEATURES = [
    "elo_diff", *_pair("form", "squad_value"), "is_knockout", "is_uefa", *_pair("xi_value"), "xi_value_diff",
    *_pair("xi_star", "bench_value", "att_value", "mid_value", "def_value", "gk_value", "xi_ga90", "xi_age", "xi_uefa_apps", "xi_last_match_share", "goals_for", "goals_against"),
    "mkt_elo_diff", *_pair("sot_share", "shot_share", "rest_days"),
]

#: Feature groups in the order in which a selection tries them; equal gains go to the earlier one.
FEATURE_GROUPS = {
    "base": ["elo_diff", "is_knockout", "is_uefa"],
    "market": ["mkt_elo_diff"],
    "shots": _pair("sot_share", "shot_share"),
    "form": _pair("form"),
    "squad_value": _pair("squad_value"),
    "xi_value": [*_pair("xi_value"), "xi_value_diff", *_pair("xi_star", "bench_value")],
    "lines": _pair("att_value", "mid_value", "def_value", "gk_value"),
    "production": _pair("xi_ga90"),
    "goals_form": _pair("goals_for", "goals_against"),
    "rest": _pair("rest_days"),
    "experience": _pair("xi_age", "xi_uefa_apps"),
    "continuity": _pair("xi_last_match_share"),
}


#: What each feature means; ``{side}`` features hold for the home and the away team. D is the match's day, T the day of the club's last game before D.
_SIDED = {
    "form": "mean points of the last {form_window} matches before D (at least {form_min}); a gap of more than {gap_days} days starts anew",
    "squad_value": "log10 of the sum of the {squad_top} greatest values of players seen in the {squad_window_days} days before D's month, less the reference countries' median",
    "xi_value": "log10 of the sum of the first eleven's values on T, less the value index of T's month; {xi_min_valued} values at least",
    "xi_star": "log10 of the greatest value of the first eleven, less the value index",
    "bench_value": "log10 of the sum of the values of the next {bench_size} players, less the value index; {bench_min_valued} values at least",
    "att_value": "as xi_value, attackers only",
    "mid_value": "as xi_value, midfielders only",
    "def_value": "as xi_value, defenders only",
    "gk_value": "as xi_value, goalkeepers only",
    "xi_ga90": "goals and assists of the first eleven for each 90 minutes in the {production_days} days up to T; {production_min_minutes} minutes at least",
    "xi_age": "mean age of the first eleven on T in years of 365.25 days",
    "xi_uefa_apps": "mean number of main international games of the first eleven in the {uefa_experience_days} days up to T",
    "xi_last_match_share": "share of the first eleven's value that played at least {continuity_minutes} minutes on T",
    "goals_for": "mean goals of the last {goals_window} matches before D (at least {goals_min})",
    "goals_against": "mean goals conceded in the last {goals_window} matches before D (at least {goals_min})",
    "sot_share": "share of shots on target over the last {shots_window} matches with shots before D (at least {shots_min})",
    "shot_share": "share of shots over the last {shots_window} matches with shots before D (at least {shots_min})",
    "rest_days": "days since the last match before D, {rest_cap} at most",
}
_WHOLE = {
    "elo_diff": "home rating + {elo_home_advantage} unless neutral - away rating, both before D and not older than {elo_stale_days} days",
    "mkt_elo_diff": "as elo_diff, of the ratings that learn from market odds",
    "is_knockout": "1 in a knockout round of a main international competition",
    "is_uefa": "1 in an international competition",
    "xi_value_diff": "home_xi_value - away_xi_value",
}


def definition(feature: str, params: Params = DEFAULT) -> str:
    text = _WHOLE[feature] if feature in _WHOLE else f"{feature.split('_')[0]} team: " + _SIDED[feature.split("_", 1)[1]]
    return text.format(**asdict(params))


def contract(columns: list[str], rating: dict, ensemble: dict, params: Params = DEFAULT) -> dict:
    """What a model and a feature store must agree on. An unknown column is an error."""
    unknown = [c for c in columns if c not in FEATURES]
    if unknown:
        raise ValueError(f"no such feature: {', '.join(unknown)}")
    group = {f: g for g, fs in FEATURE_GROUPS.items() for f in fs}
    features = [{"name": c, "type": "double", "group": group[c], "definition": definition(c, params)} for c in columns]
    return {"columns": columns, "features": features, "params": json.loads(json.dumps(asdict(params), default=str)), "rating": rating, "ensemble": ensemble, "classes": list(params.class_labels)}


def contract_hash(value: dict) -> str:
    """SHA-256 of the canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
