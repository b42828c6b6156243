"""Competitions and country codes of the sources. Fixed values, in the sources' order."""

#: Country names of the player platform.
COUNTRY_CODES = {
    "England": "ENG", "Scotland": "SCO", "Germany": "GER", "Italy": "ITA", "Spain": "ESP",
    "France": "FRA", "Netherlands": "NED", "Belgium": "BEL", "Portugal": "POR",
    "Türkiye": "TUR", "Turkey": "TUR", "Greece": "GRE", "Russia": "RUS", "Ukraine": "UKR",
    "Denmark": "DEN", "Austria": "AUT", "Switzerland": "SUI", "Poland": "POL",
    "Romania": "ROU", "Croatia": "CRO", "Czech Republic": "CZE", "Serbia": "SRB",
    "Norway": "NOR", "Sweden": "SWE",
}

#: Leagues with a file for each season, and their countries; first divisions, then second ones.
MAIN_LEAGUES = {
    "E0": "ENG", "SC0": "SCO", "D1": "GER", "I1": "ITA", "SP1": "ESP", "F1": "FRA", "N1": "NED", "B1": "BEL", "P1": "POR", "T1": "TUR", "G1": "GRE",
    "E1": "ENG", "SC1": "SCO", "D2": "GER", "I2": "ITA", "SP2": "ESP", "F2": "FRA",
}
SECOND_TIER = {"E1", "SC1", "D2", "I2", "SP2", "F2"}

#: Leagues with one file for all seasons.
EXTRA_LEAGUES = {"AUT": "AUT", "DNK": "DEN", "FIN": "FIN", "IRL": "IRL", "NOR": "NOR", "POL": "POL", "ROU": "ROU", "RUS": "RUS", "SWE": "SWE", "SWZ": "SUI"}

#: Countries whose leagues the results source covers; the platform's matches of them are left out.
COVERED = tuple(dict.fromkeys([*MAIN_LEAGUES.values(), *EXTRA_LEAGUES.values()]))

UEFA_MAIN = ("CL", "EL", "UCOL")
UEFA_QUALIFYING = ("CLQ", "ELQ", "ECLQ")

#: Bookmakers' column prefixes, best first: closing odds before earlier ones.
ODDS_PREFIXES = ("PSC", "AvgC", "B365C", "Avg", "BbAv", "B365", "PS")


def tier(league: str) -> int:
    return 2 if league in SECOND_TIER else 1
