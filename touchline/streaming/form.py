"""Form as a stream: each team's last results kept as state, rows out as matches arrive.

The batch log is the reference; a stream that gets matches in day order gives
the same values. Matches that arrive later than a row already seen of the team
are put in their place in the state, but rows given before stay as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.params import DEFAULT, Params

OUTPUT = "team string, day date, match_id long, form_after double"
STATE = "days array<long>, ids array<long>, points array<double>"


def stream_form(sides: DataFrame, params: Params = DEFAULT, gap_days: int | None = None) -> DataFrame:
    """``sides``: a streaming frame of team, day, match_id, points (see ``rolling.both_sides``)."""
    gap, window, least = gap_days or params.gap_days, params.form_window, params.form_min

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(zip(*state.get)) if state.exists else []
        out = []
        arrived = pd.concat(list(frames))
        arrived["n"] = (pd.to_datetime(arrived["day"]) - pd.Timestamp(0)).dt.days
        for row in arrived.sort_values(["n", "match_id"]).itertuples():
            seen = sorted([*seen, (int(row.n), int(row.match_id), float(row.points))])
            at = seen.index((int(row.n), int(row.match_id), float(row.points)))
            run = [seen[at]]
            for before in reversed(seen[:at]):
                if len(run) == window or run[-1][0] - before[0] > gap:
                    break
                run.append(before)
            out.append((key[0], row.day, int(row.match_id), sum(r[2] for r in run) / len(run) if len(run) >= least else None))
        seen = seen[-4 * window :]
        state.update(tuple(list(c) for c in zip(*seen)))
        yield pd.DataFrame(out, columns=["team", "day", "match_id", "form_after"])

    return sides.withColumn("team", sides["team"].cast("string")).groupBy("team").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
