"""The review fold as a stream: the state of each learner's card follows the reviews as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "interval_days int, ease double, reps int, lapses int, n_reviews long"
OUTPUT = f"user_id long, card_id int, {STATE}"


def advance(state: tuple, quality: int) -> tuple:
    """One review: (interval_days, ease, reps, lapses, n_reviews) after a grade of 0 to 5."""
    days, ease, reps, lapses, n = state
    if quality < 3:
        return 1, round(max(1.3, ease - 0.20), 4), 0, lapses + 1, n + 1
    miss = 5 - quality
    days = 1 if reps == 0 else 6 if reps == 1 else round(days * ease)
    return days, round(max(1.3, ease + (0.1 - miss * (0.08 + miss * 0.02))), 4), reps + 1, lapses, n + 1


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else (0, 2.5, 0, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # a card's reviews of one micro-batch
    for quality in rows["quality"]:
        now = advance(now, int(quality))
    state.update(now)
    yield pd.DataFrame([(*key, *now)], columns=["user_id", "card_id", "interval_days", "ease", "reps", "lapses", "n_reviews"])


def stream_reviews(reviews: DataFrame) -> DataFrame:
    """A stream (event_id, user_id, card_id, ts, quality) -> the new state of each card that a micro-batch holds.

    State is one small row a learner and card and is partitioned by both. Reviews of one micro-batch are taken in
    order of time; one that comes in a later micro-batch than it should counts when it comes.
    """
    keyed = reviews.withColumn("card_id", reviews["card_id"].cast("int")).groupBy("user_id", "card_id")
    return keyed.applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
