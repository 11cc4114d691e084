"""Weak supervision over vote patterns: rules say +1, -1 or 0 (abstain); expectation-maximisation finds their reliabilities.

The number of distinct patterns is at most 3**rules whatever the number of rows, so the pattern counts, which
cover all rows, are small enough for the driver by construction; rows never go there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encode(votes: np.ndarray) -> np.ndarray:
    """One integer for each row of votes: base-3 digits, vote + 1."""
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


def decode(codes: np.ndarray, rules: int) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(rules, dtype=np.int64)) % 3 - 1


def pattern_counts(rows: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vote codes of all rows and how often each occurs, in the codes' order. At most 3**rules of them."""
    got = sorted(
        (r[0], r[1]) for r in rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1))).collect()
    )
    return np.array([c for c, _ in got], np.int64), np.array([n for _, n in got], np.float64)


#: Outcome shares (-1, abstain, +1) from which the fit starts, for the negative and the positive class.
START = np.array([[0.30, 0.30, 0.40], [0.03, 0.27, 0.70]])


@dataclass
class VoteModel:
    """share: of the positive class. odds[j, c, v + 1]: probability that rule j says v (0: abstains) on class c (0 negative, 1 positive)."""

    share: float
    odds: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the positive class for each row of votes."""
        at = votes.astype(np.int64) + 1
        ratio = np.log(self.odds[:, 1]) - np.log(self.odds[:, 0])
        lift = ratio[np.arange(votes.shape[1]), at].sum(axis=1) + np.log(self.share) - np.log1p(-self.share)
        return 1 / (1 + np.exp(np.clip(-lift, -700, 700)))


def fit(
    votes: np.ndarray, counts: np.ndarray, share: float = 0.85, weight: float = 0.02, rounds: int = 300, start: np.ndarray = START,
    known: tuple[int, ...] = (),
) -> VoteModel:
    """Expectation-maximisation from `share` and `start`, which also count as votes of a `weight` share of the rows.

    When a rule abstains says something too, as rules that look for one defect abstain on most bad rows. A negative
    vote never counts for the positive class and a positive vote never against it, which keeps the classes' names.
    No rows: the starting values. start: of all rules, or of each; that of the rules in `known` stays as it is.
    """
    start = np.broadcast_to(start, (votes.shape[1], 2, 3))
    model = VoteModel(share, start)
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # patterns x rules x outcomes
    seen = weight * counts.sum()
    for _ in range(rounds if len(counts) else 0):
        p = model.posterior(votes)
        odds = np.stack(
            [np.tensordot(counts * x, hot, axes=(0, 0)) + seen * prior for x, prior in zip((1 - p, p), (start[:, 0], start[:, 1]), strict=True)],
            axis=1,
        )
        odds /= odds.sum(axis=2, keepdims=True)
        down = np.maximum(odds[:, 0, 0], odds[:, 1, 0])
        up = np.minimum(odds[:, 0, 2], odds[:, 1, 2])
        odds[:, 0] = np.stack([down, np.maximum(1e-6, 1 - down - up), up], axis=1)
        odds /= odds.sum(axis=2, keepdims=True)
        odds[list(known)] = start[list(known)]
        new = float(np.clip((counts @ p + seen * share) / (counts.sum() + seen), 1e-6, 1 - 1e-6))
        moved = np.abs(odds - model.odds).max() + abs(new - model.share)
        model = VoteModel(new, odds)
        if moved < 1e-10:
            break
    return model
