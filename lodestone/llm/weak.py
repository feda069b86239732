"""Label model for rules that vote good (1), bad (-1) or abstain (0)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_counts(votes: DataFrame, rules: list[str]) -> list[tuple[tuple[int, ...], int]]:
    """How many rows share each combination of votes: at most 3 ** len(rules) rows, whatever the input's size."""
    rows = votes.groupBy(*rules).count().collect()
    return sorted((tuple(int(r[k]) for k in rules), r["count"]) for r in rows)


def _good(votes, weights: list[float], prior: float) -> float:
    odds = math.log(prior / (1 - prior)) + sum(v * w for v, w in zip(votes, weights, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 60, prior: float = 0.5, start: float = 0.8) -> dict:
    """Expectation-maximisation over vote patterns, with one accuracy a rule.

    A vote is right with its rule's accuracy; an abstention says nothing. The
    class balance stays at ``prior``. Accuracies stay between 0.5 and 0.99, so
    that the classes keep their meaning. No rows: the starting accuracies.
    """
    accuracy = [start] * n_rules
    for _ in range(rounds if patterns else 0):
        weights = [math.log(a / (1 - a)) for a in accuracy]
        right, cast = [start] * n_rules, [1.0] * n_rules
        for votes, n in patterns:
            p = _good(votes, weights, prior)
            for j, v in enumerate(votes):
                if v:
                    right[j] += n * (p if v > 0 else 1 - p)
                    cast[j] += n
        accuracy = [min(0.99, max(0.5, r / c)) for r, c in zip(right, cast, strict=True)]
    return {"prior": prior, "accuracy": accuracy, "weights": [math.log(a / (1 - a)) for a in accuracy]}


def posterior(model: dict, rules: list[str]) -> Column:
    """Probability that a row is good, from its vote columns."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    terms = [F.col(k).cast("double") * w for k, w in zip(rules, model["weights"], strict=True)]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, odds)))
