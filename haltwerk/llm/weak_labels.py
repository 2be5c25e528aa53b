"""A label model for rules that vote or abstain.

A vote is 1 (good), -1 (bad) or 0 (abstains).  Given the hidden label, rules
vote independently.  When rule j votes, it is right with accuracy g_j on good
rows and b_j on bad ones: most rules look for one defect, so they are nearly
always right about good rows and miss bad rows with another defect.
Expectation-maximisation alternates posteriors of the labels and accuracies.
Only the number of rows per vote pattern enters, at most 3^rules numbers,
whatever the corpus holds.

Accuracies stay within bounds in which a bad vote always speaks against a row,
and they and the share of good rows have Beta priors: a corpus in which nearly
nothing is bad keeps its rows instead of being cut in two along some harmless
difference.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GOOD_BOUNDS = (0.90, 0.998)
BAD_BOUNDS = (0.15, 0.98)
PRIOR_BOUNDS = (0.6, 0.95)


@dataclass(frozen=True)
class LabelModel:
    good_accuracy: tuple[float, ...]
    bad_accuracy: tuple[float, ...]
    prior: float
    rounds: int

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of a good label for rows of votes."""
        g, b = np.asarray(self.good_accuracy), np.asarray(self.bad_accuracy)
        votes = np.asarray(votes)
        odds = np.log(self.prior / (1 - self.prior)) + (votes > 0) @ np.log(g / (1 - b)) + (votes < 0) @ np.log((1 - g) / b)
        return 1 / (1 + np.exp(-odds))


def fit(
    votes: np.ndarray,
    weight: np.ndarray,
    good: float = 0.98,
    bad: float = 0.4,
    prior: float = 0.85,
    strength: float = 50.0,
    rounds: int = 300,
    tolerance: float = 1e-7,
) -> LabelModel:
    """Fit accuracies to ``weight`` rows of each pattern in ``votes`` (patterns by rules).

    ``strength`` is the number of imagined rows behind the start values
    ``good``, ``bad`` and ``prior``.  Without rows the model keeps them.
    """
    votes = np.asarray(votes)
    weight = np.asarray(weight, float)
    order = np.lexsort(votes.T) if len(weight) else np.zeros(0, int)
    votes, weight = votes[order], weight[order]  # sums don't depend on the order of rows
    rules = votes.shape[1]
    model = LabelModel((good,) * rules, (bad,) * rules, prior, 0)

    def rate(right: np.ndarray, cast: np.ndarray, start: float, bounds: tuple[float, float]) -> tuple[float, ...]:
        return tuple(float(x) for x in np.clip((right + strength * start) / (cast + strength), *bounds))

    for done in range(1, rounds + 1):
        p = model.posterior(votes)
        yes, no = weight * p, weight * (1 - p)
        new = LabelModel(
            rate(yes @ (votes > 0), yes @ (votes != 0), good, GOOD_BOUNDS),
            rate(no @ (votes < 0), no @ (votes != 0), bad, BAD_BOUNDS),
            float(np.clip((yes.sum() + strength * prior) / (weight.sum() + strength), *PRIOR_BOUNDS)),
            done,
        )
        old = np.array([*model.good_accuracy, *model.bad_accuracy, model.prior])
        moved = np.abs(np.array([*new.good_accuracy, *new.bad_accuracy, new.prior]) - old).max()
        model = new
        if moved < tolerance:
            break
    return model
