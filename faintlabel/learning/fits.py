"""What a linear fit minimises, and the sums over rows it needs.

For weights w on scaled features z = x / std, with P the label-1 and U the label-0 rows of the fit:

``pu``        (1/N) sum_P softplus(-m) + reg/2 |w|^2 + lambda_u * D(p_hat, p_tilde), p_hat the mean of sigmoid(m) on U
``logistic``  (1/N) [sum_P softplus(-m) + sum_U softplus(m)] + reg/2 |w|^2
``hinge``     (1/N) sum max(0, 1 - y m) + reg/2 |w|^2
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from faintlabel.learning.repeats import Cells, parts
from faintlabel.operators.features import FeatureSet

CLAMP = 1e-12


def _kl(p_hat: float, p: float) -> tuple[float, float]:
    value = -p * math.log(p_hat) + (1 - p) * (math.log(1 - p) - math.log(1 - p_hat) if p < 1 else 0.0)
    return value, (1 - p) / (1 - p_hat) - p / p_hat


def _bhattacharyya(p_hat: float, p: float) -> tuple[float, float]:
    overlap = math.sqrt(p * p_hat) + math.sqrt((1 - p) * (1 - p_hat))
    slope = -(math.sqrt(p / p_hat) - math.sqrt((1 - p) / (1 - p_hat))) / (2 * overlap)
    return -math.log(overlap), slope


# name -> (value, derivative) in p_hat.  A new divergence needs nothing else: its gradient is D'(p_hat) * grad p_hat.
DIVERGENCES = {"kl": _kl, "bhattacharyya": _bhattacharyya}


def divergence(name: str, p_hat: float, p_tilde: float) -> tuple[float, float]:
    """Value and slope at the clamped mean prediction.  ``kl`` leaves out the constant p_tilde * log p_tilde."""
    return DIVERGENCES[name](min(max(p_hat, CLAMP), 1 - CLAMP), p_tilde)


def true_kl(p_hat: float, p_tilde: float) -> float:
    """Kullback-Leibler divergence of the prior from the mean prediction, with 0 log 0 = 0 (diagnostic)."""
    const = p_tilde * math.log(p_tilde) if p_tilde > 0 else 0.0
    return divergence("kl", p_hat, p_tilde)[0] + const


@dataclass(frozen=True)
class Fit:
    """One model to fit.  Rows with a NULL label, in the left-out fold, or in another bag do not take part."""

    name: str = "fit"
    kind: str = "pu"
    label: str = "label"
    fold_col: str | None = None
    left_out: int | None = None
    bag_col: str | None = None
    bag: int | None = None
    p_tilde: float = 0.0
    lambda_u: float = 1.0
    reg_param: float = 0.0
    divergence: str = "kl"
    scale: bool = True
    only: tuple[int, ...] | None = None  # feature subset; the other weights stay 0
    params: dict = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self):
        if self.kind not in ("pu", "logistic", "hinge"):
            raise ValueError(f"unknown kind {self.kind}")
        if self.divergence not in DIVERGENCES:
            raise ValueError(f"unknown divergence {self.divergence}, have {sorted(DIVERGENCES)}")
        if not 0.0 <= self.p_tilde <= 1.0:
            raise ValueError(f"p_tilde must be in [0, 1], got {self.p_tilde}")
        if self.reg_param < 0:
            raise ValueError("reg_param must not be negative")

    @property
    def inputs(self) -> list[str]:
        return [c for c in (self.label, self.fold_col, self.bag_col) if c]


def member_mask(fit: Fit, columns: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of the batch that train this fit."""
    y = columns[fit.label]
    mask = ~np.isnan(y)
    if fit.fold_col is not None and fit.left_out is not None:
        mask &= columns[fit.fold_col] != fit.left_out
    if fit.bag_col is not None and fit.bag is not None:
        b = columns[fit.bag_col]
        mask &= np.isnan(b) | (b == fit.bag)
    return mask


def input_columns(fits: list[Fit]) -> list[str]:
    return sorted({c for f in fits for c in f.inputs})


HEAD = 5  # n, n_pos, n_unl, sum over P of the loss, sum over U of the statistic


def _memberships(fits: list[Fit], columns: dict[str, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """(masks of members, positives and unlabeled, a column per training set; the column of each fit).  Fits that train on
    the same rows share a column."""
    same: dict[tuple, int] = {}
    place = np.array([same.setdefault((f.label, f.fold_col, f.left_out, f.bag_col, f.bag), len(same)) for f in fits])
    reps = [fits[i] for i in np.unique(place, return_index=True)[1]]
    member = np.column_stack([member_mask(f, columns) for f in reps])
    y = np.column_stack([columns[f.label] for f in reps])
    return [member, member & (y == 1), member & (y == 0)], place


#: Margins worked out at a time, so that the arrays of all steps stay in the processor's cache.
CACHED_CELLS = 1 << 15
#: Factors of at most 2 that a product of doubles holds safely.
FACTORS = 512


def _log_products(factors: np.ndarray, n: np.ndarray) -> np.ndarray:
    """K sums of n * log(factor) over the rows.  Factors from 1 to 2 of neighbours that count equally are multiplied first,
    since a logarithm costs as much as twenty products."""
    starts = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
    starts = np.union1d(starts, np.arange(0, len(n), FACTORS))
    return n[starts] @ np.log(np.multiply.reduceat(factors, starts, axis=0))


def _terms(kind: str, positive: bool, u: np.ndarray, n: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """(K sums over the rows, which count ``n`` times, of the loss or statistic; its slope in ``u`` per row and fit) at
    ``u``, the margins of unlabeled rows or the negative margins of positives.  No sums for a hinge: its slopes tell them."""
    if kind == "hinge":  # max(0, 1 + u)
        return None, (u > -1).astype(float)
    e = np.abs(u)
    np.negative(e, out=e)
    np.exp(e, out=e)
    high = 1 + e
    if kind == "logistic" or positive:  # softplus(u), sigmoid(u)
        total = n @ np.maximum(u, 0) + _log_products(high, n)
        np.copyto(e, 1.0, where=u >= 0)
        e /= high
        return total, e
    np.divide(1.0, high, out=high)  # sigmoid(|u|), and with the next line 1 - sigmoid(|u|)
    e *= high
    total = n @ np.where(u >= 0, high, e)
    e *= high
    return total, e


def _add_terms(out: np.ndarray, block, n: np.ndarray, kind: str, positive: bool, w: np.ndarray, of: np.ndarray, size: int) -> None:
    """Add the terms of a block's rows, which count ``n`` times in ascending order, to the fits ``of``."""
    sign = -1.0 if positive else 1.0
    toward = sign * w[of]
    step = max(1, CACHED_CELLS // len(of))
    total, pulled = np.zeros(len(of)), np.zeros((len(of), size))
    for a, part in block.slices(step):
        own = n[a : a + part.n]
        sums, slope = _terms(kind, positive, part.dot(toward), own)
        if own[0] == own[-1] == 1:
            pull = part.pull(slope)
        elif kind == "hinge":  # its slopes are 0 or 1, so the order of the factors does not matter
            pull = part.pull(slope * own[:, None])
        else:
            pull = part.weighted(own).pull(slope)
        total += own @ slope + (pull * toward).sum(1) if sums is None else sums
        pulled += pull
    at = HEAD if positive else HEAD + size
    out[of, 3 if positive else 4] += total
    out[of, at : at + size] += sign * pulled


def _by_count(n: np.ndarray) -> np.ndarray:
    """Rows that count at all, those that count equally together.  Sorting whole numbers of two bytes takes a tenth of the time."""
    small = n.astype(np.uint16) if n.size and n.max() < 1 << 16 else n
    order = np.argsort(small, kind="stable")
    return order[np.searchsorted(small[order], 0, "right") :]


def _sharing(mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a column of the mask, which columns equal it) for each different column that is not empty."""
    packed = np.ascontiguousarray(np.packbits(mask, axis=0).T)
    width, raw = packed.shape[1], packed.tobytes()
    same: dict[bytes, int] = {}
    group = np.array([same.setdefault(raw[i : i + width], len(same)) for i in range(0, len(raw), width)])
    for j, first in enumerate(np.unique(group, return_index=True)[1]):
        if mask[:, first].any():
            yield mask[:, first : first + 1], group == j


def batch_sums(
    batch: pa.RecordBatch, features: FeatureSet, fits: list[Fit], w: np.ndarray, cells: Cells | None = None, known: dict | None = None
) -> np.ndarray:
    """K x (5 + 2D) sums of a batch: counts, losses, and the two gradient directions of each fit.

    Fits for which the same rows are positive (or unlabeled) share a step, and only those rows are read.  ``known`` keeps, for
    a task, which cells train which fit.
    """
    known = {} if known is None else known
    kinds = np.array([f.kind for f in fits])
    size = features.size
    out = np.zeros((len(fits), HEAD + 2 * size))
    for part in parts(batch, features, input_columns(fits), cells):
        if cells is None:
            known["masks"], known["place"] = _memberships(fits, part.columns)
        elif not known:
            known["masks"], known["place"] = _memberships(fits, cells.columns())
        place = known["place"]
        masks = [m if cells is None else m[part.present] for m in known["masks"]]
        out[:, :3] += part.totals(masks)[:, place].T
        for mask, positive in ((masks[1], True), (masks[2], False)):
            for members, sets in _sharing(mask):
                weights = part.weights(members)[:, 0]
                order = _by_count(weights)
                if not len(order):
                    continue
                whole = len(order) == len(weights) and weights[order[0]] == weights[order[-1]]
                block = part.block if whole else part.block.take(order)
                weights = weights if whole else weights[order]
                sharing = sets[place]
                for kind in np.unique(kinds[sharing]):
                    _add_terms(out, block, weights, kind, positive, w, np.flatnonzero(sharing & (kinds == kind)), size)
    return out


@dataclass
class Sums:
    """The sums of one fit, gradients in scaled feature space."""

    n: float
    n_pos: float
    n_unl: float
    loss_pos: float
    stat_unl: float
    grad_pos: np.ndarray
    grad_unl: np.ndarray

    @staticmethod
    def of(row: np.ndarray, inv_std: np.ndarray) -> Sums:
        d = inv_std.size
        return Sums(*row[:HEAD], row[HEAD : HEAD + d] * inv_std, row[HEAD + d :] * inv_std)

    def p_hat(self) -> float:
        if self.n_unl == 0:
            raise ValueError("no unlabeled rows: the label regulariser needs rows with label 0")
        return self.stat_unl / self.n_unl


def loss_and_gradient(fit: Fit, s: Sums, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Objective value and gradient at (scaled) weights w from the sums over rows."""
    if fit.kind == "pu":
        value, slope = divergence(fit.divergence, s.p_hat(), fit.p_tilde)
        loss = s.loss_pos / s.n + fit.lambda_u * value
        grad = s.grad_pos / s.n + fit.lambda_u * slope * s.grad_unl / s.n_unl
    else:
        loss = (s.loss_pos + s.stat_unl) / s.n
        grad = (s.grad_pos + s.grad_unl) / s.n
    return float(loss + 0.5 * fit.reg_param * (w @ w)), grad + fit.reg_param * w
