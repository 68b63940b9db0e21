"""Small driver-side solvers.  Each is a generator: it yields weights and receives what the data pass found there.

That turns the control flow around: the caller can step any number of solvers with one pass over the data.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Generator
from dataclasses import dataclass

import numpy as np

from faintlabel.learning.fits import Fit, Sums, divergence, loss_and_gradient


WINDOW = 10


@dataclass
class Solution:
    """``reason``: what ended the fit; it has ``converged`` by its own test, or ran out of something."""

    weights: np.ndarray
    losses: list[float]
    evaluations: int
    reason: str = "iterations"

    @property
    def converged(self) -> bool:
        return self.reason in CONVERGED


#: Reasons that mean an optimum: no slope, no more gain, short steps, a small Newton decrement.
CONVERGED = ("gradient", "gain", "short steps", "decrement")


def _two_loop(grad: np.ndarray, pairs: deque) -> np.ndarray:
    """L-BFGS direction from the last (step, gradient change) pairs."""
    q = grad.copy()
    coeffs = []
    for s, y in reversed(pairs):
        a = (s @ q) / (y @ s)
        q -= a * y
        coeffs.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(coeffs)):
        q += s * (a - (y @ q) / (y @ s))
    return -q


def lbfgs(
    fit: Fit, w0: np.ndarray, max_iter: int = 100, tol: float = 1e-4, corrections: int = 10, max_evals: int | None = None
) -> Generator[np.ndarray, Sums, Solution]:
    """Limited-memory BFGS with a weak-Wolfe bisection line search.

    Stops when the last WINDOW iterations together gained no more than ``tol`` times the first loss.
    """
    if corrections <= 0:
        raise ValueError("corrections must be positive")
    if tol < 0 or max_iter < 0:
        raise ValueError("tol and max_iter must not be negative")
    limit = max_evals if max_evals is not None else 20 * (max_iter + 1)
    w = np.asarray(w0, dtype=float)
    f, g = loss_and_gradient(fit, (yield w), w)
    losses, evals = [f], 1
    pairs: deque = deque(maxlen=corrections)
    reason = "iterations"
    for _ in range(max_iter):
        norm = float(np.linalg.norm(g))
        if norm <= 1e-10 * max(1.0, abs(f)):
            reason = "gradient"
            break
        if evals >= limit:
            reason = "evaluations"
            break
        d = _two_loop(g, pairs)
        slope = float(d @ g)
        if slope >= 0:
            pairs.clear()
            d, slope = -g, -norm * norm
        t = 1.0 if pairs else min(1.0, 1.0 / norm)
        low, high, accepted = 0.0, np.inf, None
        for _ in range(20):
            trial = w + t * d
            ft, gt = loss_and_gradient(fit, (yield trial), trial)
            evals += 1
            if not np.isfinite(ft) or ft > f + 1e-4 * t * slope:
                high = t
            else:
                accepted = (trial, ft, gt)
                if float(gt @ d) >= 0.9 * slope:
                    break
                low = t
            t = (low + high) / 2 if np.isfinite(high) else 2 * low
            if evals >= limit:
                break
        if accepted is None:
            reason = "evaluations" if evals >= limit else "line search"
            break
        trial, ft, gt = accepted
        s, y = trial - w, gt - g
        if float(s @ y) > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)):
            pairs.append((s, y))
        w, f, g = trial, ft, gt
        losses.append(f)
        if max(losses[-WINDOW - 1 : -1]) - f <= tol * abs(losses[0]):
            reason = "gain"
            break
    return Solution(w, losses, evals, reason)


def newton(
    fit: Fit, w0: np.ndarray, max_iter: int = 50, tol: float = 1e-20, free: np.ndarray | None = None
) -> Generator[np.ndarray, tuple[Sums, np.ndarray], Solution]:
    """Damped Newton steps from sums that come with the Hessian of the loss; ``free`` flags the features that take part.

    A step that does not lower the loss enough is halved, and the damping grows; it shrinks with every step taken.
    Stops when half the squared Newton decrement, the gain a full step promises, is at most ``tol`` plus rounding.
    """
    w = np.asarray(w0, dtype=float)
    inside = np.ones(w.size, bool) if free is None else free

    def told(answer: tuple[Sums, np.ndarray], at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums, curve = answer
        f, g = loss_and_gradient(fit, sums, at)
        return f, np.where(inside, g, 0.0), curve / max(sums.n, 1.0) + fit.reg_param * np.eye(at.size)

    f, g, h = told((yield w), w)
    losses, evals, damping, reason = [f], 1, 0.0, "iterations"
    for _ in range(max_iter):
        scale = max(float(np.trace(h)) / w.size, 1e-300)
        system = h + damping * scale * np.eye(w.size)
        system[~inside] = 0.0
        system[:, ~inside] = 0.0
        d = -np.linalg.pinv(system, hermitian=True) @ g
        gain = -float(g @ d)
        if gain / 2 <= tol + 1e-18 * abs(f):
            reason = "decrement"
            break
        t, accepted = 1.0, None
        for _ in range(30):
            trial = w + t * d
            answer = told((yield trial), trial)
            evals += 1
            if np.isfinite(answer[0]) and answer[0] <= f - 1e-4 * t * gain + 1e-15 * abs(f):
                accepted = trial, answer
                break
            t /= 2
            damping = max(2 * damping, 1e-6)
        if accepted is None:
            reason = "line search"
            break
        w, (f, g, h) = accepted
        damping = damping / 4 if t == 1.0 else damping
        losses.append(f)
    return Solution(w, losses, evals, reason)


def _settled(before: np.ndarray | None, now: np.ndarray, tol: float) -> bool:
    return before is not None and np.linalg.norm(before - now) < tol * max(float(np.linalg.norm(now)), 1.0)


def subgradient(
    fit: Fit, w0: np.ndarray, iterations: int = 100, step: float = 1.0, tol: float = 1e-3
) -> Generator[np.ndarray, Sums, Solution]:
    """Full-batch subgradient descent with step / sqrt(i) and an L2 shrink: the classic linear SVM schedule."""
    w = np.asarray(w0, dtype=float)
    losses, before, reason = [], None, "iterations"
    reg = 0.5 * fit.reg_param * float(w @ w)
    i = 0
    for i in range(1, iterations + 1):
        s = yield w
        if s.n == 0:
            reason = "no rows"
            break
        losses.append((s.loss_pos + s.stat_unl) / s.n + reg)
        rate = step / np.sqrt(i)
        w_next = w * (1 - rate * fit.reg_param) - rate * (s.grad_pos + s.grad_unl) / s.n
        reg = 0.5 * fit.reg_param * float(w_next @ w_next)
        done = _settled(before, w_next, tol)
        before, w = w_next, w_next
        if done:
            reason = "short steps"
            break
    return Solution(w, losses, i, reason)


def pu_step(fit: Fit, s: Sums, w: np.ndarray, step: float, iteration: int) -> tuple[np.ndarray, float]:
    """One label-regularized update from the positives' mean gradient; also the penalty at the new weights."""
    value, slope = divergence(fit.divergence, s.p_hat(), fit.p_tilde)
    push = fit.lambda_u * slope * s.grad_unl / s.n_unl
    w_next = w - step / np.sqrt(iteration) * (s.grad_pos / s.n_pos + fit.reg_param * w + push)
    return w_next, 0.5 * fit.reg_param * float(w_next @ w_next) + fit.lambda_u * value


def pu_sgd(
    fit: Fit, w0: np.ndarray, iterations: int = 100, step: float = 1.0, tol: float = 1e-3
) -> Generator[np.ndarray, Sums, Solution]:
    """Gradient descent for the label-regularized objective.

    The caller samples each batch and sends None if the table has no rows; a batch without positives, or without rows to
    regularise on, leaves the weights alone.
    """
    if not 0.0 <= tol <= 1.0:
        raise ValueError("tol must be in [0, 1]")
    w = np.asarray(w0, dtype=float)
    losses, before, penalty, reason = [], None, None, "iterations"
    i = 0
    for i in range(1, iterations + 1):
        s = yield w
        if s is None:
            reason = "no rows"
            break
        if s.n_pos == 0 or s.n_unl == 0:
            continue
        if penalty is None:
            penalty = 0.5 * fit.reg_param * float(w @ w) + fit.lambda_u * divergence(
                fit.divergence, s.p_hat(), fit.p_tilde
            )[0]
        losses.append(s.loss_pos / s.n_pos + penalty)
        w_next, penalty = pu_step(fit, s, w, step, i)
        done = _settled(before, w_next, tol)
        before, w = w_next, w_next
        if done:
            reason = "short steps"
            break
    return Solution(w, losses, i, reason)


SolverFactory = Callable[[Fit, np.ndarray], Generator[np.ndarray, Sums, Solution]]
