"""Structured sequence operators: which neighbouring tokens merge, as sums over all matchings and as the best one.

Arrays of one sentence go through NumPy in Arrow batches; the rules and pieces that every batch needs are of checked size.
"""

from __future__ import annotations

from math import exp, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType

MOST_RULES = 5_000_000


def _scores(scores, mask) -> np.ndarray:
    """Scores of edges; a null, which Arrow hands over as NaN, and a masked edge are boundaries."""
    s = scores.astype(float) if isinstance(scores, np.ndarray) and scores.dtype.kind in "fi" else np.array([np.nan if x is None else x for x in scores], float)
    s[np.isnan(s)] = -np.inf
    if mask is not None:
        s[~np.array([bool(m) for m in mask], bool)] = -np.inf
    if (s == np.inf).any():
        raise ValueError("edge scores must be finite")
    return s


def log_partition(scores, mask=None) -> tuple[np.ndarray, np.ndarray]:
    """Prefix and suffix log sums over all sets of edges without a shared token. Masked edges are boundaries."""
    s = _scores(scores, mask).tolist()
    n = len(s) + 1
    prefix, suffix = [0.0] * (n + 1), [0.0] * (n + 1)
    for k in range(2, n + 1):
        prefix[k] = _log_sum(prefix[k - 1], prefix[k - 2] + s[k - 2])
    for k in range(n - 2, -1, -1):
        suffix[k] = _log_sum(suffix[k + 1], suffix[k + 2] + s[k])
    return np.array(prefix), np.array(suffix)


def _log_sum(a: float, b: float) -> float:
    """``log(exp a + exp b)`` of a finite and a perhaps infinitely small number."""
    if b > a:
        a, b = b, a
    return a + log1p(exp(b - a))


def marginals(scores, mask=None) -> np.ndarray:
    """Probability of each edge under the distribution of matchings."""
    s = _scores(scores, mask)
    prefix, suffix = log_partition(scores, mask)
    return np.exp(prefix[: len(s)] + s + suffix[2:] - prefix[-1]) if len(s) else np.zeros(0)


def best_matching(scores, mask=None) -> np.ndarray:
    """The matching of greatest score; where merging is no better than not, it does not."""
    s = _scores(scores, mask).tolist()
    n = len(s) + 1
    merged = [False] * (n + 1)
    before, last = 0.0, 0.0  # the best without the last token, and with it
    for k in range(2, n + 1):
        joined = before + s[k - 2]
        merged[k] = joined > last
        before, last = last, max(joined, last)
    out, k = np.zeros(len(s), bool), n
    while k > 1:
        if merged[k]:
            out[k - 2] = True
            k -= 2
        else:
            k -= 1
    return out


def _over_arrays(f, kind):
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else f(x)), kind)


def edge_marginals(scores: str | Column) -> Column:
    """Null scores inside an array are boundaries; a null array gives null."""
    return _over_arrays(lambda x: marginals(x).tolist(), ArrayType(DoubleType()))(scores)


def edge_matching(scores: str | Column) -> Column:
    return _over_arrays(lambda x: best_matching(x).tolist(), ArrayType(BooleanType()))(scores)


def log_normalizer(scores: str | Column) -> Column:
    return _over_arrays(lambda x: float(log_partition(x)[0][-1]), DoubleType())(scores)


def retokenize_one(tokens: list[int], generations: list[dict[tuple[int, int], int]]) -> list[int]:
    """Generation by generation: pairs with a rule, leftmost first without overlap, become the rule's token."""
    for rules in generations:
        out, i = [], 0
        while i < len(tokens):
            new = rules.get((tokens[i], tokens[i + 1])) if i + 1 < len(tokens) else None
            out.append(tokens[i] if new is None else new)
            i += 1 if new is None else 2
        tokens = out
    return tokens


def retokenize(tokens: str | Column, rules: list[dict]) -> Column:
    """Arrays of token ids under the active rules (token_id, left, right, generation, active), at most ``MOST_RULES``."""
    if len(rules) > MOST_RULES:
        raise ValueError("too many rules for one worker")
    steps: dict[int, dict] = {}
    for r in rules:
        if r["active"]:
            steps.setdefault(r["generation"], {})[r["left"], r["right"]] = r["token_id"]
    ordered = [steps[g] for g in sorted(steps)]

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else retokenize_one(list(x), ordered))

    return F.pandas_udf(run, ArrayType(IntegerType()))(tokens)


def greedy_one(tokens: list[int], spans: dict[tuple[int, ...], int], longest: int) -> list[int]:
    """At each place the longest known span, among equals the smallest id."""
    out, i = [], 0
    while i < len(tokens):
        for n in range(min(longest, len(tokens) - i), 1, -1):
            new = spans.get(tuple(tokens[i : i + n]))
            if new is not None:
                out.append(new)
                i += n
                break
        else:
            out.append(tokens[i])
            i += 1
    return out


def greedy_spans(tokens: str | Column, rules: list[dict]) -> Column:
    if len(rules) > MOST_RULES:
        raise ValueError("too many rules for one worker")
    spans: dict[tuple[int, ...], int] = {}
    for r in sorted(rules, key=lambda r: -r["token_id"]):
        spans[tuple(r["span"])] = r["token_id"]
    longest = max(map(len, spans), default=1)
    return F.pandas_udf(lambda b: b.map(lambda x: None if x is None else greedy_one(list(x), spans, longest)), ArrayType(IntegerType()))(tokens)
