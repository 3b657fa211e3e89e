"""Association measures of 2x2 tables (a, b, c, d): events before incidents, other events, other incidents, neither."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi_squared(a: Column, b: Column, c: Column, d: Column) -> Column:
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))  # products of four margins leave 64 bits early
    n, below = a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)
    return F.when((n == 0) | (below == 0), 0.0).otherwise(n * (a * d - b * c) * (a * d - b * c) / below)


def mutual_information(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """(MI, PMI) in bits; 0 for a = 0."""
    n = (a + b + c + d).cast("double")

    def cell(x: Column, row: Column, col: Column) -> Column:
        return F.when(x > 0, x / n * F.log2(x * n / (row * col))).otherwise(0.0)

    mi = cell(a, a + b, a + c) + cell(b, a + b, b + d) + cell(c, c + d, a + c) + cell(d, c + d, b + d)
    return F.when(a > 0, mi).otherwise(0.0), F.when(a > 0, F.log2(a * n / ((a + b) * (a + c)))).otherwise(0.0)


def share(x: Column, of: Column) -> Column:
    return F.when(of > 0, x / of).otherwise(0.0)


def cramers_v(chi: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(chi / n)).otherwise(0.0)


def relative_risk(a: Column, b: Column, c: Column, d: Column) -> Column:
    """P(incident | event) over P(incident), the latter 0.001 at least."""
    return share(a, a + b) / F.greatest(share(a + c, a + b + c + d), F.lit(0.001))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.when((b > 0) & (c > 0), a * d / (b * c).cast("double")).when(a * d > 0, float("inf")).otherwise(0.0)


@F.pandas_udf(DoubleType())
def p_value(chi: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution with one degree of freedom."""
    return chi.map(lambda x: math.erfc(math.sqrt(x / 2)) if pd.notna(x) else None)


def predictive(p: Column, risk: Column, a: Column, alpha: float = 0.05) -> Column:
    return (p < alpha) & (risk >= 1.5) & (a >= 1)


def confidence(p: Column, v: Column, risk: Column, yes: Column, alpha: float = 0.05) -> Column:
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - p / alpha))
    return F.when(yes, F.least(F.lit(1.0), 0.4 * sure + 0.3 * v + 0.3 * F.least(F.lit(1.0), risk / 3))).otherwise(0.0)


def conditionals(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """P(incident | event), P(event | incident), P(event) and P(incident), 0 where nothing is counted."""
    n = a + b + c + d
    return {"p_incident_given_event": share(a, a + b), "p_event_given_incident": share(a, a + c), "p_event": share(a + b, n), "p_incident": share(a + c, n)}


def measures(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """Odds ratio (infinite for b c = 0), relative risk against no event (that 0.001 at least), Cramer's V and risk difference; 0 on empty margins."""
    with_event, without = share(a, a + b), share(c, c + d)
    return {
        "odds_ratio": F.when(b * c > 0, a * d / (b * c).cast("double")).otherwise(float("inf")),
        "relative_risk": with_event / F.greatest(without, F.lit(0.001)),
        "cramers_v": cramers_v(chi_squared(a, b, c, d), a + b + c + d),
        "risk_difference": with_event - without,
    }


def sample_odds(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The odds ratio that goes with Fisher's test: a d / (b c), infinite for b c = 0, NaN if a d is 0 as well."""
    return F.when(b * c > 0, a * d / (b * c).cast("double")).when(a * d > 0, float("inf")).otherwise(float("nan"))


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of Fisher's exact test: the tables with these margins that are no likelier than this one."""

    def one(a: int, b: int, c: int, d: int) -> float:
        row, col, n = a + b, a + c, a + b + c + d
        log = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
        weight = {x: log(row, x) + log(n - row, col - x) - log(n, col) for x in range(max(0, col - (n - row)), min(row, col) + 1)}
        return min(1.0, sum(math.exp(w) for w in weight.values() if w <= weight[a] + 1e-7))

    return pd.Series([one(*map(int, x)) for x in zip(a, b, c, d)], dtype="float64")


def order_similarity(x: Column, y: Column) -> Column:
    """Longest common subsequence of two arrays over the longer one: a fold over x of a row of the table as long as y."""

    def row_after(row: Column, item: Column) -> Column:
        cell = lambda out, j: F.when(item == F.get(y, j - 1), F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.element_at(out, -1)))
        return F.aggregate(F.sequence(F.lit(1), F.size(y)), F.array(F.lit(0)), lambda out, j: F.concat(out, F.array(cell(out, j))))

    last = F.aggregate(x, F.array_repeat(F.lit(0), F.size(y) + 1), row_after)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.element_at(last, -1) / F.greatest(F.size(x), F.size(y)))
