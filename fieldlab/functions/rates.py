"""Rates, shrinkage, blending and probability kernels as SQL expressions over columns, so that one text of a formula
serves every table. A zero or missing denominator gives 0, as the feature layer has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "(hits - doubles - triples - home_runs + 2 * doubles + 3 * triples + 4 * home_runs)"
#: name: (numerator, denominator)
RATES = {
    "avg": ("hits", "at_bats"),
    "obp": ("(hits + walks)", "plate_appearances"),
    "slg": (BASES, "at_bats"),
    "iso": (f"({BASES} - hits)", "at_bats"),
    "babip": ("(hits - home_runs)", "(at_bats - strikeouts - home_runs)"),
    "k_rate": ("strikeouts", "plate_appearances"),
    "bb_rate": ("walks", "plate_appearances"),
    "hr_rate": ("home_runs", "plate_appearances"),
}
COUNTS = ["plate_appearances", "at_bats", "walks", "hits", "doubles", "triples", "home_runs", "strikeouts", "rbi", "runs"]


def ratio(num: str, den: str) -> str:
    """num / den as a double rounded to 6 places, 0 where den is zero or null; SQL text for either engine."""
    return f"round(coalesce(cast({num} as double) / nullif(cast({den} as double), 0), 0), 6)"


def rates(names: list[str] | None = None) -> dict[str, str]:
    return {name: ratio(*RATES[name]) for name in names or RATES}


def rate_columns(names: list[str] | None = None) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in rates(names).items()]


def posterior(successes: str, trials: str, mean: float, strength: float) -> dict[str, str]:
    """Mean, variance and 95% interval of a beta-binomial posterior; successes are held to the trials."""
    k = f"least({successes}, {trials})"
    a, b = f"({mean * strength} + {k})", f"({(1 - mean) * strength} + {trials} - {k})"
    m = f"({a} / ({a} + {b}))"
    v = f"({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1)))"
    return {
        "post_mean": f"round({m}, 6)",
        "post_var": f"round({v}, 9)",
        "low": f"round(greatest({m} - 1.959964 * sqrt({v}), 0), 6)",
        "high": f"round(least({m} + 1.959964 * sqrt({v}), 1), 6)",
    }


def clamp(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}), {high})"


def logit(p: str) -> str:
    q = clamp(p, 0.0001, 0.9999)
    return f"ln({q} / (1 - {q}))"


def logistic(x: str) -> str:
    return f"(1 / (1 + exp(-({clamp(x, -60, 60)}))))"


def blend_log_odds(parts: dict[str, float]) -> str:
    """Weighted mean of the log-odds of several rates."""
    total = sum(parts.values())
    return logistic("(" + " + ".join(f"{w} * {logit(p)}" for p, w in parts.items()) + f") / {total}")


def wilson(p: str, n: str, z: float = 1.959964) -> dict[str, str]:
    den, mid = f"(1 + {z * z} / ({n}))", f"({p} + {z * z} / (2 * ({n})))"
    half = f"({z} * sqrt({p} * (1 - {p}) / ({n}) + {z * z} / (4 * ({n}) * ({n}))))"
    return {"low": f"round(({mid} - {half}) / {den}, 6)", "high": f"round(({mid} + {half}) / {den}, 6)"}


def ladder(x: str, steps: list[tuple[float, str]], default: str) -> str:
    """The name of the first threshold at or below x."""
    return "case " + " ".join(f"when {x} >= {t} then '{name}'" for t, name in steps) + f" else '{default}' end"
