"""DuckDB SQL expressions used only by the oracle (independent formulas).

``sql_p_from_r``: two-sided t p-value for a correlation via the finite series
for integer degrees of freedom (Abramowitz & Stegun 26.7.3 / 26.7.4), with
theta = asin(|r|) and cos^2(theta) = 1 - r^2.  The engine uses a continued
fraction instead, so the two agree only if both are right.

``sql_p_from_z``: two-sided normal p-value, 1 - erf(|z|/sqrt 2) with
erf(x) = exp(-x^2) * sum_n x^(2n+1) / Gamma(n + 3/2).
"""


def sql_p_from_r(r: str, n: str) -> str:
    ar = f"least(abs({r}), 1.0)"
    c = f"(1.0 - {ar} * {ar})"
    df = f"(({n}) - 2)"
    even = (f"{ar} * list_sum(list_transform(range(0, CAST({df} // 2 AS BIGINT)), "
            f"lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1) + k * ln({c}))))")
    odd = (f"(2.0 / pi()) * (asin({ar}) + {ar} * sqrt({c}) * coalesce(list_sum(list_transform("
           f"range(0, CAST(({df} - 1) // 2 AS BIGINT)), "
           f"lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + k * ln({c})))), 0.0))")
    return (f"(CASE WHEN ({r}) IS NULL OR ({n}) < 3 THEN NULL WHEN {ar} >= 1.0 THEN 0.0 "
            f"ELSE greatest(0.0, least(1.0, 1.0 - CASE WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)) END)")


def sql_p_from_z(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    erf = (f"(exp(-{x} * {x}) * list_sum(list_transform(range(0, 240), "
           f"lambda k: exp((2 * k + 1) * ln({x}) - lgamma(k + 1.5)))))")
    return (f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN ({z}) = 0 THEN 1.0 WHEN {x} > 9 THEN 0.0 "
            f"ELSE least(1.0, greatest(0.0, 1.0 - {erf})) END)")
