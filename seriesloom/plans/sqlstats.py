"""Closed forms of tail probabilities in plain SQL, independent of the engine's own numerics."""


def p_normal(z: str) -> str:
    """Two-sided normal tail from the series erf(x) = sum x^(2k+1) exp(-x^2) / Gamma(k + 3/2)."""
    x = f"greatest(least(abs({z}), 8.0) / sqrt(2), 1e-12)"
    return (f"greatest(0.0, 1 - list_sum(list_transform(range(0, 160), lambda k: "
            f"exp((2 * k + 1) * ln({x}) - {x} * {x} - lgamma(k + 1.5)))))")


def p_t(t: str, nu: str) -> str:
    """Two-sided t tail for whole degrees of freedom (finite trigonometric sums)."""
    c = f"(({nu}) / (({nu}) + ({t}) * ({t})))"
    s = f"(abs({t}) / sqrt(({nu}) + ({t}) * ({t})))"
    even = (f"{s} * list_sum(list_transform(range(0, CAST(({nu}) // 2 AS BIGINT)), lambda k: "
            f"exp(lgamma(k + 0.5) - lgamma(k + 1) + k * ln({c})) / sqrt(pi())))")
    odd = (f"2 / pi() * (atan(abs({t}) / sqrt({nu})) + {s} * sqrt({c}) * coalesce(list_sum(list_transform("
           f"range(0, CAST((({nu}) - 1) // 2 AS BIGINT)), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5) + k * ln({c})))), 0))")
    return f"(1 - CASE WHEN ({nu}) % 2 = 0 THEN {even} ELSE {odd} END)"


def p_chi2_even(x: str, df: str) -> str:
    """Upper chi-square tail for even degrees of freedom."""
    return (f"exp(-({x}) / 2) * list_sum(list_transform(range(0, CAST(({df}) // 2 AS BIGINT)), "
            f"lambda k: pow(({x}) / 2, k) / gamma(k + 1)))")
