"""Tail probabilities as SQL expressions, by Simpson's rule over 2,000 steps, for the oracle side of p columns."""

_WEIGHT = "case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end"


def t_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t (columns, not expressions, keep it short)."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    return (f"(1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * {angle} / 6000 * list_sum(list_transform(range(0, 2001), "
            f"lambda i: cos({angle} * i / 2000) ** ({df} - 1) * {_WEIGHT})))")


def normal_sql(z: str) -> str:
    """Two-sided normal tail of a column that is not negative."""
    return (f"(1 - 2 / sqrt(2 * pi()) * {z} / 6000 * list_sum(list_transform(range(0, 2001), "
            f"lambda i: exp(-(({z} * i / 2000) ** 2) / 2) * {_WEIGHT})))")


# Upper 2.5 % points of Student's t for 1 to 12 degrees of freedom (fixed, published values).
T_975 = "[12.7062047, 4.3026527, 3.1824463, 2.7764451, 2.5705818, 2.4469119, 2.3646243, 2.3060041, 2.2621572, 2.2281389, 2.2009852, 2.1788128]"
