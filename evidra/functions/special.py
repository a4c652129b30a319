"""Special functions as SQL expression text: they run inside Spark's generated code, without Python workers.

Each takes expressions of type double as text and gives one back, for ``F.expr``; other engines read the same text.
"""

from __future__ import annotations

#: Coefficients of Wichura's algorithm AS 241 (PPND16), numerators and denominators from the constant up.
_CENTRE = (
    (3.387132872796366608, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.1870074920579083, 5394.1960214247511077, 21213.794301586595867, 39307.89580009271061, 28729.085735721942674, 5226.495278852854561),
)
_MIDDLE = (
    (1.42343711074968357734, 4.6303378461565452959, 5.7694972214606914055, 3.64784832476320460504, 1.27045825245236838258, 0.24178072517745061177, 0.0227238449892691845833, 7.7454501427834140764e-4),
    (1.0, 2.05319162663775882187, 1.6763848301838038494, 0.68976733498510000455, 0.14810397642748007459, 0.0151986665636164571966, 5.475938084995344946e-4, 1.05075007164441684324e-9),
)
_TAIL = (
    (6.6579046435011037772, 5.4637849111641143699, 1.7848265399172913358, 0.29656057182850489123, 0.026532189526576123093, 0.0012426609473880784386, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.59983220655588793769, 0.13692988092273580531, 0.0148753612908506148525, 7.868691311456132591e-4, 1.8463183175100546818e-5, 1.4215117583164458887e-7, 2.04426310338993978564e-15),
)
#: Hart's rational approximation of the normal integral below 5 sqrt 2, from the highest power down.
_HART = (
    (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376),
    (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752),
)


def _number(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def _falling(coefficients: tuple[float, ...], x: str) -> str:
    """Horner's rule, from the highest power down."""
    out = _number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return out


def _ratio(pair: tuple[tuple[float, ...], tuple[float, ...]], x: str) -> str:
    return f"({_falling(pair[0][::-1], x)} / {_falling(pair[1][::-1], x)})"


def norm_cdf(x: str) -> str:
    """The normal distribution function, to about 1e-15."""
    a, bell = f"abs({x})", f"exp(-({x}) * ({x}) / 2e0)"
    near = f"{bell} * {_falling(_HART[0], a)} / {_falling(_HART[1], a)}"
    far = f"{bell} / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0))))) / 2.506628274631e0"
    upper = f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1e0 - {upper} ELSE {upper} END)"


def norm_ppf(p: str) -> str:
    """The normal quantile of 0 < ``p`` < 1; null outside."""
    inside = f"(CASE WHEN {p} > 0e0 AND {p} < 1e0 THEN {p} END)"
    q = f"({inside} - 0.5e0)"
    root = f"sqrt(-ln(CASE WHEN {p} < 0.5e0 THEN {inside} ELSE 1e0 - {inside} END))"
    tail = f"(CASE WHEN {root} <= 5e0 THEN {_ratio(_MIDDLE, f'({root} - 1.6e0)')} ELSE {_ratio(_TAIL, f'({root} - 5e0)')} END)"
    return f"(CASE WHEN abs({q}) <= 0.425e0 THEN {q} * {_ratio(_CENTRE, f'(0.180625e0 - {q} * {q})')} WHEN {q} < 0e0 THEN -{tail} ELSE {tail} END)"


def log_gamma(x: str) -> str:
    """ln of the gamma function of ``x`` > 0: eight steps of the recurrence, then Stirling's series."""
    y = f"({x} + 8e0)"
    series = f"1e0 / (12e0 * {y}) - 1e0 / (360e0 * pow({y}, 3)) + 1e0 / (1260e0 * pow({y}, 5)) - 1e0 / (1680e0 * pow({y}, 7))"
    steps = " * ".join(f"({x} + {k}e0)" for k in range(8))
    return f"(({y} - 0.5e0) * ln({y}) - {y} + 0.9189385332046727e0 + {series} - ln({steps}))"


def hedges_j(m: str) -> str:
    """The exact small-sample factor of ``m`` > 1 degrees of freedom; null otherwise."""
    own = f"(CASE WHEN {m} > 1e0 THEN {m} END)"
    return f"exp({log_gamma(f'({own} / 2e0)')} - 0.5e0 * ln({own} / 2e0) - {log_gamma(f'(({own} - 1e0) / 2e0)')})"
