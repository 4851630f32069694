"""Column functions: every one returns a Spark ``Column`` and stays in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrastat.config import INF


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """True when the value is present, not NaN and not infinite."""
    v = col(c).cast("double")
    return F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(INF)), F.lit(False))


def decimal_comma(c: str | Column) -> Column:
    """Text with a decimal comma as DOUBLE; text that is no number becomes NULL."""
    return F.regexp_replace(col(c), ",", ".").try_cast("double")


def code_lookup(c: str | Column, mapping: Mapping, upper: bool = False) -> Column:
    """Value of a small fixed map; a key outside the map becomes NULL."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    key = F.upper(col(c)) if upper else col(c)
    return F.element_at(F.create_map(*pairs), key)


def factor_index(c: str | Column, levels: Sequence) -> Column:
    """Position (from 0) in the declared level order; the first level is the reference."""
    return code_lookup(c, {lv: i for i, lv in enumerate(levels)})


def group_id(c: str | Column) -> Column:
    """Sample id without its trailing ``_digits``."""
    return F.regexp_replace(col(c), "_[0-9]+$", "")


def indicator(c: str | Column, level) -> Column:
    return (col(c) == F.lit(level)).cast("double")


def right_closed_bin(c: str | Column, breaks: Sequence[float], labels: Sequence) -> Column:
    """Label of the interval ``(a, b]`` holding the value; labels may repeat."""
    if len(labels) != len(breaks) - 1:
        raise ValueError(f"{len(breaks) - 1} intervals but {len(labels)} labels")
    x = col(c).cast("double")
    out = F.when(x.isNull() | F.isnan(x) | (x <= F.lit(float(breaks[0]))), None)
    for upper, label in zip(breaks[1:], labels):
        out = out.when(x <= F.lit(float(upper)), F.lit(label))
    return out


def standard_score(c: str | Column, n_classes: int) -> Column:
    return col(c).cast("double") * F.lit(1.0 / n_classes)


def nodata_to_null(c: str | Column, nodata: float | None) -> Column:
    """NULL for non-finite values and for values close to the nodata marker."""
    v = col(c).cast("double")
    missing = ~is_finite(v)
    if nodata is not None:
        missing = missing | (F.abs(v - F.lit(float(nodata))) <= F.lit(1e-8 + 1e-5 * abs(nodata)))
    return F.when(missing, None).otherwise(v)


def significance_stars(p: str | Column) -> Column:
    p = col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def vif_band(v: str | Column) -> Column:
    v = col(v)
    return (
        F.when(v == F.lit(INF), "perfect").when(v >= 10, "high").when(v >= 5, "moderate").otherwise("low")
    )


def format_p(p: str | Column) -> Column:
    """``1.23e-04`` below .001, three decimals from there, empty when missing."""
    p = col(p).cast("double")
    return (
        F.when(p.isNull() | F.isnan(p), "")
        .when(p < 0.001, F.format_string("%.2e", p))
        .otherwise(F.format_string("%.3f", p))
    )


def round_significant(x: str | Column, digits: int = 6) -> Column:
    """Round to a number of significant digits; zero stays zero."""
    x = col(x).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.round(x * scale) / scale)


def pixel_x(c: str | Column, transform: Sequence[float]) -> Column:
    """Map x of a pixel centre; ``transform`` = (a, b, c, d, e, f) without rotation."""
    return F.lit(float(transform[2])) + (col(c) + 0.5) * float(transform[0])


def pixel_y(r: str | Column, transform: Sequence[float]) -> Column:
    return F.lit(float(transform[5])) + (col(r) + 0.5) * float(transform[4])


def pixel_col(x: str | Column, transform: Sequence[float]) -> Column:
    return F.floor((col(x) - float(transform[2])) / float(transform[0])).cast("long")


def pixel_row(y: str | Column, transform: Sequence[float]) -> Column:
    return F.floor((col(y) - float(transform[5])) / float(transform[4])).cast("long")


def semivariance(model: Column, sill: Column, reach: Column, nugget: Column, h: Column) -> Column:
    """Variogram model at distance ``h``.

    ``sill`` is the slope of a linear and the scale of a power model; ``reach``
    is the range, or the exponent of a power model.
    """
    s, r, n = sill.cast("double"), reach.cast("double"), nugget.cast("double")
    unit = h / r
    return (
        F.when(model == "linear", s * h + n)
        .when(model == "power", s * F.pow(h, r) + n)
        .when(model == "gaussian", s * (1.0 - F.exp(-F.pow(unit * 1.75, F.lit(2.0)))) + n)
        .when(model == "exponential", s * (1.0 - F.exp(-3.0 * unit)) + n)
        .when(
            model == "spherical",
            F.when(h <= r, s * (1.5 * unit - 0.5 * F.pow(unit, F.lit(3.0))) + n).otherwise(s + n),
        )
    )


def pretty_label(
    c: str | Column, names: Mapping[str, str], prefixes: Mapping[str, str], suffix: str = "_30m"
) -> Column:
    """Display name: dictionary first, then one-hot prefix as ``Name = value``, then the bare name."""
    c = col(c)
    out = None
    for prefix, name in prefixes.items():
        cond = c.startswith(prefix + "_")
        value = F.concat(F.lit(f"{name} = "), F.substring(c, len(prefix) + 2, 1_000_000))
        out = F.when(cond, value) if out is None else out.when(cond, value)
    bare = F.replace(F.replace(c, F.lit(suffix), F.lit("")), F.lit("_"), F.lit(" "))
    rest = bare if out is None else out.otherwise(bare)
    return F.coalesce(code_lookup(c, names), rest) if names else rest


def contrast_label(a: str | Column, b: str | Column) -> Column:
    return F.concat_ws(" - ", col(a), col(b))


def contrast_side(c: str | Column, side: int) -> Column:
    return F.split(col(c), " - ").getItem(side)


def break_label(i: Column, n: Column, lo: Column, hi: Column, decimals: int = 2) -> Column:
    """Legend text of class ``i`` (from 0) of ``n``: ``< b``, ``lo–hi`` or ``> b``."""
    fmt = f"%.{decimals}f"
    return (
        F.when(i == 0, F.format_string("< " + fmt, hi))
        .when(i == n - 1, F.format_string("> " + fmt, lo))
        .otherwise(F.format_string(fmt + "–" + fmt, lo, hi))
    )


def category_code(c: str | Column) -> Column:
    """Raster code as INT, halves rounded to even."""
    return F.bround(col(c).cast("double"), 0).cast("int")


def hash_uniform(*parts: str | Column) -> Column:
    """Deterministic uniform number in [0, 1) from the md5 of the joined parts."""
    text = F.md5(F.concat_ws(":", *[col(p).cast("string") for p in parts]))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_one(u: Column) -> Column:
    """Poisson(1) count from a uniform number, by its distribution function."""
    total, term, out = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(1, 12):
        total += term
        out = out + F.when(u >= F.lit(total), 1).otherwise(0)
        term /= k
    return out


# Coefficients of algorithm AS 241 (16 digits) for the middle, the tails and the far tails, numerators and denominators.
_MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
_TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function as a column expression; infinite at 0 and 1, NULL outside them."""

    def ratio(parts: tuple, x: Column) -> Column:
        top, bottom = (F.lit(c[-1]) for c in parts)
        for a, b in zip(parts[0][-2::-1], parts[1][-2::-1]):
            top, bottom = top * x + a, bottom * x + b
        return top / bottom

    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1.0 - p)))
    tail = F.when(r <= 5.0, ratio(_TAIL, r - 1.6)).otherwise(ratio(_FAR, r - 5.0))
    inside = F.when(F.abs(q) <= 0.425, q * ratio(_MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * tail)
    return F.when((p > 0) & (p < 1), inside).when(p == 0, float("-inf")).when(p == 1, float("inf"))
