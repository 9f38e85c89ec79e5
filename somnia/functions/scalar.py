"""Column functions; all stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EPS = 2.220446049250313e-16


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column) -> Column:
    """Quotient, NULL where the divisor is 0."""
    return num / F.nullif(den, F.lit(0.0))


def clip(x, lo: float, hi: float) -> Column:
    return F.when(col(x).isNotNull(), F.greatest(F.least(col(x), F.lit(hi)), F.lit(lo)))


def most_frequent(label, classes: list[int] | None = None) -> Column:
    """Aggregate: most frequent label, the smallest on ties.

    With a list of ``classes`` this is one counter per class, which hash
    aggregation in generated code combines before the shuffle; a label outside
    the list is an error. Without it, ``mode`` keeps a map per group.
    """
    if classes is None:
        return F.mode(label, True)
    known = sorted(classes)
    counts = F.array(*[F.count(F.when(col(label) == c, 1)) for c in known])
    best = F.get(F.array(*[F.lit(c) for c in known]), (F.array_position(counts, F.array_max(counts)) - 1).cast("int"))
    other = F.max(F.when(~col(label).isin(known), col(label)))
    wrong = F.raise_error(F.format_string("label %s is not among the classes", other.cast("string")))
    return F.when(other.isNotNull(), wrong).when(F.array_max(counts) > 0, best)


def logistic(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def safe_ln(x) -> Column:
    """Natural log, NULL where it is not defined."""
    return F.when(col(x) > 0, F.ln(col(x)))


def log2(x) -> Column:
    return F.ln(x) / F.lit(math.log(2.0))


def ratio_indices(theta="theta", delta="delta", sigma="sigma", gamma="gamma", emg="emg",
                  theta_power: str = "code") -> dict[str, Column]:
    """The seven band ratios.

    ``theta_power='code'`` uses ``2 * theta`` in index_r, which is what the
    studied program computes; ``'square'`` uses ``theta ** 2``, which its
    description says.
    """
    t, d, s, g, e = (col(c) for c in (theta, delta, sigma, gamma, emg))
    top = t * 2 if theta_power == "code" else t * t
    return {
        "index_w": ratio(e * e * g, t),
        "index_r": ratio(top * g, d * d * e * e),
        "index_n": ratio(s * d, g * g),
        "index_1": ratio(e * g, d),
        "index_2": ratio(s * d, t),
        "index_3": ratio(t * g, d),
        "index_4": ratio(d, t),
    }


def argmax(scores) -> Column:
    """Position from 0 of the first largest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def one_hot(label, n_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                       lambda i: (i == col(label)).cast("double"))


def mix_labels(one_hot_labels, alpha, n_classes: int) -> Column:
    a = F.lit(alpha) if isinstance(alpha, float) else col(alpha)
    return F.transform(one_hot_labels, lambda y: (1 - a) * y + a / n_classes)


def code_string(bits) -> Column:
    return F.array_join(F.transform(bits, lambda b: b.cast("int").cast("string")), "")


def code_number(code) -> Column:
    return F.conv(col(code), 2, 10).cast("long")


def code_key(code, skip_bits: int = 11) -> Column:
    """The part of a state code left after the leading covariance bits."""
    return F.substring(col(code), skip_bits + 1, 1 << 20)


def group_digit(subject) -> Column:
    return F.substring(col(subject).cast("string"), 1, 1).cast("int")


def serial_day(day, base_epoch_sec: float) -> Column:
    """Fractional serial day to timestamp; day 0 is ``base_epoch_sec``."""
    return F.timestamp_seconds(col(day) * F.lit(86400.0) + F.lit(float(base_epoch_sec)))


def pad_suffix(name) -> Column:
    """``TR1`` to ``TR01``; NULL for a name without a number at its end."""
    base, num = F.regexp_extract(name, r"^(\D+)(\d+)$", 1), F.regexp_extract(name, r"^(\D+)(\d+)$", 2)
    bare = F.regexp_replace(num, r"^0+(?=\d)", "")
    return F.when(num != "", F.concat(base, F.when(F.length(bare) < 2, F.lpad(bare, 2, "0")).otherwise(bare)))


def bare_suffix(name) -> Column:
    """``TR01`` to ``TR1``."""
    base, num = F.regexp_extract(name, r"^(\D+)(\d+)$", 1), F.regexp_extract(name, r"^(\D+)(\d+)$", 2)
    return F.when(num != "", F.concat(base, F.regexp_replace(num, r"^0+(?=\d)", "")))


def lookup(mapping: dict, key, default=None) -> Column:
    """Map lookup with a default, from a small fixed dictionary."""
    pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    found = F.try_element_at(pairs, col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def recording_parts(name) -> dict[str, Column]:
    """``Rat<i>_SD<j>_<condition>[_<treatment>]_posttrial<k>`` taken apart."""
    pattern = r"^Rat(\d+)_SD(\d+)_([A-Za-z]+)(?:_([A-Za-z]+))?_posttrial(\d+)$"
    part = lambda g: F.regexp_extract(name, pattern, g)
    return {"rat": part(1).cast("int"), "day": part(2).cast("int"), "condition": part(3),
            "treatment": F.nullif(part(4), F.lit("")), "trial": part(5).cast("int")}


def dominant(props: dict[str, Column], threshold: float | None = None,
             other: str = "mixed") -> Column:
    """Name of the share above ``threshold``, or of the strictly largest share."""
    out = F.lit(other)
    for name, p in reversed(list(props.items())):
        rest = [q for n, q in props.items() if n != name]
        rule = p > threshold if threshold is not None else p > (F.greatest(*rest) if len(rest) > 1 else rest[0])
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def sign_over_slope(correlation, slope) -> Column:
    """Sign of a correlation over a slope; NULL where the slope is 0."""
    return ratio(F.signum(correlation), col(slope))
