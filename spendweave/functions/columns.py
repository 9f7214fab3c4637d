"""Scalar expressions shared by the operators. All of them stay inside generated code on the JVM."""
from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- money and ratios ------------------------------------------------------

def money(c) -> Column:
    """Strip the noise that the order of a floating sum leaves behind."""
    return F.round(_col(c), config.MONEY_DIGITS)


def money_sum(c) -> Column:
    return money(F.sum(_col(c)))


def ratio(numerator, denominator) -> Column:
    """NULL instead of an error when the denominator is zero."""
    return _col(numerator) / F.nullif(_col(denominator), F.lit(0))


def growth(current, previous) -> Column:
    """Relative change, defined only on a positive base."""
    return F.when(_col(previous) > 0, _col(current) / _col(previous) - 1)


def clip01(c) -> Column:
    """Between 0 and 1; NULL stays NULL, which ``greatest`` and ``least`` alone would skip."""
    value = _col(c)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def headroom(share, benchmark) -> Column:
    """1 at no spend in the category, 0 at or above the benchmark share, also where the benchmark is zero."""
    share, benchmark = _col(share), _col(benchmark)
    return F.when(share >= benchmark, F.lit(0.0)).when(benchmark > 0, clip01(1 - share / benchmark))


def coalesce0(c, kind: str = "double") -> Column:
    return F.coalesce(_col(c), F.lit(0).cast(kind))


# --- calendar --------------------------------------------------------------

def month_of(ts) -> Column:
    return F.trunc(_col(ts), "MM")


def quarter_of(ts) -> Column:
    return F.trunc(_col(ts), "QUARTER")


def month_number(d) -> Column:
    """Months since year zero, so that differences count calendar months."""
    return (F.year(_col(d)) * 12 + F.month(_col(d))).cast("long")


def is_weekend(ts) -> Column:
    return F.weekday(_col(ts)) >= 5


def is_late_night(ts) -> Column:
    hour = F.hour(_col(ts))
    return (hour >= 22) | (hour < 5)


# --- bands and labels ------------------------------------------------------

def _ladder(value: Column, steps, otherwise=None) -> Column:
    """First step whose bound lies above the value; a bound of None takes the rest."""
    out = None
    for bound, label in steps:
        if bound is None:
            otherwise = label
            continue
        out = F.when(value < bound, label) if out is None else out.when(value < bound, label)
    return out.otherwise(otherwise)


def generation(birth_year) -> Column:
    steps = [(last + 1, name) for name, last in config.GENERATION_LAST_YEAR.items()]
    return _ladder(_col(birth_year), [*steps, (None, config.GENERATIONS[-1])])


def city_size_band(population) -> Column:
    return _ladder(_col(population), config.CITY_BANDS)


def effect_label(effect) -> Column:
    effect = _col(effect)
    return F.when(effect.isNull() | F.isnan(effect), "n/a").otherwise(_ladder(effect, config.EFFECT_BANDS))


# fixed values: the labels and bounds of ticket bands and hour blocks
def ticket_band(amount) -> Column:
    return _ladder(_col(amount), ((100, "Under $100"), (500, "$100 to $499"), (None, "$500 or more")))


def hour_block(ts) -> Column:
    return F.when(F.hour(_col(ts)) < 12, "00:00 to 11:59").otherwise("12:00 to 23:59")


def age_band(birth_year, first_cut, second_cut) -> Column:
    """Right-closed intervals; without a second cut there are only two bands."""
    older, middle, younger = config.AGE_BANDS
    year = _col(birth_year)
    return (F.when(year <= _col(first_cut), older)
            .when(_col(second_cut).isNull() | (year <= _col(second_cut)), middle)
            .otherwise(younger))


def txns_per_day_tier(n_txns="n_txns", active_months="active_months", half_even: bool = True) -> Column:
    per_day = _col(n_txns) / (_col(active_months) * config.DAYS_PER_MONTH)
    return (F.bround(per_day) if half_even else F.round(per_day)).cast("long")


def category_group(category) -> Column:
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in config.CATEGORY_TO_GROUP.items()))
    return F.coalesce(F.try_element_at(pairs, _col(category)), F.lit(config.UNMAPPED))


def channel(category) -> Column:
    category = _col(category)
    return (F.when(category.endswith("_net"), "online")
            .when(category.endswith("_pos"), "in_store")
            .otherwise("untagged"))


def widest(columns, labels) -> Column:
    """Label of the largest column; the first one wins a tie."""
    top = F.greatest(*columns)
    return F.coalesce(*[F.when(F.col(c) == top, F.lit(label)) for c, label in zip(columns, labels)])


# --- portable hash ---------------------------------------------------------

def hash32(*parts) -> Column:
    """Unsigned 32 bit number from the parts, equal on every engine that has md5."""
    text = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


# --- distribution tails ----------------------------------------------------

def chi2_survival(statistic, dof) -> Column:
    """P(X > statistic) for a chi-square variable, by the incomplete gamma function of the JVM's math library."""
    statistic, dof = _col(statistic).cast("double"), _col(dof).cast("double")
    known = statistic.isNotNull() & (dof > 0)
    tail = F.reflect(F.lit("org.apache.commons.math3.special.Gamma"), F.lit("regularizedGammaQ"),
                     F.when(known, dof / 2).otherwise(F.lit(1.0)), F.when(known, statistic / 2).otherwise(F.lit(0.0)))
    return F.when(known, tail.cast("double"))


def add_all(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)
