"""Contacts and what they bring: one offer per customer and month, and the lift of the treated over the held-out customers."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import columns as C

# which offer is sent when several triggers fire at once: travel has more spend at stake than dining
PRIORITY = ("travel_drop", "first_travel", "dining_cooling")
NEVER = -1_000_000           # position of a month long before the first
ALL_SEGMENTS = "All segments"
NORMAL_95 = 1.959963984540054


# --- arbitration -----------------------------------------------------------

def arbitrate(states: DataFrame, cooldown: int, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Every fire with ``sent`` and, where it isn't, the trigger that was sent instead (``outranked_by``).

    ``states`` has a row for each month in which a customer is in a trigger's state. A trigger fires when its last state lies more than
    ``cooldown`` months back. Of the fires of a customer and month the first by ``priority`` is sent. An outranked fire doesn't start its
    trigger's silence: it comes back in the next month if the customer is still in its state. So each month depends on those before, and
    a customer's months are folded in order, as one array of at most months x triggers states, inside the JVM. Triggers that
    aren't in ``priority`` are left out.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in priority]), F.col("trigger_name")).cast("int")
    ranked = states.withColumn("rank", rank).where("rank > 0")
    history = ranked.groupBy("customer_id").agg(
        F.sort_array(F.collect_list(F.struct("month_idx", "rank", "month", "spend_at_stake"))).alias("states"))
    types = dict(ranked.dtypes)
    fire = f"struct<month:{types['month']},rank:int,spend_at_stake:{types['spend_at_stake']},winner:int>"
    start = F.struct(F.array_repeat(F.lit(NEVER), len(priority)).alias("last"), F.lit(NEVER).alias("busy"), F.lit(0).alias("winner"),
                     F.array().cast(f"array<{fire}>").alias("fires"))

    def step(seen: Column, now: Column) -> Column:
        at = now["month_idx"].cast("int")
        fires = at - F.get(seen["last"], now["rank"] - 1) > cooldown
        taken = seen["busy"] == at
        sends = fires & ~taken
        winner = F.when(sends, now["rank"]).otherwise(seen["winner"])
        last = F.transform(seen["last"], lambda v, i: F.when((i == now["rank"] - 1) & ~(fires & taken), at).otherwise(v))
        row = F.struct(now["month"].alias("month"), now["rank"].alias("rank"), now["spend_at_stake"].alias("spend_at_stake"), winner.alias("winner"))
        return F.struct(last.alias("last"), F.when(sends, at).otherwise(seen["busy"]).alias("busy"), winner.alias("winner"),
                        F.when(fires, F.concat(seen["fires"], F.array(row))).otherwise(seen["fires"]).alias("fires"))

    names = F.array(*[F.lit(t) for t in priority])
    folded = history.select("customer_id", F.inline(F.aggregate("states", start, step, lambda s: s["fires"])))
    sent = F.col("rank") == F.col("winner")
    return folded.select("customer_id", "month", F.get(names, F.col("rank") - 1).alias("trigger_name"), "spend_at_stake", sent.alias("sent"),
                         F.when(~sent, F.get(names, F.col("winner") - 1)).alias("outranked_by"))


# --- read-out --------------------------------------------------------------

def outcomes(arms: DataFrame, panel: DataFrame, months: int = 3) -> DataFrame:
    """(segment_name, trigger_name, customer_id, held_out, before, after): a customer's first fire of each trigger, with the spend that the
    trigger is about in the ``months`` months before and after it. Fires without all months after them are left out.

    Both sums are windows over the customer's months, on the panel's own partitioning.
    """
    number = C.month_number("month")
    columns = sorted(set(config.OUTCOME_COLUMN.values()))
    own = Window.partitionBy("customer_id").orderBy("month_no")
    spans = {"before": own.rangeBetween(-months, -1), "after": own.rangeBetween(1, months)}
    sums = {f"{c}_{label}": C.coalesce0(C.money(F.sum(c).over(span))) for c in columns for label, span in spans.items()}
    around = panel.withColumn("month_no", number).withColumns(sums).select("customer_id", "month", "month_no", *sums)
    last = F.broadcast(panel.agg(F.max(number).alias("last_no")))           # one row
    first = (arms.where(F.col("trigger_name").isin(*config.OUTCOME_COLUMN)).groupBy("customer_id", "trigger_name", "segment_name", "held_out")
             .agg(F.min("month").alias("month")))
    fired = first.join(around, ["customer_id", "month"]).crossJoin(last).where(F.col("month_no") + months <= F.col("last_no"))
    pick = lambda label: F.coalesce(*[F.when(F.col("trigger_name") == t, F.col(f"{c}_{label}"))
                                      for t, c in config.OUTCOME_COLUMN.items()]).alias(label)
    return fired.select("segment_name", "trigger_name", "customer_id", "held_out", pick("before"), pick("after"))


def lift(results: DataFrame, keys: tuple[str, ...] = ("segment_name", "trigger_name")) -> DataFrame:
    """Treated minus held out on ``after`` with a 95 % interval, plain and with ``before`` as covariate, for each combination of keys.

    The adjusted lift is the coefficient of the arm in a regression of ``after`` on arm and ``before``; its variance is the sandwich (HC1).
    Two passes with map-side sums, so a group may hold any share of the rows: the first takes means and covariances,
    the second the squared residuals. Without spread in ``before``, or when it determines the arm, the covariate is left out. A group
    with one arm alone has no lift, one with no more rows than coefficients no interval.
    """
    rows = results.withColumns({"t": F.when(F.col("held_out"), F.lit(0.0)).otherwise(F.lit(1.0)),
                                "x": F.col("before").cast("double"), "y": F.col("after").cast("double")}).where("held_out is not null and x is not null and y is not null")
    arm = lambda value, f, c: f(F.when(F.col("t") == value, F.col(c)))
    moments = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in "txy"], F.var_pop("t").alias("tt"), F.var_pop("x").alias("xx"),
        F.covar_pop("t", "x").alias("tx"), F.covar_pop("t", "y").alias("ty"), F.covar_pop("x", "y").alias("xy"),
        arm(1.0, F.count, "y").alias("treated"), arm(0.0, F.count, "y").alias("held_out"),
        arm(1.0, F.avg, "y").alias("treated_mean"), arm(0.0, F.avg, "y").alias("holdout_mean"),
        arm(1.0, F.var_samp, "y").alias("treated_var"), arm(0.0, F.var_samp, "y").alias("holdout_var"))
    room = F.col("tt") * F.col("xx") - F.col("tx") * F.col("tx")
    adjusts = F.coalesce((F.col("xx") > 0) & (room > 1e-9 * F.col("tt") * F.col("xx")), F.lit(False))
    both = F.when(adjusts, (F.col("ty") * F.col("xx") - F.col("xy") * F.col("tx")) / room).otherwise(C.ratio("ty", "tt"))
    solved = (moments.withColumns({"adjusts": adjusts, "b": both})
              .withColumns({"c": F.when(F.col("adjusts"), (F.col("xy") - F.col("b") * F.col("tx")) / F.col("xx")).otherwise(0.0),
                            "of_x": F.when(F.col("adjusts"), F.col("tx") / F.col("xx")).otherwise(0.0)}))
    t, x, y = [F.col(c) - F.col(f"mean_{c}") for c in "txy"]
    share = t - F.col("of_x") * x                                     # the arm, as far as the covariate doesn't tell it
    residual = y - F.col("b") * t - F.col("c") * x
    small = F.broadcast(solved.select(*[F.col(k).alias(f"_{k}") for k in keys], "b", "c", "of_x", *[f"mean_{c}" for c in "txy"]))  # segments x triggers
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    spread = rows.join(small, same).groupBy(*keys).agg(F.sum(share * share).alias("ss"), F.sum(share * share * residual * residual).alias("meat"))
    spread = F.broadcast(spread.select(*[F.col(k).alias(f"_{k}") for k in keys], "ss", "meat"))
    free = F.col("n") - F.when(F.col("adjusts"), 3).otherwise(2)
    error = F.sqrt(F.when((free > 0) & (F.col("ss") > 0), F.col("n") / free * F.col("meat") / (F.col("ss") * F.col("ss"))))
    plain = F.sqrt(F.col("treated_var") / F.col("treated") + F.col("holdout_var") / F.col("held_out"))
    return solved.join(spread, same).withColumn("std_error", error).select(
        *keys, "treated", "held_out", "treated_mean", "holdout_mean", (F.col("treated_mean") - F.col("holdout_mean")).alias("plain_lift"),
        plain.alias("plain_std_error"), F.col("b").alias("lift"), "std_error", (F.col("b") - NORMAL_95 * F.col("std_error")).alias("ci_low"),
        (F.col("b") + NORMAL_95 * F.col("std_error")).alias("ci_high"))


def lift_readout(arms: DataFrame, panel: DataFrame) -> DataFrame:
    """The lift per trigger, for every segment and for all of them together."""
    own = outcomes(arms, panel)
    scopes = F.explode(F.array(F.coalesce("segment_name", F.lit("")), F.lit(ALL_SEGMENTS)))
    return lift(own.withColumn("scope", scopes).drop("segment_name").withColumnRenamed("scope", "segment_name"))
