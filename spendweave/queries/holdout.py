"""Holdout arms of the trigger events at account grain, assigned in two batches; contacts and lift."""
from __future__ import annotations

from ..operators import contacts, holdout, triggers
from ..plans.workbench import bench_for
from .backtest import RULES, labels
from .features import rounded


def _arms(spark, sf):
    return bench_for(spark, sf, "account").arms(RULES, labels(spark, sf))


def holdout_assignment(spark, sf):
    return _arms(spark, sf)[0]


def holdout_balance(spark, sf):
    return holdout.balance(_arms(spark, sf)[1])


def contact_arbitration(spark, sf):
    panel = bench_for(spark, sf, "account").customer_month
    return rounded(contacts.arbitrate(triggers.trigger_states(panel, RULES), RULES.cooldown_months), "spend_at_stake", digits=4)


def lift_readout(spark, sf):
    out = contacts.lift_readout(_arms(spark, sf)[1], bench_for(spark, sf, "account").customer_month)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"], digits=4)


QUERIES = {f.__name__: f for f in (holdout_assignment, holdout_balance, contact_arbitration, lift_readout)}
