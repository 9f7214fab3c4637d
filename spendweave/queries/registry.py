"""All named queries."""
from . import backtest, features, generations, holdout, profile, segmentation, segments

QUERIES = {}
for _module in (features, backtest, holdout, profile, generations, segments, segmentation):
    QUERIES.update(_module.QUERIES)
