"""Fixed values and tunable thresholds."""
from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values. They have to be exactly these for results to agree.
# ---------------------------------------------------------------------------

GENERATIONS = ("Silent", "Boomers", "Gen X", "Millennials", "Gen Z")
# generation -> last birth year that belongs to it (Gen Z is open ended)
GENERATION_LAST_YEAR = {"Silent": 1945, "Boomers": 1964, "Gen X": 1980, "Millennials": 1996}

CATEGORY_TO_GROUP = {
    "travel": "travel",
    "food_dining": "dining_entertainment",
    "entertainment": "dining_entertainment",
    "grocery_pos": "grocery",
    "grocery_net": "grocery",
    "gas_transport": "gas_transport",
    "shopping_pos": "shopping",
    "shopping_net": "shopping",
    "health_fitness": "health_personal",
    "personal_care": "health_personal",
    "home": "home_kids_pets",
    "kids_pets": "home_kids_pets",
    "misc_pos": "misc",
    "misc_net": "misc",
}
GROUP_LABELS = {
    "travel": "Travel",
    "dining_entertainment": "Dining and entertainment",
    "grocery": "Grocery",
    "gas_transport": "Gas and transport",
    "shopping": "Shopping",
    "health_personal": "Health and personal care",
    "home_kids_pets": "Home, kids and pets",
    "misc": "Misc",
}
UNMAPPED = "unmapped"

# upper bound (exclusive) -> label; the last band is open ended
CITY_BANDS = ((2_500, "1 Rural (<2.5k)"), (25_000, "2 Small town (2.5k-25k)"),
              (250_000, "3 Mid city (25k-250k)"), (None, "4 Large city (250k+)"))

AGE_BANDS = ("Older band", "Middle band", "Younger band")
# upper bound (exclusive) of the effect size -> label; the last label is open ended
EFFECT_BANDS = ((0.01, "negligible"), (0.06, "small"), (0.14, "medium"), (None, "large"))
DAYS_PER_MONTH = 30.44

TRIGGERS = ("travel_drop", "first_travel", "dining_cooling")
DROP_TRIGGERS = ("travel_drop", "dining_cooling")
TRIGGER_LABELS = {"travel_drop": "Travel drop", "first_travel": "First travel", "dining_cooling": "Dining cooling"}
OUTCOME_COLUMN = {"travel_drop": "travel_spend", "first_travel": "travel_spend", "dining_cooling": "dining_spend"}

# ordered segment naming thresholds: index of a segment mean against the portfolio mean
SEGMENT_NAMES = {
    "travel": (2.0, "Big-Ticket Travelers"),
    "online": (1.15, "Digital Shoppers"),
    "spend_high": (1.3, "Premium Household Shoppers"),
    "spend_low": (0.75, "Light Home and Dining Spenders"),
    "other": (None, "Mainstream Everyday Spenders"),
}

# benefit -> label, engagement column, category spend column
BENEFITS = {
    "dining_credit": ("Monthly dining credit", "dining_active_month_share", "monthly_dining_spend"),
    "travel_credit": ("Annual travel credit", "travel_active_year_share", "monthly_travel_spend"),
}
HEADROOM_QUANTILE = 0.90

Z_ALPHA, Z_POWER = 1.96, 0.84
HOLDOUT_SHARE = 0.10
N_PLACEBO = 20
N_RESAMPLES = 2000
CHOSEN_K = 5
K_RANGE = tuple(range(3, 9))
MIN_GROUP_SIZE = 20

# Column lists, fixed values too: names and order of result columns.

CATEGORY_GROUPS = tuple(GROUP_LABELS)
SHARE_COLUMNS = tuple(f"share_{g}" for g in CATEGORY_GROUPS)
CLUSTER_COLUMNS = ("monthly_spend", "monthly_txns", "avg_ticket", *SHARE_COLUMNS, "online_share", "weekend_share",
                   "late_night_share", "spend_volatility")
GENERATION_METRICS = (*SHARE_COLUMNS, "online_share", "avg_ticket", "median_ticket", "monthly_txns", "monthly_spend",
                      "weekend_share", "late_night_share")

# Sums of money are rounded to this many digits straight after each aggregation. Floating sums depend on the order
# in which shuffled rows arrive; without this, a rule with a strict comparison could flip between two runs.
MONEY_DIGITS = 4


@dataclass(frozen=True)
class TriggerRules:
    """Thresholds of the three behaviour triggers. The defaults are fixed values."""

    travel_drop_pct: float = 0.50
    travel_min_base: float = 200.0
    first_travel_min_history: int = 3
    dining_min_base: int = 4
    dining_min_drop: float = 0.50
    cooldown_months: int = 2
    portfolio_adjust: int = 1

    def override(self, **changes) -> "TriggerRules":
        return replace(self, **changes)


# Rule variant -> (changed thresholds, triggers the change can move)
SENSITIVITY_VARIANTS = {
    "Naive rule (no portfolio adjustment, no floors, no cooldown)": (
        dict(portfolio_adjust=0, travel_min_base=0.01, dining_min_base=1, dining_min_drop=0.0, cooldown_months=0),
        DROP_TRIGGERS),
    "Default without portfolio adjustment": (dict(portfolio_adjust=0), DROP_TRIGGERS),
    "Default": ({}, TRIGGERS),
    "Travel base $500": (dict(travel_min_base=500.0), ("travel_drop",)),
    "Travel base $1,000": (dict(travel_min_base=1000.0), ("travel_drop",)),
    "Dining base 6 transactions": (dict(dining_min_base=6), ("dining_cooling",)),
    "First travel after 6 months of history": (dict(first_travel_min_history=6), ("first_travel",)),
}
