"""Fixed values that results depend on."""

# Account status sets.
ARREARS_STATUSES = ["Arrears", "No Deposit"]
DEFAULT_STATUSES = ["Write Off", "Repossession", "Repossed"]
HEALTHY_STATUSES = ["Complete", "Advance"]
# The snapshot fact counts only this status as being in arrears.
SNAPSHOT_ARREARS_STATUSES = ["Arrears"]

# Risk category by account status; anything else is "Low Risk".
RISK_CATEGORY = {
    "Arrears": "High Risk",
    "Complete": "Low Risk",
    "Repossession": "High Risk",
    "Repossed": "High Risk",
    "Refunded": "Low Risk",
    "Write Off": "High Risk",
    "No Deposit": "Low Risk",
    "Advance": "Low Risk",
}

# Currency by raw region; anything else is "KES".
CURRENCY = {"uganda": "USh", "kenya": "KSh", "civ": "CFA Franc"}

# Display name by raw region; anything else is put in title case.
COUNTRY_NAMES = {"kenya": "Kenya", "uganda": "Uganda", "civ": "Côte d'Ivoire"}

# Numeric ids used by the second lead funnel; anything else is 0.
LEAD_SOURCE_IDS = {
    "Roadshow": 1,
    "Refer and Earn": 2,
    "Facebook": 3,
    "Website": 4,
    "Walk-in": 5,
    "Telesales": 6,
    "Door to Door": 7,
    "Partners": 8,
}
COUNTRY_IDS = {"kenya": 1, "uganda": 2, "civ": 3}

# Product tiers and their ordinals; an unknown tier counts 2.
TIER_NEW = "New"
TIER_REFURBISHED = "Refurbished"
TIER_ORDINAL = {"New": 3, "Refurbished": 1}

# Money proxies per tier ordinal, and outstanding share by account health.
FINANCED_PER_TIER_PAYG = 50_000
FINANCED_PER_TIER_CASH = 80_000
OUTSTANDING_SHARE_HEALTHY = 0.2
OUTSTANDING_SHARE_DEFAULT = 0.9
OUTSTANDING_SHARE_OTHER = 0.55
ARREARS_SHARE = 0.4

# Lead quality weights: (account, sale, installation), then the speed bonus.
LEAD_QUALITY_WEIGHTS = (0.4, 0.3, 0.3)
LEAD_QUALITY_WEIGHTS_WITH_SPEED = (0.4, 0.3, 0.2)
LEAD_SPEED_WEIGHT = 0.1
LEAD_SPEED_DECAY_DAYS = 90

# Features used for clustering.
NUMERIC_FEATURES = [
    "age",
    "account_age_days",
    "financed_amount_log",
    "outstanding_to_financed",
    "repayment_progress",
    "arrears_rate",
    "days_past_due_cap",
    "lead_conversion_speed",
    "installation_delay_days",
    "lead_quality_score",
    "recency_score",
    "frequency_score",
    "monetary_score",
    "risk_stress_score",
]
CATEGORICAL_FEATURES = [
    "country_name",
    "gender",
    "age_bucket",
    "payment_type",
    "product_tier",
    "lead_source",
]
BINARY_FEATURES = ["is_in_arrears", "is_default", "is_healthy", "install_delay_flag"]

# Metrics shown in a segment profile.
PROFILE_METRICS = [
    "age",
    "account_age_days",
    "financed_amount",
    "outstanding_balance",
    "repayment_progress",
    "arrears_rate",
    "days_past_due",
    "is_in_arrears",
    "is_default",
    "risk_stress_score",
    "lead_conversion_speed",
    "installation_delay_days",
]

# Campaign score: weights of the positive parts, then the two penalties.
CAMPAIGN_WEIGHTS = {
    "stability": 0.35,
    "affluence": 0.25,
    "growth": 0.15,
    "size": 0.15,
    "low_default": 0.10,
}
CAMPAIGN_ARREARS_PENALTY = 0.5
CAMPAIGN_DEFAULT_PENALTY = 0.4

# A segment is eligible for the premium campaign within these limits.
ELIGIBLE_MAX_ARREARS = 0.15
ELIGIBLE_MAX_DEFAULT = 0.10
ELIGIBLE_MIN_STABILITY = 0.55

# Sheets of the raw input.
SHEETS = [
    "Customers",
    "Departments",
    "Users",
    "Products",
    "Leads",
    "Installations",
    "Accounts",
    "Sales",
]
