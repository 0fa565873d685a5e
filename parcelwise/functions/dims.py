"""Fixed values of the scoring rules.

Everything in this module is a constant that must equal the product's rules
for results to agree; it is stated once, plainly, in the product's order.
Rules that use these values live in ``parcelwise.functions.rules`` and turn
them into literal map lookups (no join, no broadcast needed).
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — construction era
# ---------------------------------------------------------------------------
MIN_VALID_YEAR = 1800
MAX_VALID_YEAR = 2025
CRITICAL_YEAR = 1960          # before: pre-1960 legacy
ELEVATED_YEAR = 1974          # before: rent-stabilised era
ERA_MULT_CRITICAL = 3.8
ERA_MULT_ELEVATED = 2.5
ERA_MULT_BASELINE = 1.0

ERA_EXPLANATION = {
    "unknown": "Unknown construction year (baseline risk)",
    "modern": "Modern construction",
    "elevated": "Rent-stabilized era (elevated risk)",
    "critical": "Pre-1960 (critical risk - lead/heat)",
}

# era -> (era label, explanation, risk factors, action items)
ERA_DETAIL = {
    "unknown": (
        "Unknown",
        "Unknown construction year - baseline risk assumed",
        ["Missing building data"],
        ["Verify building records with DOB"],
    ),
    "modern": (
        "Modern (1974+)",
        "Post-1974 construction with modern building codes",
        [],
        ["Standard maintenance schedule"],
    ),
    "elevated": (
        "Rent-Stabilized Era (1960-1973)",
        "Pre-1974 rent-stabilized building with elevated violation risk",
        [
            "Built before lead paint ban (1960)",
            "Potential rent stabilization (RSL complexity)",
            "Aging HVAC systems",
            "2.5x higher violation rate vs. modern buildings",
        ],
        [
            "Prioritize heat system inspections (Oct-May)",
            "Review rent stabilization compliance",
            "Schedule preventive maintenance",
            "Monitor HPD complaint patterns",
        ],
    ),
    "critical": (
        "Pre-1960 Legacy",
        "Pre-1960 building with critical risk factors",
        [
            "Lead paint hazard (pre-1960 construction)",
            "Boiler/heating system age (primary complaint driver)",
            "Original plumbing/electrical systems",
            "HPD heat complaints 4.2x higher than modern",
            "3.8x overall violation rate",
            "Class C violation risk elevated in winter",
        ],
        [
            "URGENT: Heat system inspection before Oct 1",
            "Lead paint disclosure verification",
            "Consider HVAC replacement (ROI: avoid $10K-25K fines)",
            "Weekly monitoring during heat season (Oct-May)",
            "Tenant communication protocol for heat issues",
        ],
    ),
}

# Class-aware era multiplier (documented rule): before 1974 by violation class.
ERA_CLASS_MULT = {"C": 3.8, "B": 3.2}
ERA_CLASS_MULT_OTHER = 2.5

# ---------------------------------------------------------------------------
# FIXED VALUES — inspector districts and boroughs
# ---------------------------------------------------------------------------
INSPECTOR_HOTSPOTS = {
    "brooklyn_council_35": 1.9,
    "brooklyn_council_36": 2.3,
    "brooklyn_council_39": 1.7,
    "brooklyn_council_41": 1.8,
    "manhattan_council_7": 2.1,
    "manhattan_council_9": 1.9,
    "manhattan_council_10": 1.6,
    "queens_council_22": 1.7,
    "queens_council_25": 1.5,
    "queens_council_26": 1.6,
    "bronx_council_8": 2.0,
    "bronx_council_14": 1.8,
    "bronx_council_15": 2.2,
    "bronx_council_17": 1.9,
}

BOROUGH_BASELINES = {
    "brooklyn": 1.2,
    "manhattan": 1.3,
    "queens": 1.1,
    "bronx": 1.4,
    "staten_island": 0.9,
}

BOROUGH_CODES = {
    "1": "manhattan",
    "2": "bronx",
    "3": "brooklyn",
    "4": "queens",
    "5": "staten_island",
}

HOTSPOT_ACTIONS = {
    "CRITICAL": [
        "URGENT: Proactive compliance review recommended",
        "Expect faster 311 complaint → HPD inspection conversion",
        "Consider preventive maintenance acceleration",
        "HPD response time: 7-14 days (vs. 30+ days citywide)",
        "High probability of follow-up inspections",
    ],
    "ELEVATED": [
        "Elevated inspector presence in area",
        "Monitor 311 complaints closely",
        "Standard maintenance schedule recommended",
        "HPD response time: 14-21 days",
    ],
    "STANDARD": [
        "Standard enforcement patterns",
        "Regular maintenance schedule sufficient",
    ],
}
HOTSPOT_DESCRIPTION = {
    "CRITICAL": "High-priority HPD enforcement zone",
    "ELEVATED": "Increased inspector presence",
    "STANDARD": "Standard enforcement patterns",
}

# District enforcement tiers (documented rule; cut-points are terciles here).
ENFORCEMENT_TIER_MULT = [2.3, 1.8, 1.5]

# ---------------------------------------------------------------------------
# FIXED VALUES — heat season
# ---------------------------------------------------------------------------
SEASON_NOTES = {
    "peak": "PEAK HEAT SEASON: 62% of annual $10K+ fines occur in this period",
    "active": "Active heat season: Elevated complaint and violation risk",
    "season": "Heat season: Monitor temperatures and complaints",
    "off": "Off season: Low heat-related risk",
}

# urgency -> (days to violation, fine range, action)
HEAT_URGENCY = {
    "CRITICAL": (7, "$10K-$25K Class C", "IMMEDIATE HVAC inspection required. Class C violation imminent."),
    "HIGH": (14, "$5K-$15K Class B/C", "HVAC inspection within 7 days. Monitor complaints daily."),
    "MODERATE": (21, "$1K-$5K Class A/B", "Schedule preventive maintenance. Review heat complaints."),
    "LOW": (30, "Low risk", "Monitor weather and complaints. Standard schedule OK."),
}

WINTER_RECOMMENDATIONS = {
    "CRITICAL": [
        "🚨 URGENT: Emergency HVAC inspection within 24-48 hours",
        "Notify tenants of maintenance schedule",
        "Prepare for potential HPD inspection",
        "Review emergency contractor contacts",
    ],
    "HIGH": [
        "⚠️  Schedule HVAC inspection within 7 days",
        "Test heating system in all units",
        "Review tenant complaint logs",
        "Prepare compliance documentation",
    ],
    "MODERATE": [
        "Schedule routine HVAC maintenance",
        "Monitor weather forecasts",
        "Review winterization checklist",
    ],
}
WINTER_PRE1960_RECOMMENDATION = "Consider HVAC system replacement (ROI: avoid repeat fines)"

# Heat complaint → class C conversion (documented): 0.87 per complaint in 14 days.
HEAT_PROBABILITY_PER_COMPLAINT = 0.87
HEAT_PROBABILITY_COLD_FACTOR = 1.5
HEAT_PROBABILITY_HIGH = 0.7

# ---------------------------------------------------------------------------
# FIXED VALUES — building-department category classifier
# ---------------------------------------------------------------------------
CLASS_C_KEYWORDS = ["IMMEDIATELY HAZARDOUS", "EMERGENCY", "COLLAPSE", "STRUCTURAL"]
CLASS_B_KEYWORDS = ["HAZARDOUS", "SAFETY", "FIRE", "ELECTRICAL", "PLUMBING"]
RESOLVED_DISPOSITIONS = ["RESOLVED", "DISMISSED", "CLOSED"]

# ---------------------------------------------------------------------------
# FIXED VALUES — money, tiers, feeds
# ---------------------------------------------------------------------------
FINE_BY_CLASS = {"C": 5000, "B": 2500, "A": 500}
TIER_LIMITS = {"free": 10, "pro": 1000, "enterprise": 10000}
TIER_PRICE = {"pro": 297, "enterprise": 999}
PROFIT_MARGIN = 0.85
FREE_TIER_BUILDINGS = 3
RELEVANT_311_TYPES = ["HEAT/HOT WATER", "PLUMBING"]
FEED_DAYS_BACK = 90
HIGH_RISK_SCORE = 70            # 0-100 property scale
HIGH_RISK_VIOLATION = 7.0       # violation risk_score scale
WINTER_LOSS_PER_PRE1960 = 15000
ANNUAL_LOSS_PER_HIGH_RISK = 8000
WINTER_TEMPLATE_RANGE = (15000, 25000)     # a pre-1960 building, on the report page
ANNUAL_TEMPLATE_RANGE = (5000, 15000)      # a pre-1974 building, on the report page

# FIXED VALUES — retention by data class
RETENTION = {
    "violations": {"keep_months": 84},
    "audit_logs": {"keep_months": 84},
    "api_logs": {"keep_days": 90},
    "metrics": {"keep_months": 12},
}

# FIXED VALUES — properties a tenant may hold unless its plan says otherwise
TENANT_PROPERTIES = 100

# Message protocol of the push feed.
MESSAGE_TYPES = ["SUBSCRIBE", "UNSUBSCRIBE", "GET_STATUS", "PING", "AUTHENTICATE"]
WEBHOOK_EVENTS = ["violation.new", "violation.resolved", "risk.changed", "scan.completed"]
