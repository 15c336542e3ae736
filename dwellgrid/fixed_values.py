"""Enumerations, lookup texts and the reference floor plan.

These are data, not logic: results must carry exactly these codes and texts.
"""

# Event, zone and severity codes.
EVENT_TYPES = (
    "ENTRY", "EXIT", "ZONE_ENTER", "ZONE_EXIT", "ZONE_DWELL",
    "BILLING_QUEUE_JOIN", "BILLING_QUEUE_ABANDON", "REENTRY", "PURCHASE",
)
GENERATOR_EVENT_TYPES = EVENT_TYPES[:-1]
ZONE_TYPES = ("ENTRY", "EXIT", "DISPLAY", "BILLING", "AISLE")
ANOMALY_TYPES = ("QUEUE_SPIKE", "CONVERSION_DROP", "TRAFFIC_DROP", "DEAD_ZONE")
PRIORITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

# The seeded zone dimension (zone_id, name, zone_type, priority, polygon).
ZONES = (
    ("Z_ENTRANCE", "Entrance", "ENTRY", 10, [[0, 0], [100, 0], [100, 80], [0, 80]]),
    ("Z_SKINCARE", "Skincare", "DISPLAY", 5, [[110, 0], [250, 0], [250, 120], [110, 120]]),
    ("Z_FRAGRANCE", "Fragrance", "DISPLAY", 5, [[260, 0], [380, 0], [380, 120], [260, 120]]),
    ("Z_MAKEUP", "Makeup", "DISPLAY", 5, [[110, 130], [250, 130], [250, 260], [110, 260]]),
    ("Z_HAIRCARE", "Haircare", "AISLE", 3, [[260, 130], [380, 130], [380, 260], [260, 260]]),
    ("Z_WELLNESS", "Wellness", "AISLE", 3, [[390, 0], [510, 0], [510, 130], [390, 130]]),
    ("Z_GIFTING", "Gifting", "DISPLAY", 4, [[390, 140], [510, 140], [510, 260], [390, 260]]),
    ("Z_BILLING", "Billing", "BILLING", 8, [[520, 0], [620, 0], [620, 200], [520, 200]]),
)

# The camera floor plan, 1280 x 720 pixels.
LAYOUT = (
    ("ZONE_ENTRY_01", "Main Entry", "ENTRY", 10, [[0, 580], [200, 580], [200, 720], [0, 720]]),
    ("ZONE_EXIT_01", "Main Exit", "EXIT", 10, [[1080, 580], [1280, 580], [1280, 720], [1080, 720]]),
    ("ZONE_SKINCARE_01", "Skincare Aisle", "DISPLAY", 5, [[200, 300], [500, 300], [500, 580], [200, 580]]),
    ("ZONE_MAKEUP_01", "Makeup Counter", "DISPLAY", 5, [[500, 300], [800, 300], [800, 580], [500, 580]]),
    ("ZONE_HAIRCARE_01", "Haircare Aisle", "DISPLAY", 5, [[200, 50], [700, 50], [700, 300], [200, 300]]),
    ("ZONE_BILLING_01", "Billing Counter", "BILLING", 8, [[800, 300], [1080, 300], [1080, 720], [800, 720]]),
)

# Recommended action per anomaly type.
RECOMMENDED_ACTIONS = {
    "QUEUE_SPIKE": (
        "Activate additional checkout counters. "
        "Alert floor staff to direct customers to shortest queue. "
        "Consider opening self-checkout if available."
    ),
    "CONVERSION_DROP": (
        "Review recent in-store promotions and pricing changes. "
        "Check if billing zone is accessible and well-staffed. "
        "Inspect for product stockouts in high-traffic zones."
    ),
    "DEAD_ZONE": (
        "Inspect the zone for physical blockages or lighting issues. "
        "Review planogram — product placement may be driving customers away. "
        "Consider repositioning promotional displays to re-attract traffic."
    ),
    "TRAFFIC_DROP": (
        "Check for external factors: weather, local events, competitor activity. "
        "Verify store signage and entry are visible and unobstructed. "
        "Review recent marketing campaigns for gaps in coverage."
    ),
}

# Explanation per anomaly type (root cause, business impact, actions, priority).
EXPLANATIONS = {
    "QUEUE_SPIKE": (
        "Queue depth has exceeded the 7-day same-hour baseline by a statistically "
        "significant margin, indicating sudden demand surge or reduced checkout throughput.",
        "Extended wait times increase abandonment risk and reduce overall conversion rate.",
        [
            "Open additional checkout counters immediately.",
            "Deploy floor staff to direct customers to the shortest queue.",
            "If available, activate self-checkout lanes.",
        ],
        "HIGH",
    ),
    "CONVERSION_DROP": (
        "Conversion rate is significantly below the historical same-hour average, "
        "suggesting a friction point between zone engagement and purchase completion.",
        "Lower conversion directly reduces revenue per visitor and degrades ROI on footfall.",
        [
            "Check billing zone accessibility and staffing levels.",
            "Review recent pricing or promotional changes in high-traffic zones.",
            "Inspect for product stockouts that may deter purchase intent.",
        ],
        "HIGH",
    ),
    "TRAFFIC_DROP": (
        "Unique visitor count is significantly below the 7-day same-hour baseline, "
        "pointing to a footfall collapse that may stem from external or entry-point issues.",
        "Reduced footfall compresses the opportunity base for conversions and revenue.",
        [
            "Verify store signage and entry are unobstructed.",
            "Check for any physical blockages or access issues at the entrance.",
            "Review recent marketing coverage for gaps.",
        ],
        "MEDIUM",
    ),
    "DEAD_ZONE": (
        "Zone visitor count has collapsed relative to the 7-day baseline, "
        "indicating customers are actively avoiding this area.",
        "Under-trafficked zones reduce product exposure and cannibalize overall dwell time.",
        [
            "Inspect the zone for physical blockages or poor lighting.",
            "Review planogram — product placement may be repelling traffic.",
            "Reposition promotional displays to re-attract customer flow.",
        ],
        "MEDIUM",
    ),
}
DEFAULT_EXPLANATION = (
    "An anomaly was detected that deviates significantly from the historical baseline.",
    "Operations may be impacted — manual inspection is recommended.",
    [
        "Investigate the flagged store area.",
        "Consult with floor management.",
        "Monitor metrics for the next 30 minutes.",
    ],
    "MEDIUM",
)

# Question keywords, tried in this order.
QUESTION_KEYWORDS = (
    ("anomaly", ("anomaly", "anomalies", "issue", "problem", "wrong", "investigate", "alert")),
    ("conversion", ("conversion", "rate", "dropping", "drop", "sale", "sales", "purchase", "purchases", "buy")),
    ("traffic", ("traffic", "visitor", "visitors", "footfall", "crowd", "people", "occupancy")),
)

# Funnel stages as (code, display label), and the richer dashboard stages.
FUNNEL_STAGES = (
    ("ENTRY", "Entry"),
    ("ZONE_ENGAGEMENT", "Zone Engagement"),
    ("BILLING_ZONE_REACHED", "Billing Zone"),
    ("CONVERTED", "Converted"),
)
STAGE_BENCHMARKS = {"ENTRY": 100.0, "ENGAGEMENT": 72.0, "BILLING": 42.0, "PURCHASE": 28.0}
STAGE_CAUSES = {
    "ENTRY": "Low storefront pull-in — passing-by traffic not converting to walk-ins.",
    "ENGAGEMENT": "Visual merchandising not capturing attention in the first 30 seconds.",
    "BILLING": "Queue congestion at checkout causing pre-purchase abandonment.",
    "PURCHASE": "Cart-stage friction — payment failures or upsell fatigue.",
}
STAGE_RECOMMENDATIONS = {
    "ENTRY": "Re-position window display and route a greeter to the entrance.",
    "ENGAGEMENT": "Refresh end-cap displays and brief floor staff on new launches.",
    "BILLING": "Open an additional checkout counter and enable mobile billing.",
    "PURCHASE": "Pre-stage bags and remove upsell prompts during peak hours.",
}

# Rule-based answers; names in braces are filled from the evidence.
ANSWER_LEAD = "Rule-Based Fallback: "
CONCLUSIONS = {
    "alerts": "Operational issues are present today: {types}. Immediate inspection of affected zones is recommended.",
    "no_alerts": "No anomalies have been detected today. Operational parameters are running within normal historical limits.",
    "sales_alert": (
        "The conversion rate is {rate}% with {sales} purchases. "
        "A critical issue is present in the checkout funnel: {sales_alert} alert is active."
    ),
    "abandonment": (
        "Today's conversion rate is {rate}%. "
        "High queue abandonment ({abandoned} checkouts abandoned) is a primary bottleneck."
    ),
    "smooth": (
        "Today's conversion rate is {rate}%. "
        "There are {sales} conversions from {visitors} visitors, with checkout operations running smoothly."
    ),
    "traffic": (
        "Foot traffic today stands at {visitors} unique visitors, with an average dwell time of {dwell} minutes. "
        "Traffic peaked at hour {peak_or_na}."
    ),
    "general": (
        "Store is currently operating with {visitors} unique visitors, {rate}% conversion rate, "
        "and {n_alerts} active anomalies."
    ),
}
OBSERVATIONS = {
    "alerts": "Detected {n_alerts} active operational anomalies in the database.",
    "alert_line": "Anomaly {rank}: {type} ({severity}) of {metric} vs baseline {baseline} (z-score: {z}).",
    "no_alerts": "No active operational anomalies are currently logged in the database.",
    "conversion": (
        "The store conversion rate today is {rate}%.",
        "Completed purchases: {sales} transactions out of {visitors} unique customer visits.",
        "Billing queue checkout abandonments: {abandoned} events.",
    ),
    "sales_alert": "There is an active alert: {sales_alert} with severity {sales_severity}.",
    "traffic": ("Total unique visitors today: {visitors}.", "Average customer dwell time: {dwell} minutes."),
    "peak": "Traffic peaked during hour {peak}:00.",
    "general": (
        "Store has {visitors} unique visitors with {sales} conversions ({rate}% conversion rate).",
        "Average dwell time: {dwell} minutes; max queue depth: {queue} customers.",
        "Active alerts count: {n_alerts}.",
    ),
}

# Trend and title texts of alerts.
TREND_TEXT = "Current value is {delta}% {direction} the 7-day same-hour average (z-score {z})."
TITLE_INACTIVE = "Zone inactive for {minutes} min{zone}"
TITLE_PLAIN = "{label} detected"
TITLE_SCORED = "{label} detected (z = {z}, {percent}% confidence)"

# UUID namespace OID used for deterministic ids.
NAMESPACE_OID_HEX = "6ba7b8129dad11d180b400c04fd430c8"
