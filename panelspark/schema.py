"""Domains, label maps and survey vocabulary.

Everything in the block below is a FIXED VALUE: the answer labels, their ordinal codes and the
question texts of the survey this library analyses.  They must stay exactly as written (including
the lower-case ``frequently``, the ``3-2 times`` label and the en dash in the spending bands),
because encoders, filters and domain-ordered reports match on them literally.
"""

from __future__ import annotations

# ----------------------------------------------------------------------------------------------
# FIXED VALUES (survey vocabulary; keep verbatim)
# ----------------------------------------------------------------------------------------------

# Question text -> short column name.
QUESTION_ALIASES = {
    "ID": "id",
    "Start time": "start_time",
    "Completion time": "end_time",
    "Email": "email",
    "Name": "name",
    "Last modified time": "modified_time",
    "Age Group": "age_group",
    "Gender": "gender",
    "Average Monthly Online Spending (₹)": "spending",
    "Which platforms do you regularly use to consume influencer content": "platforms",
    "Average time spent per day watching influencer-related content": "daily_time",
    "Do you currently follow any influencers?": "follows_influencers",
    "Which type of influencer content do you engage with the most?": "content_type",
    "What factor makes you trust an influencer the most?": "trust_factor",
    "How often do you interact with influencer content (likes, comments, shares, saves)?": "engagement_freq",
    "To what extent do influencer reviews affect your interest in a product?": "product_interest_score",
    "Have you ever searched for a product after seeing it promoted by an influencer?": "searched_product",
    "How often have you purchased a product because of an influencer recommendation?": "purchase_freq",
    "What primarily motivated you to make that purchase?": "purchase_motivation",
    "How satisfied were you with products bought through influencer recommendations?": "satisfaction_score",
    "How often do you click on ads shown after engaging with influencer content?": "ad_click_freq",
    "Do you believe ads shown to you are influenced by the influencers you follow and content you engage with?": "ad_influenced",
    ". How likely are you to buy a product after seeing repeated ads for it (retargeting)?": "retargeting_score",
    "Which ad format influences you the most?": "preferred_ad_format",
}

# Columns about the person or the form, which no analysis reads.
PERSONAL_COLUMNS = ["email", "name", "modified_time"]

SPENDING_MAP = {"< ₹500": 1, "₹500–₹2000": 2, "₹2000–₹5000": 3, "₹5000+": 4}
DAILY_TIME_MAP = {"Less than 1 hour": 1, "1-2 hour": 2, "2-4 hour": 3, "More than 4 hours": 4}
ENGAGEMENT_MAP = {"Rarely": 1, "Sometimes": 2, "frequently": 3, "Almost always": 4}
PURCHASE_MAP = {"Never": 0, "1-2 times": 1, "2-3 times": 2, "3-2 times": 3, "More than 5 times": 4}
AD_CLICK_MAP = {"Never": 0, "Rarely": 1, "Sometimes": 2, "Frequently": 3}
AGE_MAP = {"13-18": 1, "19-24": 2, "25-30": 3, "31-40": 4, "40": 5, "40+": 5}
AD_INFLUENCED_MAP = {"Yes": 1.0, "Not sure": 0.5, "No": 0.0}

AGE_GROUPS = ["13-18", "19-24", "25-30", "31-40", "40+"]
SPENDING_LEVELS = ["< ₹500", "₹500–₹2000", "₹2000–₹5000", "₹5000+"]
DAILY_TIME_LEVELS = ["Less than 1 hour", "1-2 hour", "2-4 hour", "More than 4 hours"]
ENGAGEMENT_LEVELS = ["Rarely", "Sometimes", "frequently", "Almost always"]
PURCHASE_LEVELS = ["Never", "1-2 times", "2-3 times", "3-2 times", "More than 5 times"]
AD_CLICK_LEVELS = ["Never", "Rarely", "Sometimes", "Frequently"]
AD_INFLUENCED_LEVELS = ["Yes", "Not sure", "No"]

PLATFORMS_DASHBOARD = ["Instagram", "YouTube", "Pinterest", "Snapchat", "Facebook", "Twitter"]
PLATFORMS_NOTEBOOK = ["Instagram", "YouTube", "Pinterest", "Snapchat", "Facebook", "Twitter", "Tik Tok"]
# Platforms offered by the segment filter and the per-platform reports.
PLATFORMS_FILTER = ["Instagram", "YouTube", "Pinterest", "Snapchat", "Facebook"]

CONTENT_TYPES = [
    "Food", "Entertainment / Memes", "Travel / Lifestyle", "Fitness / Health",
    "Technology / Gadgets", "Fashion / Beauty", "Finance / Education",
]
TRUST_FACTORS = [
    "Content quality", "Transparency in reviews", "Authenticity", "Expertise in niche",
    "High follower count", "Brand collaborations",
]
MOTIVATIONS = [
    "Positive reviews", "Discount / coupon code", "Trust in influencer", "Attractive content",
    "Curiosity", "Trend / FOMO",
]
# Dashboard flag name -> motivation label.
MOTIVATION_FLAGS_DASHBOARD = {
    "motiv_positive_reviews": "Positive reviews",
    "motiv_coupon": "Discount / coupon code",
    "motiv_trust": "Trust in influencer",
    "motiv_attractive": "Attractive content",
    "motiv_curiosity": "Curiosity",
    "motiv_fomo": "Trend / FOMO",
}
AD_FORMATS = ["Reels", "Feed posts", "Stories", "Sponsored influencer posts", "Carousel ads"]

# Defaults the dashboard uses when a column is missing from the input.
MISSING_COLUMN_DEFAULTS = {
    "spending_ord": 2, "daily_time_ord": 2, "engagement_ord": 2, "purchase_ord": 1,
    "ad_click_ord": 1, "age_ord": 2, "searched_binary": 1, "ad_influenced_binary": 0.5,
}

# Flow-graph stage labels (engagement level -> stage, purchase code -> stage).
FLOW_ENGAGE_LABELS = {
    "Rarely": "Low Engage", "Sometimes": "Med Engage",
    "frequently": "High Engage", "Almost always": "High Engage",
}
FLOW_PURCHASE_LABELS = {0: "No Purchase", 1: "Low Purchase", 2: "Mid Purchase", 3: "High Purchase", 4: "High Purchase"}
FLOW_ENGAGE_DEFAULT = "Low Engage"
FLOW_PURCHASE_DEFAULT = "No Purchase"

# Campaign benchmarks per influencer tier: cpm, ctr, cvr.
TIER_BENCHMARKS = [
    ("Nano (1K–10K)", 80.0, 0.038, 0.052),
    ("Micro (10K–100K)", 140.0, 0.028, 0.041),
    ("Macro (100K–1M)", 320.0, 0.018, 0.029),
    ("Mega (1M+)", 900.0, 0.009, 0.015),
]
# Platform multipliers: reach, ctr, cpm.
PLATFORM_MULTIPLIERS = [
    ("Instagram Reels", 1.25, 1.30, 1.10),
    ("YouTube", 1.10, 1.10, 1.05),
    ("Instagram Feed", 0.90, 0.85, 0.95),
    ("Stories", 0.75, 0.70, 0.80),
    ("Snapchat", 0.65, 0.60, 0.75),
]
RETARGETING_CPM_FACTOR = 0.6
RETARGETING_CTR_FACTOR = 0.7
# Preset scenarios: name, tier, platform, commission share, retargeting share, influencers.
SCENARIOS = [
    ("Micro-Influencer Heavy", "Micro (10K–100K)", "Instagram Reels", 0.60, 0.15, 10),
    ("Macro + YouTube", "Macro (100K–1M)", "YouTube", 0.55, 0.25, 2),
    ("Mega Brand Play", "Mega (1M+)", "Instagram Reels", 0.70, 0.10, 1),
]

# Cluster naming thresholds: (purchase rate, engagement) rules, checked in order.
CLUSTER_NAMES = ["High-Value Converter", "Passive Buyer", "Engaged Window-Shopper", "Low-Engagement Observer"]

# Strength labels: Spearman |rho| cuts, Cramer's V cuts, Cohen's d cuts.
RHO_CUTS = (0.4, 0.2)
CRAMERS_V_CUTS = (0.3, 0.15)
COHENS_D_CUTS = (0.8, 0.5)
ALPHA = 0.05

# Hypothesis neutral point for the satisfaction t-test.
NEUTRAL_SCORE = 3.0

# Correlation / clustering feature set of the dashboard.
NUMERIC_FEATURES = [
    "spending_ord", "daily_time_ord", "engagement_ord", "product_interest_score",
    "satisfaction_score", "ad_click_ord", "retargeting_score",
]
# Pairs of the independence tests: two labels, two columns.
CHI_PAIRS = [
    ("Trust Factor", "Made Purchase", "trust_factor", "made_purchase"),
    ("Trust Factor", "High Ad Responsive", "trust_factor", "high_ad_responsive"),
    ("Age Group", "Made Purchase", "age_group", "made_purchase"),
    ("Gender", "Made Purchase", "gender", "made_purchase"),
    ("Preferred Ad Format", "High Ad Responsive", "preferred_ad_format", "high_ad_responsive"),
]
# Pairs of the rank-correlation hypotheses: label, two columns.
SPEARMAN_PAIRS = [
    ("H1: Trust → Purchase", "product_interest_score", "purchase_ord"),
    ("H2: Engagement → Purchase", "engagement_ord", "purchase_ord"),
    ("H3: Satisfaction → Retargeting", "satisfaction_score", "retargeting_score"),
    ("H4: Daily Time → Engagement", "daily_time_ord", "engagement_ord"),
    ("H5: Product Interest → Ad Click", "product_interest_score", "ad_click_ord"),
]
# Stars of a correlation by its absolute value.
STAR_CUTS = (0.3, 0.2, 0.1)
# Columns written by the filtered-rows export.
EXPORT_COLUMNS = [
    "age_group", "gender", "spending", "platforms", "daily_time", "follows_influencers",
    "trust_factor", "engagement_freq", "product_interest_score", "purchase_freq",
    "satisfaction_score", "ad_click_freq", "ad_influenced", "retargeting_score",
    "preferred_ad_format", "purchase_ord", "engagement_ord", "spending_ord", "made_purchase",
    "high_ad_responsive",
]
PREVIEW_COLUMNS = [
    "age_group", "gender", "spending", "trust_factor", "purchase_freq", "engagement_freq",
    "preferred_ad_format", "satisfaction_score", "made_purchase",
]

# English stop words used by the term-frequency report (a small common list).
STOPWORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as",
    "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can",
    "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further",
    "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself", "his",
    "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "me", "more", "most", "my",
    "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our",
    "ours", "ourselves", "out", "over", "own", "same", "she", "should", "so", "some", "such", "than",
    "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this",
    "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were", "what",
    "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would", "you", "your",
    "yours", "yourself", "yourselves",
]
