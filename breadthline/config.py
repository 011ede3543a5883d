"""Fixed values of the method: thresholds, horizons, labels and column lists.

Everything here is a published parameter that results depend on. Nothing is
computed; the modules that use a value import it by name.
"""

# --- windows -----------------------------------------------------------------
RETURN_MONTHS = (3, 6, 9, 12)
BLEND_WEIGHTS = {3: 0.40, 6: 0.20, 9: 0.20, 12: 0.20}
UP_DAYS_MONTHS = 6
WEEKS_SHORT_MA = 10
WEEKS_LONG_MA = 30
WEEKS_RANGE = 52
SLOPE_SESSIONS = 10
MIN_RANGE_SESSIONS = 200
VOLUME_BASELINE = 50
UD_SESSIONS = 20
VALUE_SESSIONS = 20
ATR_SESSIONS = 14
SMA_RISING_SESSIONS = 21
BASE_SESSIONS = 50
BASE_BLOCKS = 5
DRYUP_RECENT = 10
DRYUP_BASELINE = 50
PANEL_SESSIONS = 420
BREADTH_SESSIONS = 250
CHART_SESSIONS = 260
CHART_MIN_POINTS = 40

# --- thresholds --------------------------------------------------------------
NEAR_HIGH_FRACTION = 0.97
BREAKOUT_VOLUME = 1.5
BREAKOUT_UD = 1.3
DISTRIBUTION_UD = 0.7
HEAVY_UD = 0.6
STRONG_UD = 1.5
EXTENDED_MULTIPLE = 1.20
LIQUID_VALUE = 5e7
RS_LEADER = 80.0
RS_ADEQUATE = 50.0
TEMPLATE_LOW_MULTIPLE = 1.30
TEMPLATE_HIGH_FRACTION = 0.75
TEMPLATE_MIN_RS = 70.0
LINE_HIGH_TOLERANCE = 0.005
LINE_PRICE_GAP_PCT = -5.0
CONTRACTION_RATIO_MAX = 0.60
DRYUP_MAX = 0.80
MIN_CONTRACTIONS = 2
MAX_BASE_DEPTH_PCT = 35.0
READY_SLOPE_MIN = -0.10
READY_RS_MIN = 50.0
READY_CONTRACTION_MAX = 0.70
READY_DRYUP_MAX = 0.90
EXTENSION_VERY = 75.0
EXTENSION_IDEAL = 20.0
EXTENSION_NEAR = 2.0
REGIME_BROAD = 60.0
REGIME_MIXED = 40.0
STAGE2_SHARE_BROAD = 0.45

# --- information boundary ------------------------------------------------------
TRADED_SHARE_FLOOR = 0.05
MIN_SYMBOLS_TO_JUDGE = 20
MAX_CLOSED_SHARE = 0.15
MIN_SESSIONS_TO_JUDGE_RATE = 60
MAX_UNIVERSE_LOSS_PCT = 2.0
CLOSE_HOUR = 16
MARKET_ZONE = "Asia/Kolkata"
HISTORY_DAYS = 500

# --- corporate actions ---------------------------------------------------------
IMPLAUSIBLE_MOVE = 0.35
RATIO_TOLERANCE = 0.04
MASS_EVENT_FLOOR = 8
MASS_EVENT_PCT = 2.0
# Price ratio of today's close to yesterday's, and the action it names.
KNOWN_ACTIONS = (
    (0.1000, "1:10 split"),
    (0.1250, "1:8 split"),
    (0.2000, "1:5 split"),
    (0.2500, "1:4 split"),
    (0.3333, "1:3 split"),
    (0.4000, "2:5 split"),
    (0.5000, "1:2 split or 1:1 bonus"),
    (0.6667, "3:2 (1:2 bonus)"),
    (0.7500, "4:3 (1:3 bonus)"),
    (2.0000, "2:1 reverse split"),
    (3.0000, "3:1 reverse split"),
    (5.0000, "5:1 reverse split"),
    (10.000, "10:1 reverse split"),
)
NO_CLEAN_RATIO = "demerger or spin-off (no clean split ratio)"

# --- labels (fixed values) -------------------------------------------------------
STAGES = ("Stage 1", "Stage 2", "Stage 3", "Stage 4")
STAGE_LABELS = {
    "Stage 1": "Stage 1 — Basing",
    "Stage 2": "Stage 2 — Advancing",
    "Stage 3": "Stage 3 — Topping",
    "Stage 4": "Stage 4 — Declining",
}
STAGE_NAMES = {
    "Stage 1": "Basing",
    "Stage 2": "Advancing",
    "Stage 3": "Topping",
    "Stage 4": "Declining",
}
ACTIONS = ("BUY★", "BUY", "HOLD", "WAIT", "WATCH★", "WATCH", "REDUCE", "SELL", "AVOID")
HEALTH_FLAGS = (
    "Above_MA_30W",
    "MA_30W_Rising",
    "MA10W_Above_MA30W",
    "Above_MA_10W",
    "RS_Not_Lagging",
)
TEMPLATE_FLAGS = (
    "TT1_Above_150_200",
    "TT2_150_Above_200",
    "TT3_200_Rising",
    "TT4_50_Above_150_200",
    "TT5_Above_50",
    "TT6_Above_52W_Low",
    "TT7_Near_52W_High",
    "TT8_RS",
)
REGIMES = {
    "Broad": "Most of the universe is above its 30-week line.",
    "Mixed": "Participation is split around the 30-week line.",
    "Narrow": "Most of the universe is below its 30-week line.",
    "Unavailable": "Breadth cannot be measured from this snapshot.",
}
STAGE_GROUP_TEXT = (
    "Stage is the locked 30-week structure; the label changed between the two decision dates."
)
ACTION_GROUP_TEXT = (
    "The guide interpretation label moved because its underlying evidence moved."
)
# Flag, value it must move to, group, description.
FLAG_MOVES = (
    ("Breakout", True, "New breakout setup",
     "Stage 2, within 3% of the 52-week high, on volume > 1.5×."),
    ("Breakout_Confirmed", True, "Newly confirmed breakout",
     "Breakout setup that now also has U/D > 1.3."),
    ("Breakout_Confirmed", False, "Lost breakout confirmation",
     "Confirmation conditions no longer hold."),
    ("Above_MA_10W", True, "Reclaimed the 10-week line",
     "Close moved back above the 10-calendar-week average."),
    ("Above_MA_10W", False, "Lost the 10-week line",
     "Close moved below the 10-calendar-week average."),
    ("Near_52W_High", True, "Moved within 3% of the 52-week high",
     "Close is now inside the locked 3% proximity band."),
    ("Extended_20Pct", True, "Newly extended beyond 20%",
     "Close is now more than 20% above the 30-week line."),
    ("Distribution", True, "New distribution warning", "U/D fell below 0.7."),
    ("Distribution", False, "Distribution warning cleared", "U/D recovered to 0.7 or above."),
)

# --- forward record ------------------------------------------------------------
HORIZONS_WEEKS = (4, 8, 13)
SETTLE_SESSIONS = 3
ARCHIVE_DECIMALS = 4
ARCHIVE_REQUIRED = (
    "Symbol", "Date", "Close", "Action", "Stage", "RS_Score",
    "Trend_Template_Pass", "Breakout_Confirmed",
)
ARCHIVE_EXCLUDED = ("Company Name", "Industry", "Series")
# The names of the cohorts. What each asks for is told to the fingerprint of a grade.
COHORTS = {
    "universe": "all rows of the snapshot",
    "buy_star": "rows whose label is the confirmed buy",
    "stage2_rs80": "advancing rows with a score of eighty or more",
    "trend_template": "rows that pass all eight criteria",
    "breakout_confirmed": "rows with the confirmed breakout flag",
}
RECORD_KEY = ("snapshot_date", "horizon_weeks", "cohort")

# --- universe admission -----------------------------------------------------------
LIQUIDITY_WINDOW = 60
LIQUIDITY_RATIO = 0.90
LIQUIDITY_MIN_SAMPLE = 10

# --- swing experiments --------------------------------------------------------------
SWING_REVERSAL_PCT = 1.5
CASCADE_INITIAL_PCT = 15.0
CASCADE_RATIO = 0.25
CASCADE_FLOOR_PCT = 1.5
FOOTPRINT_MIN_WEEKS = 3
FOOTPRINT_MAX_WEEKS = 65
FOOTPRINT_MAX_CONTRACTIONS = 6
RECOVERY_FRACTION = 0.70
RECOVERY_MIN_PCT = 1.0
SWEEP_THRESHOLDS = (1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 15.0, 20.0)

# --- screens ---------------------------------------------------------------------
PAGE_SIZE = 50
MOVERS_INLINE = 25
# Sort name, column, ascending.
SCREENER_SORTS = {
    "RS (high to low)": ("RS_Score", False),
    "RS (low to high)": ("RS_Score", True),
    "3-month return": ("R3M", False),
    "Shallowest 12-month fall": ("MaxDD_12M", False),
    "Extension above 30-week": ("Ext_Pct", False),
    "U/D ratio": ("U_D", False),
    "Symbol (A–Z)": ("Symbol", True),
}
SETUP_SORTS = {
    "Evidence (most first)": ("Setup_Evidence", False),
    "Readiness (best first)": ("Stage1_Readiness", False),
    "Closest to pivot": ("Pct_To_Pivot", True),
    "Tightest contraction": ("Contraction_Ratio", True),
    "Driest volume": ("Volume_DryUp", True),
    "RS (high to low)": ("RS_Score", False),
    "Template score": ("Trend_Template_Score", False),
}
INDUSTRY_SORTS = {
    "Median RS (high to low)": ("Median_RS", False),
    "Median RS (low to high)": ("Median_RS", True),
    "Participation": ("Participation_Pct", False),
    "Median 3-month return": ("Median_R3M", False),
    "Stocks (most first)": ("Stocks", False),
    "Industry (A–Z)": ("Industry", True),
}
