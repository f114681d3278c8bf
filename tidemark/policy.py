"""Fixed values of the research policy. They decide results, so they are stated once, plainly, and passed as defaults."""

POLICY_VERSION = "2026.08.02.1"

# Investability screen.
INVESTABLE_EXCHANGES = ("XNYS", "XNAS", "ARCX", "BATS")
INVESTABLE_TYPES = ("common_stock", "adr")
MIN_PRICE = 2.0
MIN_MARKET_CAP = 300_000_000.0
MIN_MEDIAN_DOLLAR_VOLUME = 5_000_000.0
MIN_PRIOR_SESSIONS = 126

# Vendor security-type codes and the type they stand for.
SECURITY_TYPES = {"CS": "common_stock", "ADRC": "adr", "ADRP": "adr", "GDR": "adr"}

# Forward labels: sessions ahead -> absolute benchmark-relative move that counts.
SWING_THRESHOLDS = {1: 0.10, 5: 0.15}
OUTCOME_THRESHOLDS = {1: 0.10, 5: 0.15, 21: 0.20}
COST_BAND_PERCENT = 0.5
MAX_EXIT_SLIP_DAYS = 15

# Trailing windows, in sessions.
SHORT_WINDOW, MEDIUM_WINDOW, LONG_WINDOW, HIGH_WINDOW = 21, 63, 126, 252
VOLUME_RECENT, VOLUME_BASE = 5, 60
SESSIONS_PER_YEAR = 252

FEATURES = ("excess_return_5d", "excess_return_21d", "excess_return_63d", "excess_return_126d", "volatility_21d",
            "volatility_ratio", "drawdown_252", "distance_63", "liquidity_surge", "log_dollar_volume",
            "return_dispersion_21d")
EVENT_FEATURES = ("days_since_results", "days_since_insider_buy", "insider_net_value_90d", "material_filings_30d")
MAX_DAYS_SINCE_EVENT = 365

# Forecast alerts and the gates a model passes before alerts are shown.
EARLY_WATCH_MIN, RESEARCH_ALERT_MIN, MAX_DAILY_ALERTS = 0.20, 0.35, 5
PROMOTION = {"sessions": 60, "matured": 200, "watches": 40, "swings": 15, "brier_skill": 0.10,
             "calibration_error": 0.05, "directional_accuracy": 0.60}

# Scoring.
PROBABILITY_FLOOR = 1e-6
RELIABILITY_BINS = 10
BOOTSTRAP_SAMPLES = 400

# Weekly jump radar.
JUMP_TIERS = (0.03, 0.05, 0.075, 0.10)
JUMP_THRESHOLD = 0.10
RADAR_HORIZON, RADAR_LOOKBACK, RADAR_MIN_SESSIONS, MIN_COHORT = 5, 252, 150, 200
SHORTLIST, DISPLAY = 12, 5
VOLATILITY_BANDS = ((0.35, "calm"), (0.60, "normal"), (0.95, "lively"))

# Event study.
ENTRY_OFFSETS, EXIT_OFFSETS, MIN_EVENTS = (-5, -3, -1, 0), (0, 1, 2, 5, 10), 100
ROUND_TRIP_COST_PERCENT = 0.20

#: Price snapshots kept of each symbol.
SNAPSHOT_RETENTION = 300
