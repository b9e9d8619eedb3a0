"""Values that have to be exactly these for results to be right."""

# --- Fixed values: log formats -------------------------------------------------
# Fields of one access-log line, in the order they appear in it.
LINE_FIELDS = (
    "ip", "remote_user", "time_local", "method", "url", "protocol",
    "status", "body_bytes_sent", "http_referer", "user_agent",
)
# Common format stops after the byte count. Neither format is anchored at its end.
COMMON_LINE = (
    r'(\S++) - (\S++) \[([^\]]++)\] '
    r'"(\S++) (\S++) (\S+)" '
    r'(\d++) (\d++)'
)
COMBINED_LINE = COMMON_LINE + r' "([^"]*+)" "([^"]*+)"'
# The parts of a combined line in order, by which the cause of a rejection is told, and the
# causes they count as; the first five make a common line.
LINE_STAGES = (
    ("address", r'\S++ - \S++ '), ("time", r'\[[^\]]++\] '), ("request", r'"\S++ \S++ \S+" '),
    ("status", r'\d++ '), ("size", r'\d++'), ("agent", r' "[^"]*+" "[^"]*+"'),
)
PARSE_ERRORS = {
    "address": "unexpected_characters", "time": "malformed_timestamp",
    "request": "invalid_url_format", "status": "missing_status_code",
    "size": "unexpected_characters", "agent": "unexpected_characters",
}
# Time inside the brackets: 12/Oct/2024:06:25:24 +0000 (offset with or without a colon).
LOG_TIME_FORMATS = ("d/MMM/yyyy:H:m:s Z", "d/MMM/yyyy:H:m:s XXX")
# A line needs more than this many blank-separated tokens to carry a response time.
RESPONSE_TIME_MIN_TOKENS = 10

# --- Fixed values: window features ---------------------------------------------
FEATURE_COLUMNS = (
    "total_requests", "rps", "error_rate_5xx", "error_rate_4xx", "error_rate_404",
    "avg_response_time", "max_response_time", "min_response_time", "std_response_time",
    "unique_ips", "top_ip_count", "unique_paths", "top_path_count", "top_path_ratio",
    "get_ratio", "post_ratio",
    "rps_change", "error_rate_5xx_change", "error_rate_404_change",
    "avg_response_time_change",
)
CHANGE_COLUMNS = ("rps", "error_rate_5xx", "error_rate_404", "avg_response_time")
WINDOW_SECONDS = 60

# --- Fixed values: models ------------------------------------------------------
FOREST_TREES = 100
FOREST_CONTAMINATION = 0.1
FOREST_SUBSAMPLE = 256
MODEL_SEED = 42
AUTOENCODER_HIDDEN = (32, 24)
AUTOENCODER_CODE = 16
AUTOENCODER_THRESHOLD_QUANTILE = 0.95
AUTOENCODER_SCALE_EPS = 1e-8

# --- Fixed values: failure patterns --------------------------------------------
PATTERN_MINUTES = 10
PATTERN_SIMILARITY = 0.8
PATTERN_NEIGHBOURS = 5

# --- Fixed values: alerts ------------------------------------------------------
ERROR_RATE_THRESHOLD = 5.0
RESPONSE_TIME_THRESHOLD = 1000.0
ANOMALY_SCORE_THRESHOLD = 0.75
ALERT_DEFAULTS = {"alert_type": "unknown", "message": "", "severity": "medium"}
# Texts around the formatted number: (before, digits after the point, after).
ALERT_MESSAGES = {
    "error_rate": ("5xx 에러 비율이 ", 2, "%로 임계값을 초과했습니다."),
    "response_time": ("평균 응답 시간이 ", 2, "ms로 임계값을 초과했습니다."),
    "anomaly": ("이상 패턴이 감지되었습니다. (점수: ", 4, ")"),
}
ALERT_SEVERITY = {"error_rate": "high", "response_time": "medium", "anomaly": "high"}
# Subject of an e-mail: label of each severity, and the label of any other.
SEVERITY_LABELS = {"low": "낮음", "medium": "보통", "high": "높음"}
SEVERITY_LABEL_OTHER = "알 수 없음"
EMAIL_SUBJECT_PREFIX = "[로그 이상 탐지] "

# --- Fixed values: report sizes ------------------------------------------------
SCAN_LIMIT = 1000
ALERT_SCAN_LIMIT = 100
TRAINING_SCAN_LIMIT = 100_000
TRAINING_DAYS = 7
RECENT_LOGS_SHOWN = 20
RECENT_WINDOWS_SHOWN = 10
RECENT_ALERTS_SHOWN = 5
KEPT_LOGS = 1000
KEPT_WINDOWS = 100
KEPT_ALERTS = 50
FEATURE_INPUT_LOGS = 100
ERROR_RATE_LOGS = 100
ANOMALY_ALERTS_CHECKED = 10
MIN_TRAINING_WINDOWS = 5
SHOWN_LOG_COLUMNS = ("timestamp", "ip", "method", "url_path", "status_code")
SUCCESS_CODES = (200, 201)
CLIENT_ERROR_CODES = (400, 404)
SERVER_ERROR_CODES = (500, 502, 503)
REJECT_PREFIX = 100
