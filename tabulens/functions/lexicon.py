"""Fixed values. Word lists, thresholds and character sets that decide results."""

# fixed values: cell texts that mean "missing" (compared after trim and lower case)
MISSING_TOKENS = [
    "", "?", "-", ".", "empty",
    "n/a", "n.a.", "n\\a", "na", "null", "none", "nan",
    "missing", "unknown", "tbd", "tba",
    "لا يوجد", "لا شيء", "لا شي", "لاشيء", "لا توجد",
    "غير محدد", "غير معروف", "غير متوفر",
    "بدون", "مجهول", "فارغ",
]

# fixed values: name keywords per column role
DATE_KEYWORDS = [
    "date", "time", "datetime", "timestamp", "created", "updated", "modified",
    "تاريخ", "وقت", "سنة", "شهر", "يوم", "created_at", "updated_at",
    "start", "end", "due", "deadline", "completion", "arrival", "departure", "recorded",
]
ID_KEYWORDS = [
    "id", "_id", "rowid", "row_id", "index", "serial", "uuid", "pk", "key",
    "رقم", "معرف", "no", "number", "num", "code", "ref", "reference",
]
TARGET_KEYWORDS = [
    "label", "target", "class", "category", "output", "result", "outcome",
    "status", "type", "grade", "verdict", "sentiment", "fraud", "churn",
    "risk", "diagnosis", "disease", "approved", "prediction",
    "تصنيف", "فئة", "نتيجة", "هدف", "نوع", "حالة", "درجة",
]
INCIDENT_KEYWORDS = [
    "ticket", "incident", "case", "request", "sla", "resolution", "issue",
    "error", "pr", "po", "rfx", "vendor", "root_cause", "complaint", "defect",
    "fault", "bug", "problem", "escalation",
]

# fixed values: identifier rules of the clustering and of the routing stage
CLUSTER_ID_NAMES = ["id", "index", "row", "key"]
CLUSTER_ID_TERMS = [
    "id", "uuid", "guid", "key", "index", "row", "record", "ticket", "incident",
    "case", "request", "req", "pr", "po", "rfx", "email", "phone", "mobile",
]
CLUSTER_DATE_TERMS = ["date", "time", "timestamp", "created", "resolved", "closed", "opened"]
ROUTE_ID_TERMS = ["id", "uuid", "guid", "ticket", "incident", "request", "serial", "key", "code"]

# fixed values: target names by priority
TARGET_EXACT = [
    "target", "label", "class", "y", "output", "result", "outcome",
    "severity", "status", "decision", "root_cause", "root cause",
    "category", "prediction_target", "dependent_variable",
]
TARGET_PRIORITY = [
    "target", "label", "outcome", "result", "class", "severity", "status",
    "score", "rating", "grade", "risk", "price", "cost", "sales",
    "revenue", "profit", "amount", "total", "duration", "resolution_time",
    "sla", "delay", "failure", "root_cause",
]

# fixed values: terms that hint at target leakage
LEAKAGE_TERMS = [
    "target", "label", "outcome", "result", "status", "resolved", "closed",
    "final", "prediction", "actual", "score", "class", "category",
]

# fixed values: order of severities and of chart priorities
SEVERITIES = ["critical", "high", "medium", "low", "info"]
CHART_PRIORITIES = ["critical", "high", "medium", "low"]

# fixed values: currency signs and separators dropped from prices; rating words
PRICE_CHARS = "£$€¥₹, \t\n"
RATING_WORDS = ["one", "two", "three", "four", "five"]

# fixed values: markers of wrongly decoded Arabic text, and encodings to try
GARBLED_MARKERS = "ÙØÃ�"
ENCODINGS = ["utf-8", "windows-1256", "iso-8859-1"]
