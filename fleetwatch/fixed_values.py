"""Values that must be exactly these for results to agree with existing users' data."""

# --- fixed values -----------------------------------------------------------

# Columns every sample file must have; the metric column can be renamed.
KEY_COLUMNS = ("service", "pod", "node")
TIME_COLUMN = "timestamp"
METRIC_COLUMN = "cpuusage"

# Fields an uploaded table must offer, under whatever column names.
UPLOAD_FIELDS = ("service", "pod", "metric", "node", "timestamp", "cpu_usage")

# Text that stands for a missing value in a sample file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Length of the common window of a service, and where in the spare time it starts.
WINDOW_HOURS = 8
WINDOW_FRACTION = 0.6394267984578837

# One chart tick every so many minutes.
TICK_MINUTES = 15

# Keep one of so many points.
KEEP_EVERY = 2

# Answer format: marker for "no anomaly", and the tags.
NO_ANOMALY = "无异常"
RESULT_PATTERN = r"(?s)<result>(.*?)</result>"
POD_PATTERN = r"(?s)<pod\d+>(.*?)</pod\d+>"

# Longest answer to ask for, in tokens.
MAX_ANSWER_TOKENS = 1000

# Default region of the log pickers.
DEFAULT_REGION = "us-east-1"

# Rows of a preview.
PREVIEW_ROWS = 5

# Accepted metric range of the optional check.
METRIC_LOW = 0
METRIC_HIGH = 100

# Names of stored charts.
CHART_NAME_PREFIX = "cpu_usage_"
CHART_FOLDER = "output/anomalies/"

# Status record.
STATUS_OK = 200
STATUS_FAILED = 500
STATUS_MESSAGE = "Analysis completed successfully"
ALL_NORMAL_MESSAGE = "所有服务均无异常"

# Text given to the model: headings and one block per pod.
STATS_HEADING = "Statistics:\n"
VALUES_HEADING = "Raw Data:\n"
POD_HEAD = "Pod: {pod}\nNode: {node}\n"
STATS_LINE = "Mean: {mean}, Max: {max}, Min: {min}, Std: {std}\n\n"
VALUES_HEAD = "Data:\n"
VALUES_END = "\n\n"
NO_VALUES = "Series([], )"
MISSING_NUMBER = "nan"

# Chart texts.
CHART_TITLE = "CPU Usage Over Time - {service}\n({hours}-hour window with downsampled data)"
CHART_X_LABEL = "Time"
CHART_Y_LABEL = "CPU Usage (%)"

# Error texts.
NO_FILE = "CSV file not found: "
EMPTY_FILE = "The CSV file is empty"
UNREADABLE_FILE = "Error parsing CSV file. Please check the file format"
MISSING_COLUMNS = "Missing required columns: "
OUT_OF_RANGE = "CPU usage values must be between {low} and {high}"
