"""Schemas and column names shared by batch and streaming code."""

from __future__ import annotations

from pyspark.sql import types as T

SYMBOL = "symbol"
TIME = "DateTime"
BAR_KEY = [SYMBOL, TIME]
PROFILE = "VolumeByPrice"

# Names used by the vendor's charts and the names results must carry.
VENDOR_NAMES = {
    "Last": "Close",
    "ID6.SG1": "RVOL",
    "ID4.SG1": "TodayOpen",
    "ID4.SG2": "TodayHigh",
    "ID4.SG3": "TodayLow",
    "ID9.SG1": "LTMaxVol",
    "ID9.SG2": "LTTotalVol",
    "ID9.SG3": "LargeBidTrade",
    "ID9.SG4": "LargeAskTrade",
    "ID2.SG1": "Delta",
    "ID2.SG10": "CumulativeDelta",
}
STUDIES = {6: [1], 4: [1, 2, 3], 9: [1, 2, 3, 4], 2: [1, 10]}
HELPER_COLUMNS = ["IsBarClosed"]
REQUIRED_COLUMNS = ["Open", "High", "Low", "Close", "Volume"]
OPTIONAL_COLUMNS = ["RVOL", "Price", "Delta", "CumulativeDelta"]
LEVEL_COLUMNS = ["Price", "BidVol", "AskVol", "TotalVolume", "NumOfTrades"]
STUDY_COLUMNS = [
    "RVOL", "TodayOpen", "TodayHigh", "TodayLow", "LTMaxVol", "LTTotalVol",
    "LargeBidTrade", "LargeAskTrade", "Delta", "CumulativeDelta",
]
BAR_COLUMNS = REQUIRED_COLUMNS + STUDY_COLUMNS

# Limits and labels of the statistical report.
BINS = 50
IQR_REACH = 1.5
Z_LIMIT = 3
HIGH_CORRELATION = 0.7
SKEW_LABELS = {"middle": "Approximately Normal", "right": "Right Skewed", "left": "Left Skewed"}
TAIL_LABELS = {"heavy": "Heavy Tailed", "light": "Light Tailed", "middle": "Normal Tails"}

# Shares, ratios and names of order-flow signals.
VALUE_AREA = 0.7
IMBALANCE = 1.5
NO_SIGNAL = "none"
REVERSAL_DOWN, REVERSAL_UP = "potential_reversal_down", "potential_reversal_up"
SMART_BUYING, SMART_SELLING = "smart_money_accumulation", "smart_money_distribution"
ACCUMULATION, DISTRIBUTION = "accumulation", "distribution"
STRONG_BREAKOUT = "strong_breakout"
BUYING_EXHAUSTED, SELLING_EXHAUSTED = "buying_exhausted", "selling_exhausted"

DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"

LEVEL = T.StructType([
    T.StructField("Price", T.DoubleType()),
    T.StructField("BidVol", T.LongType()),
    T.StructField("AskVol", T.LongType()),
    T.StructField("TotalVolume", T.LongType()),
    T.StructField("NumOfTrades", T.LongType()),
])

TAPE = T.StructType([
    T.StructField(SYMBOL, T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("trade_id", T.LongType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("size", T.LongType()),
    T.StructField("side", T.StringType()),
])


def _fields(names, kind):
    return [T.StructField(n, kind()) for n in names]


RAW_BAR = T.StructType(
    [T.StructField(SYMBOL, T.StringType()), T.StructField(TIME, T.TimestampNTZType())]
    + _fields(["Open", "High", "Low", "Last"], T.DoubleType)
    + _fields(["Volume"], T.LongType)
    + _fields([f"ID{i}.SG{j}" for i, js in STUDIES.items() for j in js], T.DoubleType)
    + _fields(HELPER_COLUMNS, T.BooleanType)
    + [T.StructField(PROFILE, T.ArrayType(LEVEL))]
)

FLAT_VBP = T.StructType(
    [T.StructField(SYMBOL, T.StringType()), T.StructField(TIME, T.TimestampNTZType())]
    + _fields(["Open", "High", "Low", "Close"], T.DoubleType)
    + _fields(["Volume"], T.LongType)
    + _fields(STUDY_COLUMNS, T.DoubleType)
    + LEVEL.fields
)

# The stored text form carries the time as a string, parsed by sources.files.
FLAT_VBP_TEXT = T.StructType([
    T.StructField(f.name, T.StringType() if f.name == TIME else f.dataType)
    for f in FLAT_VBP.fields
])
