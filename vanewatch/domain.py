"""Domain values. All of them are fixed values that results depend on."""

from __future__ import annotations

FARMS = ["A", "B", "C"]

STATUS_LABELS = {
    0: "normal operation",
    1: "derated",
    2: "idling (normal)",
    3: "service",
    4: "downtime (fault)",
    5: "other",
}
VALID_STATUS = list(STATUS_LABELS)
REDUCED_STATUS = [1, 2]
DOWNTIME_STATUS = 4

# Columns of a silver row that are not sensors.
META_COLUMNS = ["farm", "asset_id", "time_stamp", "status_type_id", "event_id", "event_label"]
LINEAGE_COLUMNS = ["_source_file", "_ingested_at"]

# Component -> words looked for in a sensor's description.
COMPONENT_KEYWORDS = {
    "gearbox": ["gear", "planetary bearing"],
    "hydraulics": ["hydraulic"],
    "pitch": ["pitch", "blade"],
    "generator": ["generator"],
    "transformer": ["transformer"],
    "rotor_brake": ["rotor brake", "brake"],
    "vibration": ["vibration"],
}

# Fault category -> words looked for in an event's description; the first category wins.
TRAINING_TAXONOMY = {
    "gearbox": ["gearbox", "gear box"],
    "hydraulic": ["hydraulic"],
    "pitch": ["pitch"],
    "generator": ["generator"],
    "transformer": ["transformer"],
    "converter": ["converter", "inverter"],
    "yaw": ["yaw"],
    "plc_communication": ["plc", "communication"],
    "rotor_brake": ["rotor brake", "brake"],
    "bearing": ["bearing", "lager"],
}
TRAINING_OTHER = "other"

# The bilingual list used for reports.
REPORT_TAXONOMY = {
    "Gearbox": ["gear", "getriebe"],
    "Hydraulics": ["hydraulic", "hydraulik"],
    "Pitch / blade angle": [
        "pitch", "blade angle", "axis 1", "axis 2", "axis 3", "axis1", "axis2", "axis3",
    ],
    "Generator": ["generator"],
    "Transformer": ["transformer", "transformator"],
    "Converter": ["converter", "umrichter"],
    "Yaw": ["yaw"],
    "PLC / communication / wiring": [
        "plc", "communication", "wiring", "plug", "nc300", "nc310", "bk1120", "harting", "beckhoff",
    ],
    "Rotor brake": ["rotor brake", "rotorbrake", "rotorbremse"],
    "Bearing": ["bearing", "lager"],
}
REPORT_OTHER = "Other / unclassified"
REPORT_NORMAL = "Normal (n/a)"

# Category -> words for picking representative sensors, and words that raise a sensor's score.
PROFILE_KEYWORDS = {
    "Gearbox": ["gear"],
    "Hydraulics": ["hydraulic"],
    "Pitch": ["pitch", "axis 1", "axis 2", "axis 3", "axis1", "axis2", "axis3"],
    "Generator": ["generator"],
    "Transformer": ["transformer"],
    "Rotor brake": ["rotor brake", "brake"],
    "Vibration": ["vibration"],
}
BONUS_WORDS = ["temperature", "oil", "pressure", "level"]
SENSORS_PER_CATEGORY = 3
SAMPLE_STRIDE = {"A": 3, "B": 3, "C": 8}

# Fault report category -> sensor category whose sensors illustrate it.
DEGRADATION_TARGETS = {
    "Gearbox": "Gearbox",
    "Hydraulics": "Hydraulics",
    "Pitch / blade angle": "Pitch",
    "Generator": "Generator",
    "Transformer": "Transformer",
    "Rotor brake": "Rotor brake",
    "Bearing": "Vibration",
}

ROLLING_HOURS = [1, 6, 24]
RUL_HORIZON_HOURS = 720
MIN_TREND_DAYS = 30
FORECAST_DAYS = 14
QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
MIN_QUANTILE_ROWS = 10

DEFAULT_FAULT_THRESHOLD = 0.7
DEFAULT_RUL_THRESHOLD = 72.0
RISK_ACCENT = 0.25

# Data types the meta columns of a raw file must have.
EXPECTED_TYPES = {
    "time_stamp": "datetime",
    "asset_id": "int",
    "id": "int",
    "train_test": "str",
    "status_type_id": "int",
}
SPARSE_PCT = 5.0

# Hours / days rows stay in the serving store, by environment.
RETENTION_DAYS = {"dev": 7, "staging": 180, "uat": 365}
HOT_HOURS = 24

LANDING_PATTERN = r"^farm=[ABC]/turbine=[^/]+/.+$"
FILE_EVENT_PATTERN = r"comma_(\d+)\.csv$"
