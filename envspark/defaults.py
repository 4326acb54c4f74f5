"""Names, quality-index parameters, class cuts and limits."""

from __future__ import annotations

from dataclasses import dataclass

ORDER = ("timestamp", "record_number")


@dataclass(frozen=True)
class Parameter:
    """One weighted input of the quality index.

    ``scale`` is the permitted standard for the deviation index and the
    standard deviation of the bell curve for the gaussian index.
    """

    column: str
    ideal: float
    scale: float
    weight: float


# Deviation index (lower is better).
DEVIATION_PARAMETERS = (
    Parameter("ph", 7.0, 8.5, 0.25),
    Parameter("turbidity", 0.0, 5.0, 0.35),
    Parameter("conductance", 0.0, 1500.0, 0.25),
    Parameter("do_mgl", 8.0, 4.0, 0.15),
)

# Gaussian index (higher is better).
GAUSSIAN_PARAMETERS = (
    Parameter("ph", 7.0, 0.5, 0.25),
    Parameter("turbidity", 0.1, 2.0, 0.35),
    Parameter("conductance", 500.0, 100.0, 0.25),
    Parameter("do_mgl", 8.0, 1.5, 0.15),
)

# The same, with oxygen read in percent of saturation but rated like mg/L.
SATURATION_PARAMETERS = (*GAUSSIAN_PARAMETERS[:3], Parameter("do_sat", 8.0, 1.5, 0.15))

# Class names from best to worst, and the cut between neighbours.
CLASSES = ("Excellent", "Good", "Poor", "Very Poor")
UNKNOWN_CLASS = "Unknown"
DEVIATION_CUTS = (25.0, 50.0, 75.0)
GAUSSIAN_CUTS = (80.0, 60.0, 40.0)

# Calendar names.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Column discovery.
TIMESTAMP_NAMES = ("timestamp", "date", "datetime", "date_time")
SITE_NAMES = ("Site", "site", "Location", "location", "Station", "station", "Station Name")
NON_NUMERIC_NAMES = ("timestamp", "date", "record number", "record_number", "quality")

# Display name of each sensor column and its canonical name.
CANONICAL_NAMES = {
    "Timestamp": "timestamp",
    "Record number": "record_number",
    "Average Water Speed": "water_speed",
    "Average Water Direction": "water_direction",
    "Chlorophyll": "chlorophyll",
    "Temperature": "temperature",
    "Dissolved Oxygen": "do_mgl",
    "Dissolved Oxygen (%Saturation)": "do_sat",
    "pH": "ph",
    "Salinity": "salinity",
    "Specific Conductance": "conductance",
    "Turbidity": "turbidity",
    "Chlorophyll [quality]": "chlorophyll_quality",
    "Temperature [quality]": "temperature_quality",
    "Dissolved Oxygen [quality]": "do_mgl_quality",
    "Dissolved Oxygen (%Saturation) [quality]": "do_sat_quality",
    "pH [quality]": "ph_quality",
    "Salinity [quality]": "salinity_quality",
    "Specific Conductance [quality]": "conductance_quality",
    "Turbidity [quality]": "turbidity_quality",
}

# Fixed values: (column, test, status at the upper cut, at the lower cut, below, upper cut, lower cut).
HEALTH_RULES = (
    ("ph", "{c} BETWEEN 6.5 AND 8.5", "Optimal", "Acceptable", "Concerning", 80.0, 60.0),
    ("do_mgl", "{c} >= 5", "Good", "Moderate", "Low", 70.0, 50.0),
    ("turbidity", "{c} <= 5", "Clear", "Moderate", "Cloudy", 70.0, 50.0),
    ("conductance", "{c} <= 1500", "Normal", "Elevated", "High", 70.0, 50.0),
)

# Fixed values: (column, target, good low, good high, acceptable low, acceptable high).
TARGETS = (
    ("ph", 7.0, 6.5, 8.5, 6.0, 9.0),
    ("do_mgl", 8.0, 6.0, 10.0, 4.0, 12.0),
    ("turbidity", 2.0, 0.0, 5.0, 0.0, 10.0),
)
