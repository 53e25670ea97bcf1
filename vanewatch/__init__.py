"""vanewatch: condition-monitoring analytics for machine fleets on Spark."""

__version__ = "0.1.0"
