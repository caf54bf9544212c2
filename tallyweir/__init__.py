"""tallyweir: continuous keyed statistics and data-preparation operators on Spark."""

__version__ = "0.1.0"
