"""Shipment analytics on PySpark: clean untidy shipment records once, then list, search, rank and report on them."""

__version__ = "0.1.0"
