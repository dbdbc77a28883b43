"""kinweave: shared-address entity linkage on Spark, and operators for preparing training text."""

__version__ = "0.1.0"
