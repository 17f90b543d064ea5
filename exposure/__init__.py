"""Secret-exposure analytics on Spark: detection, redaction, inventory, access and audit as DataFrame jobs."""

__version__ = "0.1.0"
