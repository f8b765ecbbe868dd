"""Multi-silo data valuation as Spark DataFrame programs."""
