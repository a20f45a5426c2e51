"""textloom: text-task preparation and scoring as Spark DataFrame jobs."""

__version__ = "0.1.0"
