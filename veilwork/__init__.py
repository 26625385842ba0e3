"""veilwork: de-identification of clinical text, profiles and JSON as Spark DataFrame operators."""

__version__ = "0.1.0"
