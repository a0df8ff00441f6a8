"""Spark-native analytics: drift correction of localization tables, and corpus operators in ``llm``."""
