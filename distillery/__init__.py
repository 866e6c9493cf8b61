"""Question-aware reduction of document collections, written for Spark."""
