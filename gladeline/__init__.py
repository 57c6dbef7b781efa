"""Parcel forest-loss screening as Spark DataFrame jobs."""
