"""Parcel and land-record analytics as PySpark DataFrame operators."""
