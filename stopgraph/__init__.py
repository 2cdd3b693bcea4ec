"""Spark-native analytics for public-transit timetables."""
