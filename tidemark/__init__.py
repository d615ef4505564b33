"""Spark-native forecasting evaluation over long time-series panels."""
