"""Tidewell: Spark-native processing of labelled forum posts."""
