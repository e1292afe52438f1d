"""Spark-native search and analytics over message archives."""
