"""Hybrid retrieval analytics over document collections, written for Spark."""
