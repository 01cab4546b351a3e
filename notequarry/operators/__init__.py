"""Operators over the tables of a knowledge base."""
