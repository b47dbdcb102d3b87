"""Operators for preparing training text: cleaning, duplicates, classification, sharding and encoding."""
