"""Offer-list review and analytics on Spark DataFrames."""
