"""Runnable queries over the driver's tables. The views in ``views`` present those tables as market data."""
