"""panelloom: analytics over daily price panels, written for Spark."""
