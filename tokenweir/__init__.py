"""Token-corpus preparation and analytics on Spark."""
