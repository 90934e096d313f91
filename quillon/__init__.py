"""Cross-sectional panel analytics on Spark."""
