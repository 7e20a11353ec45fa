"""Survey and text analytics on Spark."""
