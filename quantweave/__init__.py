"""Set-based equity-factor analytics on Spark."""
