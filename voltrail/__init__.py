"""Session analytics on Spark: clean, report, profile, forecast, predict and segment charging sessions."""
