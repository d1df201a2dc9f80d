"""Grid, forecast and catalogue analytics as plain Spark plans."""
