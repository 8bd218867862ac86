"""A research engine on Spark: panels, signals, portfolio accounting, validation and rules."""
