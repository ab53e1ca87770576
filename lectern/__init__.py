"""Learning-platform analytics on Spark: DataFrame operators, window tables, reports, streams."""
