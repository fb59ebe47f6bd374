"""Decision, ranking and calibration data jobs on Spark DataFrames."""
