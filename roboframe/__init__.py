"""Data engine for robot-policy and language-model training sets, written for Spark DataFrames."""
