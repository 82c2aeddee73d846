"""Feature engineering, sampling and statistics over large event panels on Spark."""
