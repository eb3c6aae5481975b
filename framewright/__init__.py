"""framewright: Spark-first analytics for grouped, time-stamped count data."""
