"""Night-time light-source analytics as Spark jobs: functions from DataFrames to DataFrames."""
