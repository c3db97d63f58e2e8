"""Sources, sinks and things shipped to the executors."""
