"""windloom: sensor time-series, condition-monitoring and retrieval operators as Spark DataFrame functions."""
