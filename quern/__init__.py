"""quern: an analytics engine expressed on Spark's own planner."""
