"""Query graphs and the planner, in plain Python on the driver."""
