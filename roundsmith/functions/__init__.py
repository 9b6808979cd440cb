"""Column functions: recurrence rules, dates, geography, workload."""
