"""Column functions: no Python runs on the executors."""
