"""NumPy kernels that run once per technician; no Spark import."""
