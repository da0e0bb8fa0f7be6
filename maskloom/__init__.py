"""Instance-mask and label analytics as Spark jobs: masks are rows of per-column intervals."""
