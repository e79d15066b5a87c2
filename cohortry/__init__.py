"""cohortry: cohort audit and model evaluation as ordinary Spark jobs."""
