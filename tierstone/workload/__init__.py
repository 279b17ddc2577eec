from tierstone.workload import checks, context, evidence, lake, landing, star, stores, traces  # noqa: F401
