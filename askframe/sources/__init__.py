"""Where tables come from: catalog, schema model, profiling, conventions, lockfile."""
