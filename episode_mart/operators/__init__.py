"""DataFrame operators: rules, episodes, payers, patients, alignment, profiling, keys."""
