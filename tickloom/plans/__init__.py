"""Parameter sweeps, permutation tests and walk-forward validation as single Spark plans."""
