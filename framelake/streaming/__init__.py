"""Growing files and counters that run along."""
