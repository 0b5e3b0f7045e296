"""DataFrame-to-DataFrame operators: cleaning, change data, reconciliation, profiling, contracts, metadata."""
