"""Writers: plain exports, clustered layouts and versioned target tables."""
