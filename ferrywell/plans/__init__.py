"""Load jobs, and the named queries over the provided tables with their SQL counterparts."""
