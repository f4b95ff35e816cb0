"""Query catalogue: named queries over the test tables, with their SQL counterparts."""
