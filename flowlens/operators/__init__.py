"""DataFrame operators; each takes column names as parameters."""
