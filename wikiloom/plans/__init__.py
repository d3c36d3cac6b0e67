"""Plan helpers: shared intermediate tables and session settings."""
