"""Flow stores, imports and metadata files."""
