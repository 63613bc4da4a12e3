"""Output formats: distributed lines, and reports of the shown rows."""
