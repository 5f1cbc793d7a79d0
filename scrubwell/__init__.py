"""scrubwell: preparing and auditing free-text record corpora for privacy studies, on Spark."""
