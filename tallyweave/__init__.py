"""tallyweave: set-based reconciliation of business documents on Spark."""
