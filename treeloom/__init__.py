"""treeloom: relational operators for code trees, listings and session logs on Spark."""
