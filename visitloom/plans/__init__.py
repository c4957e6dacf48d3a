"""Complete queries, each next to the plain SQL that says what it must return."""
