"""Physical-shape helpers and the registered queries."""
