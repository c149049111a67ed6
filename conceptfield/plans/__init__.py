"""Query plans and their registry."""
