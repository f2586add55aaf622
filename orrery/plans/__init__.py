"""Expression translation, and the registered queries."""
