"""Query catalogue: the reference-side operators as named plans."""
