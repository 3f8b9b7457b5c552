"""models of graphloom."""
