"""operators of graphloom."""
