"""functions of graphloom."""
