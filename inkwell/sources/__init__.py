"""Tables of input files."""
