"""See the package docstring of kolot."""
