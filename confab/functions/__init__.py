"""See the package docstring of confab."""
