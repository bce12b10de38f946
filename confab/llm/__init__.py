"""Operators for language and training data; nothing else in confab imports this package."""
