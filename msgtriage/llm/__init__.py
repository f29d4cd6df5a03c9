"""Operators that prepare training data for language models.

Nothing outside this folder imports it; the driver contract adds its queries
only where it is installed.
"""
