"""Operators that prepare training text.

Nothing outside this package imports it; deleting it leaves the scanners of
the library whole.
"""
