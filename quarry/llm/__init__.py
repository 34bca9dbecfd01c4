"""Operators of a training-data pipeline. Nothing outside this subpackage imports it.

Ten operators, one module each, with their own general interface; ``queries`` registers one named
query per operator over its whole table.
"""
