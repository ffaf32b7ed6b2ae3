"""Operators for preparing training text: ten document operators and their queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it can be imported.
"""
