"""Operators for preparing large training corpora.

Nothing else in the package imports this subpackage; ``maskline.llm.queries``
lists its queries for the driver entry point.
"""
