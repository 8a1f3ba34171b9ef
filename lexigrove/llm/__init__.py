"""Training-data operators.

Self-contained: nothing else in the library imports this subpackage, and the
library works when this folder is absent.
"""
