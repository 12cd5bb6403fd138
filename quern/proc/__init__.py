"""A procedural runtime: blocks, functions, procedures and packages, interpreted on the driver.

Statements that touch tables are Spark jobs; the rest is ordinary Python.  Set-based statements are
the way to large data: a loop over a cursor reads rows through the driver, one partition at a time.
"""

from .runtime import Runtime

__all__ = ["Runtime"]
