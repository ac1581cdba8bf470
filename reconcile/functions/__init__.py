"""Column functions; all are built-in expressions that stay in the JVM."""

from . import checksums, kinds, paths, scenarios, text  # noqa: F401
