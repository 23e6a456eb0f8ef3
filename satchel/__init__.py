"""Spark jobs over an archive of saved web items: parse, merge, search, compare."""
