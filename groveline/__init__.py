"""Preparing one wide business table and learning a binary outcome from it, on Spark.

Every operator is a plain function taking and returning a ``DataFrame``; the
session is always the caller's and there is no global state.
"""
