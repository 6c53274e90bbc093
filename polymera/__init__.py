"""Polymera: a multi-model analytics engine expressed on public PySpark APIs."""
