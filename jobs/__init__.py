"""Runnable jobs over the library, and their registered queries."""
