"""Relational tables to ordered, time-consistent cell sequences, as Spark jobs."""
