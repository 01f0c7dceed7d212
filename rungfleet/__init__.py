"""Spark jobs over fleets of controller programs and their device logs."""
