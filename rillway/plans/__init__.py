"""Batch jobs and registered queries."""
