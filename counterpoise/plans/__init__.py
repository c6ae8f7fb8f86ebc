"""Whole runs: matching, downsampling, and the registered queries."""
