"""Runnable jobs: ``python -m jobs.<name> --help``. Each does its work in run(), which takes a session."""
