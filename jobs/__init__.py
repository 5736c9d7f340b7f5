"""Runnable jobs. Each has a function that takes a session and paths, a command line and a small config file."""
