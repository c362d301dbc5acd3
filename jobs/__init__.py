"""Runnable jobs over tables of files, each with a command line and a config file."""
