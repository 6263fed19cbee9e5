"""Workload timesteps: frequencies of events per period, over tables and over streams."""
