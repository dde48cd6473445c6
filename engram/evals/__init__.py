"""Scripted scenarios over the memory, four metrics, thresholds."""
