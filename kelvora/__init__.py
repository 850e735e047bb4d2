"""Asymmetric-cost energy fields over gridded terrain and street networks, as Spark plans."""
