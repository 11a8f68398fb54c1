"""Spark library for analysing large tables of reasoning-model generation traces."""
