"""Readers for the landed tables and raw inputs."""
