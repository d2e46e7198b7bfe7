"""Batch and streaming operators over users, their projects and the projects' files."""

__version__ = "0.1.0"
