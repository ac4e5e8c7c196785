"""Operators over pages, blocks, cells and lines."""
