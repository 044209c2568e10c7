"""Tesserae subpackage."""
