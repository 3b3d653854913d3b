"""Streams of image files that feed the batch transforms."""
