"""Streams of new documents and of view states, an extension."""
