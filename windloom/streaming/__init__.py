"""Streaming forms of the sequence operators; each has a batch twin that gives the same rows."""
