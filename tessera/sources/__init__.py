"""Readers and writers: the object catalog, JSON documents, blobs, key-value tables."""
