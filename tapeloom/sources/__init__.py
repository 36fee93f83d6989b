"""Readers, decoders, generators and writers."""
