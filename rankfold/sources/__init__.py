"""Readers, cleaners, generators and writers of numeric columns."""
