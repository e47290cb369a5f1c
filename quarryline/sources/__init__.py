"""Readers and writers of files, versioned assets, vector collections and event logs."""
