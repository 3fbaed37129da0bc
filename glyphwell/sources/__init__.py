"""Readers and writers of Office containers, label tables and reports."""
