"""Readers of tables, files, XML invoices and JSON documents."""
