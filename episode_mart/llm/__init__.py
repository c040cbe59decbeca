"""Operators for training data: text documents, web pages and conversations."""
